from matchloom.sources import fixtures


def test_every_benchmark_row_is_a_requirement(spark, tmp_path):
    """60 requirements: all are there, and resumes and reports point at each of them."""
    spark.createDataFrame([(k, f"requirement {k}") for k in range(60)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(k, f"text {k}", "s", 7) for k in range(600)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.sql("SELECT id AS o_orderkey, id AS o_custkey, DATE '2023-01-01' AS o_orderdate, 10.5D AS o_totalprice FROM range(120)").write.parquet(f"{tmp_path}/orders.parquet")
    v = fixtures.Views(spark, str(tmp_path))
    for rows in (v.jds, v.resumes.where("jd_id IS NOT NULL"), v.reports):
        assert {r.jd_id for r in rows.select("jd_id").collect()} == set(range(60))
    assert {(r.resume_id, r.jd_id) for r in v.resumes.where("jd_id IS NOT NULL").collect()} == {(k, k % 60) for k in range(600) if k % 9}
