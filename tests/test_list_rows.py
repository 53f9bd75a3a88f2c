"""What the lists start from: one row of a résumé, made where it is read."""

import duckdb

from matchloom.operators import matching as m
from matchloom.plans import registry


def test_a_list_reads_documents_once_and_joins_none(spark, sf_dir):
    for name in ("suggestions_guarded", "suggestions_six_rules"):
        plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "suggestion-state" not in plan and plan.count("Relation [doc_id") == 1


def test_shared_words_are_found_once(spark):
    words = spark.createDataFrame([(0, "rest", 2, 1), (0, "thing", 1, 2)], "jd_id long, keyword string, weight int, rnk int")
    rows = spark.createDataFrame([(1, 0, "a thing, the"), (2, 0, "things"), (3, 7, "rest"), (4, None, "rest"), (5, 0, "")], "resume_id long, jd_id long, text string")
    out = m.with_missing(rows, words)
    assert "array_contains(array_intersect" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r.resume_id: (r.n_keywords, [x.keyword for x in r.missing]) for r in out.collect()} == {1: (2, ["rest"]), 2: (2, ["rest", "thing"]), 3: (0, []), 4: (0, []), 5: (2, ["rest", "thing"])}


def test_lists_without_keywords_bullets_and_ids(spark, tmp_path):
    docs = [(1, "Summary\nthe one\nand two 12\nthe thr%\nworked and ran"), (2, None), (3, ""), (4, "rest of it"), (None, "Summary\nthe one")]
    spark.createDataFrame([(k, x, "s", 9) for k, x in docs], "doc_id long, text string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "requirement of rest"), (1, "of a")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    duck = duckdb.connect()
    for table in ("documents", "benchmark"):
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    for name in ("suggestions_guarded", "suggestions_six_rules", "suggestions_staged"):
        got, want = registry.QUERIES[name](spark, str(tmp_path)), duck.sql(registry.ORACLES[name])
        place = [want.columns.index(c) for c in got.columns]
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(tuple(r[i] for i in place)) for r in want.fetchall())
