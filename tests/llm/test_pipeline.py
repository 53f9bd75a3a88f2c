import corpus_pipeline
from matchloom.llm._common import documents

from ._fixtures import SCHEMA, brute_components, odd_rows
from .test_dedup import brute_exact
from .test_mixing import brute_targets


def test_stages_against_brute_force(spark):
    docs = documents(spark, "/root/testdata/sf0.001")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "exact dedup", "near dedup", "mixing", "packing"]
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], "/root/testdata/sf0.001").cache())
    for f in frames[1:-1]:
        assert f.columns == docs.columns
    rows = [[(r.doc_id, r.text) for r in f.collect()] for f in frames[:-1]]
    assert len(rows[1]) >= 0.97 * len(rows[0])  # clean documents stay
    assert sorted(i for i, _ in rows[2]) == sorted({k[0] for k in brute_exact(rows[1]).values()})
    assert sorted(i for i, _ in rows[3]) == sorted(set(brute_components(rows[2])[0].values()))
    sizes, longest, taken = {}, {}, {}
    for r in frames[3].collect():
        n = len((r.text or "").encode().split())
        sizes[r.source] = sizes.get(r.source, 0) + n
        longest[r.source] = max(longest.get(r.source, 0), n)
    for r in frames[4].collect():
        taken[r.source] = taken.get(r.source, 0) + len((r.text or "").encode().split())
    for s, target in brute_targets(sizes).items():
        assert abs(taken.get(s, 0) - target) <= longest[s]
    pieces = frames[5].collect()
    assert sum(r.piece == 0 for r in pieces) == len(rows[4])
    assert {r.doc_id for r in pieces} == {i for i, _ in rows[4]}


def test_run_equals_the_stages(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    again = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))


def test_run_on_odd_rows_and_on_none(spark, tmp_path):
    """Nulls, blanks, a very long text, repeats, a row without an id and clashing columns; and an empty table."""
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    docs.union(docs.limit(5)).write.parquet(f"{tmp_path}/odd/documents.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    ids = {r.doc_id for r in out}
    # letters there, a language told, one of each group: 3 and 5 are copies of 4, 6 is near it, 10 near 9
    assert ids and ids <= {r.doc_id for r in docs.collect()} - {0, 1, 2, 11} and len(ids & {3, 4, 5, 6, 7}) <= 1
    assert all(0 < r.length <= 4096 for r in out)
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
