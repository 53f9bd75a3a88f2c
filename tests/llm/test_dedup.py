import hashlib
import re

from pyspark.sql import functions as F

from matchloom.llm import exact_dedup, id_filter, near_dedup
from matchloom.llm._common import documents

from ._fixtures import SCHEMA, brute_components, odd_rows, prose


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(hashlib.sha256(re.sub("[\x20\x09-\x0d]", "", t or "").encode()).hexdigest(), []).append((i, t or ""))
    return {i: (min(g, key=lambda x: (-len(x[1]), x[0] is None, x[0] or 0))[0], len(g), s) for s, g in groups.items() for i, _ in g}


def check_exact(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = exact_dedup.exact_dedup(docs).collect()
    want = brute_exact(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.keep_id, r.group_size, r.text_sha256) == want[r.doc_id]
        assert r.kept == (r.doc_id == r.keep_id)
    kept = exact_dedup.distinct_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted({str(k[0]) for k in want.values()})


def test_exact_against_brute_force(spark, sf_dir):
    check_exact(documents(spark, sf_dir))
    check_exact(spark.createDataFrame(odd_rows(), SCHEMA))


def test_exact_with_a_tiny_filter_and_hot_groups(spark):
    rows = [(k, "same text" if k % 3 == 0 else f"text {k}") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs).collect()}
    assert got[3].group_size == 1000 and got[3].keep_id == 0 and got[1].group_size == 1


def test_exact_repeats_and_empty(spark):
    docs = spark.createDataFrame([(1, "x y"), (1, "x y"), (2, "xy")], "doc_id long, text string")
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs).collect()) == [(1, 1, 3, True), (1, 1, 3, True), (2, 1, 3, False)]
    assert exact_dedup.distinct_documents(docs).count() == 1
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0
    assert exact_dedup.distinct_documents(docs.limit(0)).count() == 0


def test_id_filter(spark):
    rows, gone = spark.range(5000).toDF("doc_id"), spark.range(0, 5000, 7).toDF("doc_id")
    assert id_filter.without(rows, gone, "doc_id").count() == 5000 - gone.count()


def check_near(docs):
    rows = [(r.doc_id, r.text) for r in docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").collect()]
    root, sizes = brute_components(rows)
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (sizes[r.doc_id], root[r.doc_id], root[r.doc_id] == r.doc_id)


def test_near_against_brute_force(spark, sf_dir):
    check_near(documents(spark, sf_dir))
    check_near(spark.createDataFrame(odd_rows(), SCHEMA))


def test_near_chains_and_large_groups(spark):
    """A chain whose ends are far apart, a group of near copies, and unlike texts around a shared passage."""
    base = prose(3, 200).split()
    rows = [(k, " ".join(base[: 200 - 4 * k] + [f"n{k}x{i}" for i in range(4 * k)])) for k in range(12)]
    hot = prose(4, 150).split()
    rows += [(100 + k, " ".join([*hot[: k % 140], f"w{k}", *hot[k % 140 :]])) for k in range(300)]
    passage = prose(6, 60)
    rows += [(1000 + k, passage + " " + prose(1000 + k, 45)) for k in range(60)]
    check_near(spark.createDataFrame(rows, "doc_id long, text string"))


def test_near_open_buckets(spark):
    """Pairs that only meet outside their centre's component are still linked."""
    common = prose(9, 100).split()
    rows = []
    for g in range(40):
        own = common[:62] + prose(500 + g, 40).split()
        rows += [(10 * g, " ".join(own)), (10 * g + 1, " ".join([*own[:-2], "q", "r"]))]
    check_near(spark.createDataFrame(rows, "doc_id long, text string"))


def test_near_empty_and_pipeline_stage(spark, sf_dir):
    docs = documents(spark, sf_dir)
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0
    kept = near_dedup.one_of_each(docs)
    root, _ = brute_components([(r.doc_id, r.text) for r in docs.collect()])
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root.values()))


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(k, f"text {k % 7}", 1, 2, 3, 4) for k in range(50)], "doc_id long, text string, group_size int, __sha int, __may int, __g int")
    for kept in (exact_dedup.distinct_documents(docs), near_dedup.one_of_each(docs)):
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == list(range(7))


def test_hub_with_many_links(spark):
    """All ids hang on one: the hub's links meet its minimum without a gathered group."""
    links = spark.createDataFrame([(7, 100 + k) for k in range(5000)] + [(3, 4999)], "a long, b long")
    got = {r.id: r.root for r in near_dedup.components(links).collect()}
    assert len(got) == 5002 and set(got.values()) == {3}


def test_stage_with_odd_rows(spark):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    root, _ = brute_components([(r.doc_id, r.text) for r in docs.where("doc_id is not null").collect()])
    kept = near_dedup.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [*set(root.values()), None]))
    assert near_dedup.one_of_each(docs.limit(0)).count() == 0
