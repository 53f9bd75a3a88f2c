"""Counts that are made in a résumé's row, where rows share an id or have none."""

import duckdb
import pytest

from matchloom.operators import matching as m
from matchloom.plans import registry

TEXTS = [(1, "the rest thing rest thing the rest"), (1, "rest thing thimg words"), (2, "the rest the rest"), (3, "restings ther things"), (None, "the rest of it"), (4, None)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("ids"))
    rows = [(k, x, "s", 9) for k, x in TEXTS]
    spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(0, "rest thing resting"), (1, "other things")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_pairs_of_repeated_ids(spark, tables):
    pairs = [(k, f"{a} {b}") for k, x in TEXTS for words in [(x or "").split()] for a, b in zip(words, words[1:], strict=False)]
    want = {(g, sum(x == g for _, x in pairs), len({k for k, x in pairs if x == g and k is not None})) for _, g in pairs}
    assert {tuple(r) for r in registry.QUERIES["bigram_counts"](spark, tables).collect()} == want


def test_candidates_of_repeated_ids(spark, tables, name="all_pair_candidates"):
    duck = duckdb.connect()
    for table in ("documents", "benchmark"):
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tables}/{table}.parquet/*.parquet'")
    got = registry.QUERIES[name](spark, tables)
    want = duck.sql(registry.ORACLES[name])
    place = [want.columns.index(c) for c in got.columns]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(tuple(r[i] for i in place)) for r in want.fetchall())


def test_counts_by_id_shuffle_no_id_that_stands_once(spark, tables):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k long, x string")
    assert m.by_repeated_key(rows, rows.select("k"), "k") == (rows, None)
    plan = registry.QUERIES["bigram_counts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "hashpartitioning" in x and "resume_id" in x]
