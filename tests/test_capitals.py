"""Queries of rewritten bullets against their SQL, where a capital has more characters than its small letter."""

import duckdb
import pytest

from matchloom.plans import registry

LINES = ["Summary", "in ßab 12", "de ﬁne", "İn one", "the ŉo", "ßa ßa b", "and ǰx", "In ΐ", "the end"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("capitals"))
    spark.createDataFrame([(1, "\n".join(LINES), "s", 9), (2, "Summary\nthan ßc", "s", 9)], "doc_id long, text string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(0, "requirement of rest"), (1, "other")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


@pytest.mark.parametrize("name", ["bullet_rewrites", "longest_openings", "bullet_cleaned", "suggestions_applied", "applied_and_scored", "suggestions_staged"])
def test_long_capitals(spark, tables, name):
    duck = duckdb.connect()
    for table in ("documents", "benchmark"):
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tables}/{table}.parquet/*.parquet'")
    got = registry.QUERIES[name](spark, tables)
    want = duck.sql(registry.ORACLES[name])
    place = [want.columns.index(c) for c in got.columns]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(tuple(r[i] for i in place)) for r in want.fetchall())


def test_the_capital_of_sharp_s(spark, tables):
    found = {r.rewritten for r in registry.QUERIES["bullet_rewrites"](spark, tables).collect()}
    assert {"Ran SSab 12", "Made FIne", "Drove SSc"} <= found and not any("one" in x for x in found)


def test_spaces_of_any_width_and_new_capitals(spark, tmp_path):
    lines = ["Summary", "in \u00a0ab 12", "the x\u3000", "\u2003de z", "in \u019bab", "in \u0264ab", "and \U00010d70ab", "\u00a0"]
    spark.createDataFrame([(1, "\n".join(lines), "s", 9)], "doc_id long, text string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    spark.createDataFrame([(0, "requirement of rest")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    duck.sql(f"CREATE VIEW benchmark AS SELECT * FROM '{tmp_path}/benchmark.parquet/*.parquet'")
    for name in ("bullet_rewrites", "longest_openings", "suggestions_staged"):
        got = registry.QUERIES[name](spark, str(tmp_path))
        want = duck.sql(registry.ORACLES[name])
        place = [want.columns.index(c) for c in got.columns]
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(tuple(r[i] for i in place)) for r in want.fetchall())
    found = {r.rewritten for r in registry.QUERIES["bullet_rewrites"](spark, str(tmp_path)).collect()}
    assert found == {"Ran Ab 12", "Led X", "Made Z", "Ran \ua7dcab", "Ran \ua7cbab", "Built \U00010d50ab"}
