"""Keywords placed in bullets by the list by evaluation: what is left out early would not be placed."""

import duckdb
from pyspark.sql import functions as F

from matchloom.operators import wording as w
from matchloom.plans import registry

BULLETS = ["Analyzed data using tables to show it", "Analyzed it", "built with care", "built using x, y and z to win", "wrote code of a system.more", "optimize the query • x", "led", "using", "is with ", "data.", "the end", "•", "rest with rest", "built a python thing", "x with a\tto b"]
KEYWORDS = ["tableau", "python", "rest", "thing", "git", "dashboards", "other", "built", "agile"]


def test_only_what_is_placed_low_is_left_out(spark):
    rows = spark.createDataFrame([(x, k) for x in BULLETS for k in KEYWORDS], "x string, k string")
    y = w.integrated(F.col("x"), F.col("k"), ["led", "built"])
    found = w.integrated(F.col("x"), F.col("k"), ["led", "built"], found=w.placing(F.col("x")))
    rows = rows.select("x", "k", y.alias("y"), found.alias("f"), w.may_be_placed(w.placing_signs(F.col("x")), w.keyword_kinds(F.col("k"))).alias("may")).collect()
    assert not [r for r in rows if not r.may and r.y.integrated and r.y.confidence != "low"]
    assert all(r.y == r.f for r in rows) and {r.may for r in rows} == {True, False}


def test_the_first_bullet_that_takes_a_keyword(spark, tmp_path):
    docs = [(k, "\n".join(["Summary", *BULLETS[k:], *BULLETS[:k]])) for k in range(len(BULLETS))] + [(99, "Summary"), (100, "")]
    spark.createDataFrame([(k, x, "s", 9) for k, x in docs], "doc_id long, text string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, " ".join(KEYWORDS)), (1, " ".join(KEYWORDS[::-1])), (2, "of")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    duck = duckdb.connect()
    for table in ("documents", "benchmark"):
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    got, want = registry.QUERIES["suggestions_by_evaluation"](spark, str(tmp_path)), duck.sql(registry.ORACLES["suggestions_by_evaluation"])
    place = [want.columns.index(c) for c in got.columns]
    rows = got.collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(str(tuple(r[i] for i in place)) for r in want.fetchall())
    assert [r for r in rows if r.type == "keyword-integration"] and [r for r in rows if r.type == "keyword"]


def test_placing_shuffles_no_bullets(spark, sf_dir):
    plan = registry.QUERIES["suggestions_by_evaluation"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "suggestion-state" not in plan and not [x for x in plan.splitlines() if "hashpartitioning" in x and "resume_id" in x]
