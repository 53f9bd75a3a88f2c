"""Lists of résumés with many bullets: no branch is made again for each bullet of another."""

import time

from pyspark.sql import functions as F

from matchloom.operators import suggestion_lists as s

STATE = "resume_id long, bullets array<string>, missing array<struct<rnk:int,keyword:string,weight:int>>, summary string, k int, a int, n_projects int"


def judged(spark, *rows):
    df = spark.createDataFrame([(k, *row) for k, row in enumerate(rows)], STATE).repartition(1)
    return df.withColumn("b", s.judged(F.col("bullets"), (("the ", "Led"),), ["led"], "[0-9]{2}|%", (), ", tail.", ())).localCheckpoint()


def test_six_rules_of_many_bullets(spark):
    """200 bullets, of which each may take a result and a verb: the fourth power would be over an hour."""
    rows = judged(spark, ([f"the {'a' * k} line" for k in range(200)], [(1, "go", 1)], "", 50, 50, 0), ([], [], "x" * 90, 90, 90, 1), (None, None, None, None, None, None))
    began = time.time()
    found = [(r.resume_id, r["rank"], r.type, r.pos) for r in s.exploded(s.six_rules(rows)).orderBy("resume_id", "rank").collect()]
    assert found == [(0, 1, "keyword", None), *[(0, k + 2, "metrics", 3 * k + 1) for k in range(5)]]
    assert time.time() - began < 30


def test_no_list_is_filtered_by_its_own_chain(spark):
    rows = judged(spark, (["the a"], [], "", 50, 50, 0))
    for made in (s.six_rules(rows), s.rule_engine(rows)):
        plan = s.exploded(made)._jdf.queryExecution().optimizedPlan().toString()
        assert not [x for x in plan.splitlines() if "Filter" in x and "concat" in x]
