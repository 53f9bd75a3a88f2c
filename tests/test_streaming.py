"""Streams over several micro-batches, and their batch twins."""

import datetime
import time

from pyspark.sql import functions as F

from matchloom.streaming import access as a

START = datetime.datetime(2024, 1, 1)


def written(spark, path, batches):
    for seconds in batches:  # files are taken by their time
        rows = [("k", START + datetime.timedelta(seconds=s)) for s in seconds]
        spark.createDataFrame(rows, "key string, ts timestamp").coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    return spark.readStream.schema("key string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)


def seconds(rows):
    return sorted(int((r.ts - START).total_seconds()) for r in rows)


def test_repeats_keep_their_state_across_batches(spark, tmp_path):
    path = str(tmp_path / "in")
    stream = written(spark, path, [[0, 1, 2, 3], [3, 4, 5], [9]])
    got = seconds(a.drained(a.suppress_repeats(stream, 2), "append", "t").collect())
    batch = seconds(a.accepted_in_batch(spark.read.parquet(path), 2).collect())
    assert got == batch == [0, 2, 4, 9]


def test_limits_count_over_batches_and_drop_late_rows(spark, tmp_path):
    path = str(tmp_path / "in")
    stream = written(spark, path, [[0, 10, 20], [30, 7200], [7201], [40, 7202]])
    told = a.drained(a.over_limit(stream, "15 minutes", 2, "10 minutes"), "update", "t")
    most = {r.start: r.n for r in told.groupBy("start").agg(F.max("n").alias("n")).collect()}
    assert most[START] == 4  # the row at 40 s comes two batches after the watermark has passed


def test_latest_scores_follow_the_stream(spark, tmp_path):
    path = str(tmp_path / "in")
    for k, score in enumerate((10, 30, 20)):
        spark.sql(f"SELECT 1L AS resume_id, {k}L AS report_id, TIMESTAMP '2024-01-0{k + 1}' AS created_at, {score}L AS total_score").write.mode("append").parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    told = a.drained(a.latest_scores(stream), "update", "t")
    assert told.orderBy(F.desc("created_at")).first().total_score == 20


def test_a_replayed_batch_stands_once(spark, tmp_path):
    put, out = a.batch_writer(str(tmp_path / "out")), str(tmp_path / "out")
    for number, n in ((0, 3), (1, 2), (1, 2), (0, 3)):
        put(spark.range(n), number)
    assert {r.batch: r["count"] for r in spark.read.parquet(out).groupBy("batch").count().collect()} == {0: 3, 1: 2}
