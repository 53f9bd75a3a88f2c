"""Stream operators over an access log (key, ts, action)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.store import fresh_path


def over_limit(events: DataFrame, width: str, most: int, late: str | None = "1 hour") -> DataFrame:
    """(key, start, n) of windows with more than ``most`` events; rows behind the watermark are dropped."""
    if late is not None:
        events = events.withWatermark("ts", late)
    counts = events.groupBy(F.window("ts", width).alias("w"), "key").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") > most).select("key", F.col("w.start").alias("start"), "n")


ACCEPTED = T.StructType([T.StructField("key", T.StringType()), T.StructField("ts", T.TimestampType())])
LAST = T.StructType([T.StructField("last", T.LongType())])


def suppress_repeats(events: DataFrame, gap_seconds: float) -> DataFrame:
    """(key, ts) of accepted events: the first, then each one ``gap_seconds`` or more after the last accepted.

    Repeats do not extend the wait. State is the last accepted time of a key. Events of a
    micro-batch are taken by time; those older than the last accepted one are repeats.
    """
    gap = int(gap_seconds * 1_000_000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        times = sorted(t for f in frames for t in f["ts"].astype("datetime64[us]").astype("int64").tolist())
        taken = []
        for t in times:
            if last is None or t - last >= gap:
                last = t
                taken.append(t)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({"key": [str(key[0])] * len(taken), "ts": pd.to_datetime(taken, unit="us")})

    return events.select(F.col("key").cast("string").alias("key"), "ts").groupBy("key").applyInPandasWithState(step, ACCEPTED, LAST, "append", "NoTimeout")


def accepted_in_batch(events: DataFrame, gap_seconds: float) -> DataFrame:
    """The batch twin of ``suppress_repeats``, by a fold over runs of a key's times.

    A time that is ``gap_seconds`` or more behind the one before it is accepted whatever was
    accepted before, so it begins a run of its own, and only runs are gathered.
    """
    gap = int(gap_seconds * 1_000_000)
    by_time = Window.partitionBy("key").orderBy("u")
    rows = events.select(F.col("key").cast("string").alias("key"), F.unix_micros("ts").alias("u"))
    rows = rows.withColumn("first", F.coalesce((F.col("u") - F.lag("u").over(by_time) >= gap).cast("int"), F.lit(1)))
    rows = rows.withColumn("run", F.sum("first").over(by_time.rowsBetween(Window.unboundedPreceding, 0)))
    times = rows.groupBy("key", "run").agg(F.array_sort(F.collect_list("u")).alias("t"))
    kept = F.aggregate("t", F.array().cast("array<bigint>"), lambda s, x: F.when((F.size(s) == 0) | (x - F.try_element_at(s, F.lit(-1)) >= gap), F.concat(s, F.array(x))).otherwise(s))
    return times.select("key", F.explode(kept).alias("u")).select("key", F.timestamp_micros("u").alias("ts"))


def latest_scores(reports: DataFrame, key: str = "resume_id") -> DataFrame:
    """Running latest report of each key (update mode): (key, created_at, report_id, total_score)."""
    best = F.max(F.struct("created_at", (-F.col("report_id")).alias("r"), "total_score")).alias("b")
    return reports.groupBy(key).agg(best).select(key, F.col("b.created_at").alias("created_at"), (-F.col("b.r")).alias("report_id"), F.col("b.total_score").alias("total_score"))


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """A file stream over the Parquet files of ``path`` (a folder or one file)."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path if not path.endswith(".parquet") else path[:-1] + "[t]")


def batch_writer(out: str) -> Callable[[DataFrame, int], None]:
    """Writes each micro-batch over its own partition of ``out``: a batch that is run again stands there once."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return put


def drained(rows: DataFrame, mode: str, name: str, final: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run the stream over all that is there and return what it emitted.

    In update mode each batch's rows carry ``batch``; ``final`` takes the last ones.
    """
    spark = rows.sparkSession
    out, mark = fresh_path(spark, name), fresh_path(spark, f"{name}-checkpoint")

    query = rows.writeStream.outputMode(mode).foreachBatch(batch_writer(out)).option("checkpointLocation", mark).trigger(availableNow=True).start()
    query.awaitTermination()
    schema = T.StructType([*rows.schema.fields, T.StructField("batch", T.IntegerType())])
    told = spark.read.schema(schema).parquet(out)
    return (final(told) if final else told).drop("batch")
