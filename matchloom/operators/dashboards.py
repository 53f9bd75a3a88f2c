"""Operators of the dashboards: latest rows, pages, histograms, trends, feeds, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(rows: DataFrame, key: str, when: str, tie: str, n: int = 1) -> DataFrame:
    """The ``n`` latest rows of each key, numbered by ``recency`` (1: latest); ``tie`` ascending."""
    order = Window.partitionBy(key).orderBy(F.col(when).desc(), F.col(tie))
    return rows.withColumn("recency", F.row_number().over(order)).where(F.col("recency") <= n)


def with_latest(left: DataFrame, reports: DataFrame, key: str, when: str, tie: str, columns: list[str]) -> DataFrame:
    """Left join of the latest report of each key."""
    newest = latest_per_key(reports, key, when, tie).select(F.col(key).alias("__key"), *columns)
    return left.join(newest, F.col(key) == F.col("__key"), "left").drop("__key")


def with_owner(rows: DataFrame, users: DataFrame, missing: str = "Unknown User") -> DataFrame:
    """Left join of the owner's name and email; ``missing`` where there is none."""
    owner = users.select(F.col("user_id").alias("__u"), F.col("name").alias("owner_name"), F.col("email").alias("owner_email"))
    return rows.join(owner, F.col("user_id") == F.col("__u"), "left").withColumn("owner_name", F.coalesce("owner_name", F.lit(missing))).drop("__u")


def with_count(left: DataFrame, right: DataFrame, key: str, name: str) -> DataFrame:
    """``left`` with the number of rows of ``right`` for its key, 0 where there is none."""
    counts = right.groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("__n"))
    return left.join(counts, F.col(key) == F.col("__key"), "left").withColumn(name, F.coalesce("__n", F.lit(0))).drop("__key", "__n")


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Rows of page ``number`` (from 1); sorts no more than it must keep."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def page_count(rows: DataFrame, size: int) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("total"), F.ceil(F.count(F.lit(1)) / size).alias("pages"))


def one_decimal(value: Column) -> Column:
    """Half up to one decimal, as an exact decimal."""
    return (F.floor(value * 10 + 0.5) / 10).cast("decimal(18,1)")


def histogram(rows: DataFrame, value: str, edges: list[int]) -> DataFrame:
    """Counts in [e0, e1], (e1, e2], ...; buckets without rows count 0; share in per cent."""
    spark = rows.sparkSession
    bucket = F.lit(None).cast("int")
    for k in range(len(edges) - 2, -1, -1):
        low = F.col(value) >= edges[0] if k == 0 else F.col(value) > edges[k]
        bucket = F.when(low & (F.col(value) <= edges[k + 1]), k).otherwise(bucket)
    counts = rows.select(bucket.alias("bucket")).where("bucket IS NOT NULL").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    every = spark.createDataFrame([(k, f"{edges[k] + (k > 0)}-{edges[k + 1]}") for k in range(len(edges) - 1)], "bucket int, label string")
    out = every.join(counts, "bucket", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("share", one_decimal(F.coalesce(F.try_divide(F.col("n") * 100, F.sum("n").over(Window.partitionBy())), F.lit(0))))


def monthly(rows: DataFrame, when: str) -> DataFrame:
    return rows.groupBy(F.year(when).alias("year"), F.month(when).alias("month")).agg(F.count(F.lit(1)).alias("n"), F.date_format(F.min(when), "MMM").alias("label"))


def feed(branches: list[DataFrame], per_branch: int, total: int) -> DataFrame:
    """Union of the newest ``per_branch`` rows (kind, item_id, happened) of each branch, newest ``total`` in all."""
    out = None
    for rows in branches:
        part = rows.orderBy(F.desc("happened"), "item_id").limit(per_branch)
        out = part if out is None else out.unionByName(part)
    return out.orderBy(F.desc("happened"), "kind", "item_id").limit(total)


def merged(snapshot: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Snapshot after upserts: a change's null field keeps the old value; new keys are added."""
    fields = [c for c in snapshot.columns if c != key]
    new = changes.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in fields])
    out = snapshot.join(new, F.col(key) == F.col("__key"), "full_outer")
    return out.select(F.coalesce(key, "__key").alias(key), *[F.coalesce(f"__{c}", c).alias(c) for c in fields])


def without_keys(snapshot: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return snapshot.join(keys.select(key), key, "left_anti")


def counters_added(snapshot: DataFrame, events: DataFrame, key: str, counter: str) -> DataFrame:
    """The counter plus the number of the key's events."""
    return with_count(snapshot, events, key, "__more").withColumn(counter, F.col(counter) + F.col("__more")).drop("__more")


def first_of(rows: DataFrame, keys: list[Column], order: list[Column], rank: str = "__first") -> DataFrame:
    """The first row of each group by ``order``."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) == 1).drop(rank)


def top_k(rows: DataFrame, group: str, order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col(rank) <= k)
