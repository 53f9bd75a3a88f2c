"""Exact de-duplication by two-pass Bloom filtering.

Every text is hashed once, into a written table of (id, SHA-256, length). Pass 1 reads
the hashes and records which filter bits at least two rows set. Each task first folds
its own rows, and sends the bit positions that they touch to the task that owns that
segment of the filter; a segment stays bounded however large the corpus is. Pass 2 tests
every row of the table against the filter of twice-set bits: rows whose text cannot
repeat pass straight through, the others shuffle, without their texts, and are grouped
by their full SHA-256.

The filter that executors receive is at most ``max_filter_mb``. Up to that bound it
has ``BITS_PER_ROW`` bits a row, which about 1.4 % of the unique rows pass wrongly;
beyond it (33 million rows at 64 MB) more unique rows join the shuffle, all of them from
some hundred million rows on. The result stays exact, and what shuffles are rows of the
table of hashes, about 90 bytes each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialise

BITS_PER_ROW = 16
SEGMENT_BITS = 1 << 20


def normalised(text: Column) -> Column:
    """The text without the characters of ``[\\x20\\x09-\\x0D]``; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", "")


def _positions(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two filter positions of each 64-bit key."""
    keys = keys.view(np.uint64)
    low, high = keys & np.uint64(0xFFFFFFFF), keys >> np.uint64(32)
    return ((low * np.uint64(bits)) >> np.uint64(32)).astype(np.int64), ((high * np.uint64(bits)) >> np.uint64(32)).astype(np.int64)


def _touched(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = [b.column(0).to_numpy(zero_copy_only=False) for b in batches]
        if not keys:
            return
        keys, times = np.unique(np.concatenate(keys), return_counts=True)
        first, second = _positions(keys, bits)
        # a repeated key sets its bits twice here already
        where = np.concatenate([first, second, first[times > 1], second[times > 1]])
        where, times = np.unique(where, return_counts=True)
        segment = where // SEGMENT_BITS
        starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        for a, b in zip(starts, [*starts[1:], len(where)], strict=True):
            inside = (where[a:b] % SEGMENT_BITS).astype(np.uint32)
            yield pa.record_batch({"segment": pa.array([int(segment[a])], pa.int64()), "once": pa.array([inside.tobytes()], pa.binary()), "twice": pa.array([inside[times[a:b] > 1].tobytes()], pa.binary())})

    return run


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All of a segment's rows stand in one task; a segment's counters are SEGMENT_BITS bytes."""
    counters: dict[int, np.ndarray] = {}
    for batch in batches:
        for segment, once, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            seen = counters.setdefault(segment, np.zeros(SEGMENT_BITS, np.uint8))
            at = np.frombuffer(once, np.uint32)
            seen[at] = np.minimum(seen[at] + 1, 2)
            seen[np.frombuffer(twice, np.uint32)] = 2
    for segment, seen in counters.items():
        yield pa.record_batch({"segment": pa.array([segment], pa.int64()), "bits": pa.array([np.packbits(seen > 1).tobytes()], pa.binary())})


def filter_bits(rows: int, max_filter_mb: int) -> int:
    return int(min(max(SEGMENT_BITS, rows * BITS_PER_ROW), max_filter_mb * 8_000_000, 2**32))


def possibly_repeated(keys: DataFrame, rows: int, max_filter_mb: int = 64):
    """Column function that tells whether a key of the one-column frame ``keys`` may occur twice."""
    bits = filter_bits(rows, max_filter_mb)
    n_segments = -(-bits // SEGMENT_BITS)
    touched = keys.mapInArrow(_touched(bits), "segment long, once binary, twice binary")
    merged = touched.repartition(n_segments, "segment").mapInArrow(_folded, "segment long, bits binary")
    whole = np.zeros(n_segments * SEGMENT_BITS // 8, np.uint8)
    for segment, part in merged.collect():  # the filter's own bytes, max_filter_mb at most
        whole[segment * SEGMENT_BITS // 8 :][: SEGMENT_BITS // 8] = np.frombuffer(part, np.uint8)
    sent = keys.sparkSession.sparkContext.broadcast(whole)

    @F.pandas_udf("boolean")
    def may_repeat(key: pd.Series) -> pd.Series:
        has = sent.value
        first, second = _positions(key.to_numpy(), bits)
        hit = [(has[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 for p in (first, second)]
        return pd.Series((hit[0] & hit[1]).astype(bool))

    return may_repeat


def _best(id_col: str) -> Column:
    """Smallest is the row that stays: longest text, then smallest id, null ids last."""
    return F.struct((-F.col("__len")).alias("len"), F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"))


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, __sha, __len) of every row, written once: all passes but that over the texts read these."""
    length = F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long")
    return materialise(docs.select(F.col(id_col), F.sha2(normalised(F.col(text_col)), 256).alias("__sha"), length.alias("__len")), "text-digests")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_filter_mb: int = 64) -> DataFrame:
    """One decision per row: id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty, so null, empty and blank texts are one group. A null id
    loses against any id. Rows that repeat an id and a text carry the same decision
    (``distinct_documents`` keeps one of them). Other columns are ignored, whatever
    their names. An empty table gives no rows.
    """
    rows = _digests(docs, id_col, text_col)
    may_repeat = possibly_repeated(rows.select(F.xxhash64("__sha")), rows.count(), max_filter_mb)
    tested = rows.withColumn("__may", may_repeat(F.xxhash64("__sha")))
    alone = tested.where(~F.col("__may")).select(id_col, F.col(id_col).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("__sha").alias("text_sha256"))
    maybe = tested.where("__may").drop("__may")
    groups = _groups(maybe, id_col)
    met = maybe.drop("__len").join(groups, F.col("__sha") == F.col("__g"), "left")
    keep = F.when(F.col("__g").isNull(), F.col(id_col)).otherwise(F.col("__best.id"))
    grouped = met.select(id_col, keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col(id_col).eqNullSafe(keep).alias("kept"), F.col("__sha").alias("text_sha256"))
    return alone.unionByName(grouped)


def _groups(maybe: DataFrame, id_col: str) -> DataFrame:
    """(__g, __best, group_size) of texts that do repeat, written down.

    So both sides of the join that follows are dealt by plain exchanges, and Spark can
    split the partition of a text that a large part of the rows have.
    """
    groups = maybe.groupBy(F.col("__sha").alias("__g")).agg(F.min(_best(id_col)).alias("__best"), F.count(F.lit(1)).alias("group_size"))
    return materialise(groups.where("group_size > 1"), "copy-groups")


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_filter_mb: int = 64) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns, whatever their names.

    Of equal texts the row of ``exact_dedup`` stays, once if it is repeated; null, empty
    and blank texts are one group; a row without an id stays only if no equal text has
    one. Groups are decided on digests. Of the texts only those pass a shuffle whose id
    may be in a group (a filter of ids); the row's own digest decides there. An empty
    table gives no rows.
    """
    from .id_filter import may_contain

    rows = _digests(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), "__id", "__text")
    may_repeat = possibly_repeated(rows.select(F.xxhash64("__sha")), rows.count(), max_filter_mb)
    maybe = rows.where(may_repeat(F.xxhash64("__sha")))
    groups = _groups(maybe, "__id")
    members = maybe.join(groups, F.col("__sha") == F.col("__g"), "left_semi").select("__id").distinct()
    whole = docs.select(F.struct(*docs.columns).alias("__row"), F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    tested = whole.withColumn("__may", may_contain(materialise(members, "copy-ids"), max_filter_mb)("__id"))
    length = F.char_length(F.coalesce(F.col("__text"), F.lit(""))).cast("long")
    own = tested.where("__may").select("__row", "__id", F.sha2(normalised(F.col("__text")), 256).alias("__sha"), length.alias("__len"))
    met = own.join(groups, F.col("__sha") == F.col("__g"), "left")
    stay = met.where(F.col("__g").isNotNull() & F.col("__id").eqNullSafe(F.col("__best.id")) & (-F.col("__len") == F.col("__best.len"))).dropDuplicates(["__sha"])
    return tested.where(~F.col("__may")).select("__row.*").unionByName(met.where("__g IS NULL").select("__row.*")).unionByName(stay.select("__row.*"))
