"""A bounded Bloom filter of ids, so that only rows of listed documents shuffle."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exact_dedup import SEGMENT_BITS, _folded, _positions, _touched, filter_bits


def _bits(keys: DataFrame, rows: int, max_filter_mb: int):
    import numpy as np

    bits = filter_bits(rows, max_filter_mb)
    n_segments = -(-bits // SEGMENT_BITS)
    # each key is sent twice, so the twice-set bits of pass 1 are the bits of a plain filter
    merged = keys.unionByName(keys).mapInArrow(_touched(bits), "segment long, once binary, twice binary").repartition(n_segments, "segment").mapInArrow(_folded, "segment long, bits binary")
    whole = np.zeros(n_segments * SEGMENT_BITS // 8, np.uint8)
    for segment, part in merged.collect():  # the filter's own bytes, max_filter_mb at most
        whole[segment * SEGMENT_BITS // 8 :][: SEGMENT_BITS // 8] = np.frombuffer(part, np.uint8)
    return whole, bits


def may_contain(ids: DataFrame, max_filter_mb: int = 64):
    """Function of a column: false only where the one-column frame ``ids`` lacks the value."""
    keys = ids.select(F.xxhash64(ids.columns[0]).alias("key"))
    whole, bits = _bits(keys, keys.count(), max_filter_mb)
    sent = ids.sparkSession.sparkContext.broadcast(whole)

    @F.pandas_udf("boolean")
    def test(key: pd.Series) -> pd.Series:
        has = sent.value
        first, second = _positions(key.to_numpy(), bits)
        hit = [(has[p >> 3] >> (7 - (p & 7)).astype("uint8")) & 1 for p in (first, second)]
        return pd.Series((hit[0] & hit[1]).astype(bool))

    def column(name: str) -> Column:
        return test(F.xxhash64(name))

    return column


def without(rows: DataFrame, dropped: DataFrame, id_col: str) -> DataFrame:
    """``rows`` but those whose id is in ``dropped``; only rows that may be there shuffle.

    Rows without an id stay. Columns stay as they are, whatever their names.
    """
    whole = rows.select(F.struct(*rows.columns).alias("__row"), F.col(id_col).alias("__id"))
    tested = whole.withColumn("__may", may_contain(dropped)("__id"))
    gone = dropped.select(F.col(dropped.columns[0]).alias("__gone"))
    stay = tested.where("__may").join(gone, F.col("__id") == F.col("__gone"), "left_anti")
    return tested.where(~F.col("__may")).select("__row.*").unionByName(stay.select("__row.*"))
