"""Matching of dictionaries in texts: boundary counts, section multipliers, buckets.

A dictionary is a small list in the plan, so a text is scanned in place and only finds
are exploded. Terms that are single words may be joined by tokens instead
(``matching.token_rows``), which is the form for dictionaries that grow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t


def boundary_finds(rows: DataFrame, key: str, text: str, terms: list[tuple[str, int]]) -> DataFrame:
    """(key, term, weight, n) of the terms that stand in the text as whole words, any case."""
    low = F.lower(F.col(text))
    finds = F.filter(F.array(*[F.struct(F.lit(term).alias("term"), F.lit(weight).alias("weight"), t.count_word(F.col("__low"), term).alias("n")) for term, weight in terms]), lambda x: x["n"] > 0)
    return rows.select(key, low.alias("__low")).select(key, F.explode(finds).alias("f")).select(key, "f.*")


def section_weighted(rows: DataFrame, key: str, text: str, terms: list[tuple[str, int]], required: str, preferred: str, window: int) -> DataFrame:
    """(key, term, points): ten times weight * count * multiplier; 1.5 behind the required cue, 0.8 behind the preferred one."""
    low = F.lower(F.col(text))
    behind = lambda cue: F.when(F.instr(low, cue) > 0, F.substring(low, F.instr(low, cue), F.lit(window))).otherwise("")
    base = rows.select(key, low.alias("__low"), behind(required).alias("__req"), behind(preferred).alias("__pre"))

    def find(term: str, weight: int) -> Column:
        factor = F.when(F.contains("__req", F.lit(term)), 15).when(F.contains("__pre", F.lit(term)), 8).otherwise(10)
        return F.struct(F.lit(term).alias("term"), (t.count_word(F.col("__low"), term) * weight * factor).alias("points"))

    finds = F.filter(F.array(*[find(term, weight) for term, weight in terms]), lambda x: x["points"] > 0)
    return base.select(key, F.explode(finds).alias("f")).select(key, "f.*")


def bucket(keyword: Column, buckets: list[tuple[str, list[str]]], default: str) -> Column:
    """The first bucket with a term that the keyword contains."""
    out = F.lit(default)
    for name, terms in reversed(buckets):
        hit = F.lit(False)
        for term in terms:
            hit = hit | F.contains(keyword, F.lit(term))
        out = F.when(hit, name).otherwise(out)
    return out


def first_distinct(tokens: Column, k: int) -> Column:
    return F.slice(F.array_distinct(tokens), 1, k)


def with_cues(finds: Column, critical: list[str], high: list[str]) -> Column:
    """``critical``, ``high`` or ``normal`` from cue words in the contexts of a keyword."""
    has = lambda words: F.exists(finds, lambda c: sum((F.contains(F.lower(c), F.lit(w)).cast("int") for w in words), F.lit(0)) > 0)
    return F.when(has(critical), "critical").when(has(high) | (F.size(finds) >= 3), "high").otherwise("normal")


def contained_keywords(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, keyword, other, how): keywords of one list in another by equality, else by containment either way; the first by order."""
    a = left.select(key, "keyword", F.col("ord").alias("__o"))
    b = right.select(F.col(key).alias("__k"), F.col("keyword").alias("other"), F.col("ord").alias("__p"))
    met = a.join(b, F.col(key) == F.col("__k"))
    how = F.when(F.col("keyword") == F.col("other"), 1).when(F.contains("keyword", F.col("other")), 2).when(F.contains("other", F.col("keyword")), 3)
    met = met.withColumn("how", how).where("how IS NOT NULL")
    best = F.row_number().over(Window.partitionBy(key, "keyword").orderBy("how", "__p"))
    return met.withColumn("__n", best).where("__n = 1").select(key, "keyword", "other", "how")
