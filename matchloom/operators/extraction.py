"""Keyword extraction from requirement texts, section parsing, canonical keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t


def candidates(rows: DataFrame, key: str, text: str, stop: list[str], normalise=t.strip_markup) -> DataFrame:
    """(key, keyword, ord): neighbouring pairs of content words, then the words, each once in order."""
    words = F.filter(t.tokens(normalise(F.col(text))), lambda x: ~x.isin(stop))
    grams = F.array_distinct(F.concat(t.ngrams(F.col("__w"), 2), F.col("__w")))
    out = rows.select(key, words.alias("__w")).select(key, F.posexplode(grams).alias("ord", "keyword"))
    return out.select(key, "keyword", "ord")


def candidate_points(keyword: Column, groups) -> Column:
    """Ten times: 2 a word, 0.1 a character, and the points of every pattern group that matches."""
    out = F.size(F.split(keyword, " ")) * 20 + F.length(keyword)
    for pattern, points in groups:
        out = out + F.when(keyword.rlike(pattern), points * 10).otherwise(0)
    return out


def ranked_candidates(found: DataFrame, key: str, groups, k: int) -> DataFrame:
    scored = found.withColumn("points", candidate_points(F.col("keyword"), groups))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("points"), "ord"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select(key, "keyword", "points", "rank")


def frequent_phrases(rows: DataFrame, key: str, text: str, stop: list[str], least: int = 4) -> DataFrame:
    """(key, keyword, frequency, score, ord): content words and their pairs, counted in the text; score favours pairs."""
    words = t.tokens(t.words_only(F.col(text)))
    posed = rows.select(key, F.posexplode(words).alias("ord", "w"), words.alias("ws"))
    both = F.array(F.col("w"), F.concat("w", F.lit(" "), F.get("ws", F.col("ord") + 1)))
    grams = posed.select(key, "ord", F.explode(both).alias("keyword")).where("keyword IS NOT NULL")
    keep = F.forall(F.split("keyword", " "), lambda x: (F.length(x) >= least) & ~x.isin(stop))
    counts = grams.where(keep).groupBy(key, "keyword").agg(F.count(F.lit(1)).alias("frequency"), F.min("ord").alias("ord"))
    return counts.withColumn("score", F.col("frequency") * F.size(F.split("keyword", " ")))


def categorised(keywords: DataFrame, categories: list[tuple[str, list[str]]], default: str = "general") -> DataFrame:
    """With ``category``: the first whose terms contain the keyword or are contained in it."""
    out = F.lit(default)
    for name, terms in reversed(categories):
        hit = F.lit(False)
        for term in terms:
            hit = hit | F.col("keyword").contains(term) | F.contains(F.lit(term), F.col("keyword"))
        out = F.when(hit, name).otherwise(out)
    return keywords.withColumn("category", out)


def with_importance(keywords: DataFrame, text: str, required: str, optional: str, window: int = 1000) -> DataFrame:
    """``importance`` from frequency and from the ``window`` characters behind two cue words; the optional cue has the last word."""
    low = F.lower(text)
    behind = lambda cue: F.when(F.instr(low, cue) > 0, F.substring(low, F.instr(low, cue), F.lit(window)))
    inside = lambda cue: F.coalesce(F.contains(behind(cue), F.col("keyword")), F.lit(False))
    return keywords.withColumn("importance", F.when(inside(optional), "Nice_to_have").when(inside(required) | (F.col("frequency") >= 3), "Critical").when(F.col("frequency") == 2, "Important").otherwise("Nice_to_have"))


def without_synonyms(keywords: DataFrame, key: str, synonyms: dict[str, list[str]]) -> DataFrame:
    """The best keyword of each synonym group; ``score`` and ``ord`` decide."""
    canonical = F.col("keyword")
    for name, forms in reversed(synonyms.items()):
        canonical = F.when(F.col("keyword").isin(forms), name).otherwise(canonical)
    first = F.row_number().over(Window.partitionBy(key, "canonical").orderBy(F.desc("score"), "ord", "keyword"))
    return keywords.withColumn("canonical", canonical).withColumn("__n", first).where("__n = 1").drop("__n")


def canonical_keywords(rows: DataFrame, key: str, ignored: list[str], names: dict[str, str], technical: dict[str, list[str]]) -> DataFrame:
    """(key, keyword, priority, category, is_technical) of (key, keyword, ord): ignored and short ones go, each once.

    Priority is .8 for technical keywords and .3 for others; the first in order wins.
    """
    low = F.lower(F.trim("keyword"))
    terms = sorted({x for v in technical.values() for x in v})
    shown = F.lit(None).cast("string")
    for raw, name in names.items():
        shown = F.when(low == raw, name).otherwise(shown)
    kept = rows.where(~low.isin(ignored)).withColumn("__shown", F.coalesce(shown, F.when((F.length(low) >= 3) | low.isin(terms), F.col("keyword")))).where("__shown IS NOT NULL")
    first = F.row_number().over(Window.partitionBy(key, F.lower("__shown")).orderBy("ord"))
    kept = kept.withColumn("__n", first).where("__n = 1")
    category = F.lit(None).cast("string")
    for name, own in reversed(technical.items()):
        category = F.when(F.lower("__shown").isin(own), name).otherwise(category)
    is_technical = F.lower("__shown").isin(terms)
    return kept.select(key, F.col("__shown").alias("keyword"), F.when(is_technical, 8).otherwise(3).alias("priority_tenths"), category.alias("category"), is_technical.alias("is_technical"))


def section_items(lines: DataFrame, key: str, header: str, item: str, end: str, k: int) -> DataFrame:
    """(key, place, text) of the items below header lines, to the next end line; at most ``k``.

    ``lines``: key, pos, text. The state across lines is a running last of header (1) and
    end (0) marks. A header opens a section and is no item itself.
    """
    mark = F.when(F.col("text").rlike(header), 1).when(F.col("text").rlike(end), 0)
    order = Window.partitionBy(key).orderBy("pos")
    rows = lines.withColumn("__mark", mark).withColumn("__open", F.last("__mark", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = rows.where((F.col("__open") == 1) & F.col("__mark").isNull() & F.col("text").rlike(item))
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select(key, "place", "text")


def first_match(text: Column, patterns: list[str], default: str) -> Column:
    """The first group of the first pattern that finds one."""
    found = [F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit("")) for p in patterns]
    return F.coalesce(*found, F.lit(default))


def labelled(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The label of the first pattern that matches."""
    out = F.lit(default)
    for pattern, label in reversed(rules):
        out = F.when(text.rlike(pattern), label).otherwise(out)
    return out


def distinct_skills(sources: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """Per key and source: skills that the source is the first to name; ``sources`` in order, (key, skill)."""
    rows = None
    for k, (name, part) in enumerate(sources):
        part = part.select(key, F.lower(F.trim("skill")).alias("skill"), F.lit(k).alias("ord"), F.lit(name).alias("source")).where("skill <> ''")
        rows = part if rows is None else rows.unionByName(part)
    first = rows.groupBy(key, "skill").agg(F.min(F.struct("ord", "source")).alias("b"))
    return first.groupBy(key, F.col("b.source").alias("source")).agg(F.count(F.lit(1)).alias("n"))
