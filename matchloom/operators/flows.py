"""Compositions of several operators: text builders, apply and score again, generic scores, display lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t


def built_text(parts: list[Column], normalise=None) -> Column:
    """Filled parts in order, joined by spaces; array parts are flattened first."""
    out = F.concat_ws(" ", *[F.when(F.trim(p) != "", F.trim(p)) for p in parts])
    return normalise(out) if normalise else out


def lines_of(bullets: DataFrame, summaries: DataFrame) -> DataFrame:
    """(resume_id, lines) again from (resume_id, pos, text) and (resume_id, summary); places decide the order."""
    rows = bullets.groupBy(F.col("resume_id").alias("__r")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("b"))
    met = summaries.join(rows, F.col("resume_id") == F.col("__r"), "left")
    own = F.when(F.col("summary") == "", F.array().cast("array<string>")).otherwise(F.array("summary"))
    return met.select("resume_id", F.concat(own, F.coalesce("b", F.array().cast("array<string>"))).alias("lines"))


def score_difference(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """(resume_id, old and new values and differences) of score columns."""
    new = after.select(F.col("resume_id").alias("__r"), *[F.col(c).alias(f"new_{c}") for c in columns])
    met = before.join(new, F.col("resume_id") == F.col("__r"))
    return met.select("resume_id", *[F.col(c).alias(f"old_{c}") for c in columns], *[f"new_{c}" for c in columns], *[(F.col(f"new_{c}") - F.col(c)).alias(f"delta_{c}") for c in columns])


def unapplied(suggestions: DataFrame, applied: DataFrame) -> DataFrame:
    """Suggestions whose normalised text is not in the history ``applied`` (text)."""
    seen = applied.select(t.comparable(F.col("text")).alias("__t")).distinct()
    return suggestions.join(seen, t.comparable(F.col("current_text")) == F.col("__t"), "left_anti")


def is_skill(item: Column) -> Column:
    """A skill, not a sentence: at most 4 words and 40 characters, and no final stop."""
    return (F.size(F.split(F.trim(item), "\\s+")) <= 4) & (F.length(item) <= 40) & ~item.rlike("[.!?]$")


def domain_priority(missing: DataFrame, domain_terms: list[str], technical: str) -> DataFrame:
    """Missing keywords with a place by domain (+10), length (+0.5 a character), technical look (+5) and order (-0.5)."""
    points = F.when(F.col("keyword").isin(domain_terms), 20).otherwise(0) + F.length("keyword") + F.when(F.col("keyword").rlike(technical), 10).otherwise(0) - (F.col("rnk") - 1)
    place = F.row_number().over(Window.partitionBy("resume_id").orderBy(F.desc("points"), "rnk"))
    return missing.withColumn("points", points).withColumn("place", place)


def two_buckets(rows: DataFrame, high: Column, n_high: int, n_rest: int) -> DataFrame:
    """At most ``n_high`` rows where ``high`` holds and ``n_rest`` others a résumé, by rnk."""
    rows = rows.withColumn("bucket", F.when(high, "high").otherwise("medium"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("resume_id", "bucket").orderBy("rnk")))
    return rows.where(F.when(F.col("bucket") == "high", F.col("place") <= n_high).otherwise(F.col("place") <= n_rest))


def generic_score(tokens: DataFrame, roles: DataFrame, voted: DataFrame) -> DataFrame:
    """(resume_id, role, percent, label): share of the voted role's terms that occur, against benchmarks."""
    terms = roles.select(F.col("role").alias("__role"), "term")
    wanted = voted.select("resume_id", "role").join(terms, F.col("role") == F.col("__role"))
    own = tokens.select(F.col("resume_id").alias("__r"), F.col("token").alias("__t")).distinct()
    met = wanted.join(own, (F.col("resume_id") == F.col("__r")) & (F.col("term") == F.col("__t")), "left")
    out = met.groupBy("resume_id", "role").agg(t.rounded(F.count("__t") * 100 / F.count(F.lit(1))).alias("percent"))
    return out.withColumn("label", F.when(F.col("percent") >= 100, "top").when(F.col("percent") >= 50, "average").otherwise("low"))


def recommendations(components: DataFrame, rules: list[tuple[str, str, int]]) -> DataFrame:
    """(resume_id, place, advice) of the rules (condition, advice, priority) that hold, most urgent first."""
    told = F.filter(F.array(*[F.when(F.expr(test), F.struct(F.lit(priority).alias("priority"), F.lit(k).alias("ord"), F.lit(advice).alias("advice"))) for k, (test, advice, priority) in enumerate(rules)]), lambda x: x.isNotNull())
    return components.select("resume_id", F.posexplode(F.array_sort(told)).alias("place", "x")).select("resume_id", (F.col("place") + 1).alias("place"), "x.advice")


def flat_form(resumes: DataFrame) -> DataFrame:
    """One row per résumé: nested experience and skills as joined texts."""
    return resumes.select("resume_id", F.array_join(F.transform("experience", lambda e: F.concat_ws(" | ", e["role"], e["company"])), "; ").alias("jobs"), F.array_join(F.flatten(F.transform("skills", lambda s: s["items"])), ", ").alias("skills"))


def nested_form(flat: DataFrame) -> DataFrame:
    """``flat_form`` back to nested columns; skills are one group."""
    jobs = F.filter(F.transform(F.split("jobs", "; "), lambda x: F.struct(F.get(F.split(x, " \\| "), F.lit(0)).alias("role"), F.get(F.split(x, " \\| "), F.lit(1)).alias("company"))), lambda x: x["role"] != "")
    items = F.filter(F.transform(F.split("skills", ","), lambda x: F.trim(x)), lambda x: x != "")
    return flat.select("resume_id", jobs.alias("experience"), F.array(F.struct(F.lit("General").alias("category"), items.alias("items"))).alias("skills"))
