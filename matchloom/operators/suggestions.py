"""Ranked improvement suggestions as a union of rule branches, and their application.

A branch may not use a bullet that an earlier one has taken, which is an anti-join in
branch order; one window at the end puts branches in order and cuts the list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rewriting import replace_opening, with_metric_tail

COLUMNS = "resume_id long, branch int, ord int, type string, section string, pos long, current_text string, improved_text string, impact string"


def _shaped(rows: DataFrame, branch: int, kind: str, section: str, impact: str) -> DataFrame:
    return rows.select(F.col("resume_id").cast("long").alias("resume_id"), F.lit(branch).alias("branch"), F.col("ord").cast("int").alias("ord"), F.lit(kind).alias("type"), F.lit(section).alias("section"), F.col("pos").cast("long").alias("pos"), "current_text", "improved_text", F.lit(impact).alias("impact"))


def _first(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy("resume_id").orderBy(*order))).where(F.col("ord") <= n)


def keyword_rows(missing: DataFrame, most: int = 2) -> DataFrame:
    """From (resume_id, keyword, rnk): the first missing keywords."""
    rows = _first(missing, most, F.asc("rnk"))
    return _shaped(rows.select("resume_id", "ord", F.lit(None).alias("pos"), F.lit("Skills section").alias("current_text"), F.col("keyword").alias("improved_text")), 1, "keyword", "skills", "high")


def verb_rows(bullets: DataFrame, openings, strong: list[str], most: int = 3, gerund_after: tuple[str, ...] = ()) -> DataFrame:
    """Bullets with a weak opening, in order, with a stronger verb."""
    first = F.regexp_replace(F.lower(F.try_element_at(F.split(F.trim("text"), "\\s+"), F.lit(1))), "[^a-z]", "")
    improved = F.when(~first.isin(strong), replace_opening(F.col("text"), openings, gerund_after))
    rows = bullets.withColumn("improved_text", improved).where(F.col("improved_text").isNotNull() & (F.col("improved_text") != F.col("text")))
    rows = _first(rows, most, F.asc("pos"))
    return _shaped(rows.select("resume_id", "ord", "pos", F.col("text").alias("current_text"), "improved_text"), 2, "action_verb", "experience", "medium")


def metric_rows(bullets: DataFrame, taken: DataFrame, has_metric: str, tails, other: str) -> DataFrame:
    """The first bullet without a metric that no earlier branch has taken."""
    used = taken.where("pos IS NOT NULL").select(F.col("resume_id").alias("__r"), F.col("pos").alias("__p"))
    free = bullets.where(~F.col("text").rlike(has_metric)).join(used, (F.col("resume_id") == F.col("__r")) & (F.col("pos") == F.col("__p")), "left_anti")
    rows = _first(free, 1, F.asc("pos")).withColumn("improved_text", with_metric_tail(F.col("text"), tails, other))
    return _shaped(rows.select("resume_id", "ord", "pos", F.col("text").alias("current_text"), "improved_text"), 3, "experience", "experience", "high")


def summary_rows(resumes: DataFrame, advice: str, least: int = 100) -> DataFrame:
    """Résumés (resume_id, summary) whose summary is short."""
    rows = resumes.where(F.length("summary") < least).select("resume_id", F.lit(1).alias("ord"), F.lit(None).alias("pos"), F.when(F.col("summary") == "", "(No summary)").otherwise(F.col("summary")).alias("current_text"), F.lit(advice).alias("improved_text"))
    return _shaped(rows, 4, "summary", "summary", "medium")


def structure_rows(scores: DataFrame, advice: str, below: int = 70) -> DataFrame:
    rows = scores.where(F.col("formatting") < below).select("resume_id", F.lit(1).alias("ord"), F.lit(None).alias("pos"), F.lit("Resume structure").alias("current_text"), F.lit(advice).alias("improved_text"))
    return _shaped(rows, 5, "formatting", "structure", "medium")


def ranked(branches: list[DataFrame], most: int = 6) -> DataFrame:
    """All branches with ``rank``: branch order, then the branch's own; ``most`` a résumé."""
    out = branches[0]
    for b in branches[1:]:
        out = out.unionByName(b)
    rank = F.row_number().over(Window.partitionBy("resume_id").orderBy("branch", "ord"))
    return out.withColumn("rank", rank).where(F.col("rank") <= most)


def applied(bullets: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Bullets after the suggestions for them; a stale one (its text has changed) does nothing.

    Applying the same suggestions twice is the same as once.
    """
    new = suggestions.where("pos IS NOT NULL").select(F.col("resume_id").alias("__r"), F.col("pos").alias("__p"), F.col("current_text").alias("__old"), "improved_text")
    rows = bullets.join(new, (F.col("resume_id") == F.col("__r")) & (F.col("pos") == F.col("__p")) & (F.col("text") == F.col("__old")), "left")
    return rows.select(*[c for c in bullets.columns if c != "text"], F.coalesce("improved_text", "text").alias("text"), F.col("improved_text").isNotNull().alias("changed"))


def skills_applied(skills: DataFrame, suggestions: DataFrame) -> DataFrame:
    """(resume_id, skill) after keyword suggestions: added unless there in any case."""
    have = skills.select(F.col("resume_id").alias("__r"), F.lower("skill").alias("__s")).distinct()
    add = suggestions.where("type = 'keyword'").select("resume_id", F.col("improved_text").alias("skill"))
    return skills.unionByName(add.join(have, (F.col("resume_id") == F.col("__r")) & (F.lower("skill") == F.col("__s")), "left_anti"))
