"""Composite scores by profile, tiers, feedback, and match methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t

_JOB = "(0.4 * k + 0.2 * f + 0.2 * c + 0.1 * a + 0.1 * r)"
_GENERAL = "(0.3 * f + 0.3 * c + 0.2 * a + 0.2 * r)"
_LIFTED = "CASE WHEN {0} < 30 THEN least({0} * 1.2, 30) ELSE {0} END"
_ROUND = "floor({0} + 0.5)"

#: Totals from k (keywords), f (formatting), c (completeness), a (verbs), r (readability), each 0 to 100; has_jd tells the mode.
TOTALS = {
    "plain": _ROUND.format(_JOB),
    "null_without_keywords": f"CASE WHEN has_jd THEN {_ROUND.format(_JOB)} END",
    "equal_mean": _ROUND.format("((k + f + c + a + r) / 5.0)"),
    "production": f"CASE WHEN has_jd THEN {_ROUND.format('(0.4 * k + 0.25 * c + 0.15 * f + 0.1 * a + 0.1 * r)')} ELSE least(80, {_ROUND.format(_GENERAL)}) END",
    "lifted": f"CASE WHEN has_jd THEN CASE WHEN {_JOB} > 95 AND least(f, c, a, r) < 90 THEN 90 ELSE {_ROUND.format(_LIFTED.format(_JOB))} END ELSE least(85, {_ROUND.format(_LIFTED.format(_GENERAL))}) END",
    "soft_cap": f"CASE WHEN {_ROUND.format(f'CASE WHEN has_jd THEN {_JOB} ELSE {_GENERAL} END')} > 90 THEN floor(90 + ({_ROUND.format(f'CASE WHEN has_jd THEN {_JOB} ELSE {_GENERAL} END')} - 90) * 0.35 + 0.5) ELSE {_ROUND.format(f'CASE WHEN has_jd THEN {_JOB} ELSE {_GENERAL} END')} END",
}

TIER = "CASE WHEN k >= 85 AND c >= 75 THEN 'exceptional' WHEN k >= 70 AND c >= 55 THEN 'strong' WHEN k >= 50 AND c >= 40 THEN 'average' ELSE 'developing' END"

#: Feedback lines: (kind, when, text), in order; a kind without any takes its last line.
FEEDBACK = (
    ("strength", "k >= 75", "keywords fit"),
    ("strength", "f >= 85", "clean format"),
    ("strength", "c >= 80", "complete"),
    ("strength", "a >= 75", "strong verbs"),
    ("strength", "r >= 75", "clear bullets"),
    ("strength", None, "good fundamentals"),
    ("weakness", "k < 70", "keywords missing"),
    ("weakness", "c < 70", "sections missing"),
    ("weakness", "a < 70", "weak verbs"),
    ("weakness", "r < 70", "unclear bullets"),
    ("weakness", None, "minor points"),
)


def totals(components: DataFrame) -> DataFrame:
    """``components`` (k, f, c, a, r, has_jd) with a column for each profile, and the tier."""
    return components.withColumns({name: F.expr(e).cast("long") for name, e in TOTALS.items()} | {"tier": F.expr(TIER)})


def feedback(components: DataFrame) -> DataFrame:
    """With ``strengths`` and ``weaknesses``, joined by semicolons."""
    out = {}
    for kind, name in (("strength", "strengths"), ("weakness", "weaknesses")):
        lines = [(when, text) for k, when, text in FEEDBACK if k == kind]
        told = F.concat_ws(";", *[F.when(F.expr(when), text) for when, text in lines if when])
        out[name] = F.when(told == "", lines[-1][1]).otherwise(told)
    return components.withColumns(out)


def match_method(text: Column, tokens: Column, stems: Column, keyword: Column, synonyms: dict[str, list[str]]) -> Column:
    """How the keyword stands in the text: exact, synonym, words, stem, squashed, prefix or none; the first that holds."""
    hit = F.lit(False)
    for forms in synonyms.values():
        any_form = F.lit(False)
        for form in forms:
            any_form = any_form | F.contains(text, F.lit(form))
        hit = hit | (keyword.isin(forms) & any_form)
    words = F.split(keyword, " ")
    return (
        F.when(F.contains(text, keyword), "exact")
        .when(hit, "synonym")
        .when(F.size(F.array_except(words, tokens)) == 0, "words")
        .when((F.length(keyword) >= 4) & F.array_contains(stems, t.stem_once(keyword)), "stem")
        .when(F.contains(t.no_separators(text), t.no_separators(keyword)), "squashed")
        .when((F.length(keyword) >= 4) & F.exists(tokens, lambda x: x.startswith(F.substring(keyword, 1, 4))), "prefix")
        .otherwise("none")
    )


def match_methods(pairs: DataFrame, synonyms: dict[str, list[str]]) -> DataFrame:
    """(resume_id, jd_id, keyword, method) of pairs with their text and ``keywords`` array.

    A pair is one row with its text once; keywords stand in an array, so the text is
    normalised once a pair and not shuffled with every keyword.
    """
    rows = pairs.withColumn("__norm", t.words_only(F.col("text"))).withColumn("__tokens", F.array_distinct(t.tokens(F.col("__norm"))))
    rows = rows.withColumn("__stems", F.array_distinct(F.transform("__tokens", t.stem_once)))
    told = F.transform("keywords", lambda k: F.struct(k.alias("keyword"), match_method(F.col("__norm"), F.col("__tokens"), F.col("__stems"), k, synonyms).alias("method")))
    return rows.select("resume_id", "jd_id", F.explode(told).alias("m")).select("resume_id", "jd_id", "m.*")


def sectioned_score(counts: DataFrame) -> DataFrame:
    """Score of (resume_id, jd_id, weight, n_finds, section, n_tokens): section and repetition multipliers, stuffing penalty, smoothing."""
    section = F.when(F.col("section") == "summary", 1.2).when(F.col("section") == "opening", 1.0).when(F.col("section") == "body", 0.9).otherwise(0.7)
    often = F.when(F.col("n_finds") == 1, 0.6).when(F.col("n_finds") == 2, 0.85).otherwise(1.0)
    earned = F.when(F.col("n_finds") > 0, F.col("weight") * section * often).otherwise(0.0)
    stuffed = F.when(F.col("n_finds") / F.greatest(F.lit(1), F.col("n_tokens")) > 0.05, 5).otherwise(0)
    out = counts.groupBy("resume_id", "jd_id").agg(F.sum("weight").alias("w"), F.sum(earned).alias("e"), F.sum(stuffed).alias("p"))
    raw = F.greatest(F.lit(0.0), F.col("e") / F.col("w") * 100 - F.col("p"))
    return out.select("resume_id", "jd_id", t.rounded(F.least(F.lit(100.0), F.pow(raw / 100, F.lit(0.9)) * 100)).cast("long").alias("score"))


def verb_strength(verbs: DataFrame, key: str, strong: list[str], medium: list[str], weak: list[str]) -> DataFrame:
    """Per key of (key, verb): counts by class, strength (3, 2 and 1 points, mean, at most 10), diversity in per cent."""
    v = F.col("verb")
    out = verbs.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.count_distinct("verb").alias("distinct_verbs"), F.count_if(v.isin(strong)).alias("strong"), F.count_if(v.isin(medium)).alias("medium"), F.count_if(v.isin(weak)).alias("weak"))
    strength = F.least(F.lit(10), t.rounded((F.col("strong") * 3 + F.col("medium") * 2 + F.col("weak")) / F.col("total")))
    return out.withColumns({"strength": strength.cast("long"), "diversity": t.rounded(F.col("distinct_verbs") * 100 / F.col("total")).cast("long")})


def contained_votes(text: Column, rules: list[tuple[str, list[str]]], default: str) -> tuple[Column, Column]:
    """(label, votes): the label with most terms contained in the text; the first among equals."""
    low = F.lower(text)
    votes = [sum((F.contains(low, F.lit(term)).cast("int") for term in terms), F.lit(0)) for _, terms in rules]
    most = F.greatest(*votes)
    label = F.lit(default)
    for (name, _), n in reversed(list(zip(rules, votes, strict=True))):
        label = F.when((n == most) & (most > 0), name).otherwise(label)
    return label, most
