"""Features of a résumé from its lines, and component scores as rules over them.

Features are array expressions, so a résumé's row never shuffles; repeated words are
counted in the row, too, as runs of its sorted words. A profile is the text of a SQL
expression over features: the operator is built once and profiles are rows of ``PROFILES``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t


def _count(bullets: Column, test) -> Column:
    return F.size(F.filter(bullets, test)).cast("long")


def _word(words: Column, k: int) -> Column:
    return F.lower(F.try_element_at(words, F.lit(k)))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, "\\s+"), lambda x: x != "")


METRIC = "[0-9]+%|[0-9]+x|\\$[0-9]+|[0-9]+[kmb]"

# Nine families of patterns that tell a measured result, and openings of weak bullets.
METRIC_FAMILIES = {
    "live": "(?i)\\d+%|\\d+x|\\d+[kmb]|\\$\\d+|improved|reduced|increased|decreased",
    "production": "\\d+k|\\d{2,}%|\\d+\\+|increased|improved|reduced",
    "worded": "(?i)\\d+\\.?\\d*\\s*%|\\d+\\.?\\d*\\s*x|\\d+\\.?\\d*\\s*(?:million|thousand|hundred|k|m|b)\\b|(?:reduced|decreased|cut)\\s+by\\s+\\d+|(?:improved|increased|boosted|enhanced|optimized|accelerated)\\s+by\\s+\\d+|\\d+\\s*(?:\\+|plus|or\\s+more)|\\d+\\s*(?:team\\s*)?(?:members|people|users|customers|clients|employees)\\b|(?:saved|generated|earned|revenue|profit)\\s+.*?\\d+|\\b(?:increased|decreased|reduced|improved|optimized|enhanced|accelerated|grew|expanded|scaled|delivered|achieved)\\b",
    "validation": "\\d+%|\\d+x|\\d+\\s?(?:k|m|b|billion|million|thousand)|\\$\\d+|\\d+\\s+(?:users|customers|transactions|requests|days?|weeks?|months?|hours?|minutes?|seconds?)|(?i:improved|increased|decreased|reduced|accelerated|optimized|doubled|tripled|grown|expanded)",
    "any_number": "\\d+",
    "bounded": "(?i)\\b\\d+%|\\b\\d+(?:x|\\s*times?|[km]?)|\\$[\\d,]+|\\b(?:improved|reduced|increased|decreased)\\b",
    "handled": "(?i)\\d+%|\\d+x|\\d+[kmb]|spent|handled|managed|processed|\\$\\d+|improved|reduced|increased|decreased",
    "effect": "(?i)\\d+[%x]?|reduced|increased|improved|efficiency|performance|throughput",
    "by_number": "\\d+%|\\d+x|\\$\\d+|by \\d+|increased|improved|reduced",
}

_LEFT, _RIGHT = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def ascii_bounds(pattern: str) -> str:
    """The pattern with look-arounds for ASCII letters where it has word boundaries (Java's follow other letters, too)."""
    for first in ("(?:", "\\d"):
        pattern = pattern.replace("\\b" + first, _LEFT + first)
    return pattern.replace("\\b", _RIGHT)


WEAK_BULLET = "(?i)^(?:responsible for|worked on|worked with|used|helped|handled|involved in|participated in|made)"
COUNTED_RESULT = "(?i)[0-9]|x\\s*faster|increased|decreased|reduced|improved|enhanced|optimized"
RESULT_PARTS = ("faster", "increased", "decreased", "reduced", "improved", "enhanced", "optimized")
# Headings that show a section.
HEADINGS = {
    "summary": "summary|professional summary|career summary|profile|overview|objective|about|professional profile",
    "skills": "skills|technical skills|core skills|competencies|expertise|technologies|tools",
    "experience": "experience|work experience|professional experience|employment|work history|career history",
    "projects": "projects|personal projects|portfolio|academic projects|side projects|notable projects",
    "education": "education|academic background|degrees|qualifications|courses|certifications",
}

#: What a résumé's sections hold, given beside its lines: counts of filled entries, and contact data.
SECTIONS = ("has_email", "has_phone", "n_skills", "n_projects", "n_education", "n_certifications", "n_achievements", "n_dated")


def bounded(words: str) -> str:
    """Pattern of any of the words between ASCII word boundaries."""
    return f"{_LEFT}(?:{words}){_RIGHT}"


def more_often(words: Column, n: int, test=None) -> Column:
    """Number of words that stand more than ``n`` times in a sorted array (and pass ``test``)."""
    at = lambda i: F.get(words, i)
    starts = F.when(F.size(words) > n, F.sequence(F.lit(0), F.size(words) - n - 1)).otherwise(F.array().cast("array<int>"))
    runs = lambda i: (at(i) == at(i + n)) & ((i == 0) | (at(i) != at(i - 1))) & (test(at(i)) if test else F.lit(True))
    return F.size(F.filter(starts, runs)).cast("long")


def resume_features(lines: DataFrame, strong: list[str], weak: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``lines`` (resume_id, lines and SECTIONS, absent ones count as empty): see the columns below, behind the columns to ``keep``.

    Line 1 is the summary, the others are bullets, three to an experience entry.
    ``store.resume_lines`` makes such rows from parsed résumés.
    """
    bullets = F.slice("lines", 2, 2**31 - 2)
    given = [F.col(c) if c in lines.columns else F.lit(False if c.startswith("has_") else 0).alias(c) for c in SECTIONS]
    rows = lines.select("resume_id", *keep, *given, F.coalesce(F.try_element_at("lines", F.lit(1)), F.lit("")).alias("summary"), bullets.alias("bullets"), F.array_join("lines", " ").alias("whole"), F.size(F.filter("lines", lambda x: x.rlike("^[-•*]"))).alias("marked_lines"))
    # what the features ask of a bullet is found once, before they count
    split = F.transform("bullets", lambda x: F.struct(x.alias("text"), F.length(x).alias("n"), _words(x).alias("ws"), x.rlike("[0-9]").alias("digit"), F.lower(x).alias("low")))
    rows = rows.withColumns({"norm": t.strip_markup(F.col("whole")), "lowered": F.lower("whole"), "split": split})
    known = lambda x: F.struct(x["text"].alias("text"), x["n"].alias("n"), F.size(x["ws"]).alias("w"), _word(x["ws"], 1).alias("first"), _word(x["ws"], 2).alias("second"), x["digit"].alias("digit"), (x["digit"] & x["text"].rlike(METRIC)).alias("metric"), x["low"].alias("low"))
    rows = rows.withColumn("split", F.transform("split", known))
    judged = lambda x: F.struct(
        x["text"].alias("text"), x["n"].alias("n"), x["w"].alias("w"), x["first"].alias("first"), x["digit"].alias("digit"), x["metric"].alias("metric"), x["low"].alias("low"),
        F.coalesce(x["first"].isin(strong), F.lit(False)).alias("strong"), F.coalesce(x["first"].isin(weak), F.lit(False)).alias("weak"),
        F.coalesce(x["first"].isin(strong) & x["second"].isin(strong), F.lit(False)).alias("double"),
    )
    rows = rows.withColumn("b", F.transform("split", judged)).drop("split")
    b = F.col("b")
    plain = F.filter(F.split(F.regexp_replace("lowered", "[^a-z\\s]", ""), "\\s+"), lambda w: F.length(w) > 3)
    sentences = F.filter(F.split("whole", "[.!?]+"), lambda x: F.trim(x) != "")
    spoken = t.tokens(t.words_only(F.array_join("bullets", " ")))
    rows = rows.withColumns({"sorted": F.sort_array(spoken), "plain": F.sort_array(plain), "sentences": sentences})
    proofs = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(b) / 3).cast("int") - 1)), lambda i: F.size(F.filter(F.slice(b, i * 3 + 1, 3), lambda x: x["strong"] & x["metric"])))
    # a pattern is looked for only where a part stands that all its finds have; such parts are found by bytes
    low = F.col("lowered")
    found = lambda parts, text, pattern: t.contains_any(low, parts) & text.rlike(pattern)
    counted = lambda signs, pattern: F.when(t.contains_any(F.col("whole"), signs), F.regexp_count("whole", F.lit(pattern))).otherwise(0)
    whole = F.col("whole")
    deep = lambda test: F.size(F.filter(proofs, test)).cast("long")
    features = {
        "summary_len": F.length(F.trim("summary")),
        "summary_words": F.size(_words(F.col("summary"))),
        "summary_signs": F.regexp_count("summary", F.lit("[!@#$%^&*()_+=\\[\\]{};:'\",.<>?/\\\\]")),
        **{c: F.col(c) for c in SECTIONS},
        **{f"has_{c}": F.col(f"n_{c}") > 0 for c in ("skills", "projects", "education", "certifications", "achievements")},
        "has_dates": F.col("n_dated") > 0,
        **{f"heading_{c}": found(p.split("|"), low, bounded(p)) for c, p in HEADINGS.items()},
        "marked_lines": F.col("marked_lines"),
        "images": found(("](", "http"), whole, "(?i)!?\\[.*\\]\\(.*\\.(?:jpg|jpeg|png|gif|webp)\\)|http.*\\.(?:jpg|jpeg|png|gif|webp)"),
        "image_tags": F.col("whole").contains("<img") | F.col("whole").contains("[image]"),
        "icon_words": found(("<img", "image:", "icon", "fa-", "emoji"), whole, "(?i)<img|image:|icon|fa-|material-icons|emoji"),
        "table_words": found(("table", "grid-template-columns", "column-count", "two-column"), whole, "(?i)table|grid-template-columns|column-count|two-column"),
        "table_word": found(("table",), low, bounded("table")),
        "emoji": F.col("whole").rlike("[\\x{1F300}-\\x{1FAFF}]"),
        "stars": t.contains_any(whole, "★☆"),
        "icons": t.contains_any(whole, "★☆⭐💫✓✔✕✗"),
        "rare_signs": counted("™®©§¶", "[™®©§¶]"),
        "deep_jobs": deep(lambda n: n >= 3),
        "solid_jobs": deep(lambda n: n == 2),
        "weak_bullets": _count(b, lambda x: x["text"].rlike(WEAK_BULLET)),
        "bounded_verbs": _count(b, lambda x: t.contains_any(x["low"], strong) & x["low"].rlike(bounded("|".join(strong)))),
        "counted_results": _count(b, lambda x: x["digit"] | (t.contains_any(x["low"], RESULT_PARTS) & x["text"].rlike(COUNTED_RESULT))),
        "wide_gaps": _count(b, lambda x: x["text"].rlike(" {3,}")),
        "any_wide_gap": F.col("whole").rlike("\\s{3,}"),
        "whole_words": F.size(F.split("whole", "\\s+")),
        "whole_letters": F.length(F.regexp_replace("whole", "\\s+", "")),
        "whole_stops": F.regexp_count("whole", F.lit("[.!?]+")),
        "inner_signs": F.col("whole").rlike("[,;:—]"),
        "all_sentences": F.size("sentences"),
        "dup_sentences": (F.size("sentences") - F.size(F.array_distinct(F.transform("sentences", t.words_only)))).cast("long"),
        "norm_chars": F.length("norm"),
        "repeated": more_often(F.col("sorted"), 4),
        "repeated_long": more_often(F.col("sorted"), 5, lambda w: F.length(w) > 3),
        "repeated_plain": more_often(F.col("plain"), 3),
        "nb": F.size(b).cast("long"),
        "n_items": F.ceil(F.size(b) / 3),
        "ok_len": _count(b, lambda x: (x["n"] > 20) & (x["n"] < 200)),
        "over_180": _count(b, lambda x: x["n"] > 180),
        "over_140": _count(b, lambda x: (x["n"] > 140) & (x["n"] <= 180)),
        "over_200": _count(b, lambda x: x["n"] > 200),
        "under_30": _count(b, lambda x: x["n"] < 30),
        "long_block": _count(b, lambda x: (x["n"] > 300) & ~x["text"].contains(".")),
        "words_over_20": _count(b, lambda x: x["w"] > 20),
        "words_over_35": _count(b, lambda x: x["w"] > 35),
        "words_over_150": _count(b, lambda x: x["w"] > 150),
        "sum_len": F.aggregate(b, F.lit(0).cast("long"), lambda s, x: s + x["n"]),
        "sum_words": F.aggregate(b, F.lit(0).cast("long"), lambda s, x: s + x["w"]),
        "strong_first": _count(b, lambda x: x["strong"]),
        "weak_first": _count(b, lambda x: x["weak"]),
        "double_verb": _count(b, lambda x: x["double"]),
        "weak_or_double": _count(b, lambda x: x["weak"] | x["double"]),
        "strong_metric": _count(b, lambda x: x["strong"] & ~x["double"] & x["metric"]),
        "plain_long": _count(b, lambda x: ~x["strong"] & ~x["weak"] & (x["w"] >= 5)),
        "any_strong": _count(b, lambda x: t.contains_any(x["low"], strong)),
        # tokens after the markup is gone, only where the letters of a verb stand at all
        "any_token": _count(b, lambda x: t.contains_any(x["low"], strong) & F.arrays_overlap(t.tokens(t.strip_markup(x["text"])), F.array(*map(F.lit, strong)))),
        "metric": _count(b, lambda x: x["metric"]),
        "digit": _count(b, lambda x: x["digit"]),
        "alpha_first": _count(b, lambda x: x["text"].rlike("^[A-Za-z]")),
        "no_end": _count(b, lambda x: ~x["text"].rlike("[.!?]$")),
        "dup_bullets": (F.size(b) - F.size(F.array_distinct(F.transform(b, lambda x: x["low"])))).cast("long"),
        "abbreviations": F.regexp_count("whole", F.lit("[A-Z]{2,}")),
        "pipes": F.col("whole").contains("|"),
        "table_row": found("|", whole, "\\|.+\\|"),
        "decoration": found("*_~`#=", whole, "[*_~`#=]{3,}"),
        "decoration5": found("*_~`#", whole, "[*_~`#]{5,}"),
        "words_over_25": _count(b, lambda x: x["w"] > 25),
        "words_under_5": _count(b, lambda x: x["w"] < 5),
        "words_to_2": _count(b, lambda x: x["w"] <= 2),
        "tiny": _count(b, lambda x: F.length(F.trim(x["text"])) < 5),
        "structured": _count(b, lambda x: (x["w"] >= 8) & (x["w"] <= 20) & x["metric"]),
        "weak_opening": _count(b, lambda x: x["text"].rlike("^(and|or|the|a) ")),
        "strong_any_metric": _count(b, lambda x: x["strong"] & x["metric"]),
        "distinct_strong": F.size(F.array_distinct(F.transform(F.filter(b, lambda x: x["strong"]), lambda x: x["first"]))).cast("long"),
        "special_signs": counted("*_%#~`@", "[*_%#~`@]"),
        "pipe_pair": found("|", whole, "\\|.*\\|"),
        "pipe_cell": found("|", whole, "\\|\\s*\\w+\\s*\\|"),
        "norm_words": F.when(F.col("norm") == "", 0).otherwise(F.length("norm") - F.length(F.replace("norm", F.lit(" "), F.lit(""))) + 1),
        "norm_sentences": F.size(t.sentences(F.col("norm"))),
    }
    out = rows.select("resume_id", *keep, *[v.alias(k) for k, v in features.items()])
    return out.withColumn("chars_a_sentence", F.expr("CASE WHEN norm_sentences = 0 OR norm_words = 0 THEN 0 ELSE floor(norm_chars / (1.0 * norm_sentences) + 0.5) END").cast("long"))


_SEVEN = "(CAST(summary_len > {0} AS INT) + CAST(has_skills AS INT) + CAST(nb > 0 AS INT) + CAST(has_projects AS INT) + CAST(has_education AS INT) + CAST(has_certifications AS INT) + CAST(has_achievements AS INT))"
_FIVE = "(CAST(summary_len >= {0} AS INT) + CAST(has_skills AS INT) + CAST(nb > 0 AS INT) + CAST(has_projects AS INT) + CAST(has_education AS INT))"
_FLAG = "CASE WHEN {0} THEN {1} ELSE 0 END"


def _points(*parts: tuple[str, float | str]) -> str:
    return " + ".join(_FLAG.format(test, points) for test, points in parts)


#: Component scores by family and profile, in SQL over the features.
PROFILES: dict[str, dict[str, str]] = {
    "completeness": {
        "live": f"CASE {_SEVEN.format(10)} WHEN 7 THEN 100 WHEN 6 THEN 90 WHEN 5 THEN 80 WHEN 4 THEN 60 WHEN 3 THEN 40 ELSE 0 END",
        "required_five": f"{_FIVE.format(50)} * 20",
        "production": f"CASE {_SEVEN.format(10)} WHEN 0 THEN 0 ELSE 30 + 10 * {_SEVEN.format(10)} END",
        "short_summary": f"{_FIVE.format(20)} * 20",
        "weighted": _points(("summary_len > 0", 15), ("has_skills", 20), ("has_projects", 10), ("nb > 0", 25), ("has_education", 15), ("has_certifications", 8), ("has_achievements", 7)),
        "even_weights": _points(("has_email", 15), ("summary_len > 50", 15), ("has_skills", 15), ("nb > 0", 15), ("has_education", 15), ("has_projects", 5), ("has_certifications", 5), ("has_achievements", 5)),
        "engine": f"floor({_SEVEN.format(20)} * 100 / 7.0 + 0.5)",
        "simple": _points(("summary_len > 0", 15), ("has_skills", 20), ("nb > 0", 25), ("has_projects", 15), ("has_education", 10), ("has_certifications OR has_achievements", 15)),
        "graded": "10 + " + _points(("has_email", 5), ("has_phone", 5), ("has_education", 10), ("has_projects", 7), ("has_certifications", 4), ("has_achievements", 4)) + " + CASE WHEN summary_len >= 150 THEN 15 WHEN summary_len >= 60 THEN 10 WHEN summary_len > 0 THEN 5 ELSE 0 END + CASE WHEN n_items >= 2 AND nb >= 6 THEN 25 WHEN n_items >= 1 AND nb >= 3 THEN 15 WHEN n_items >= 1 THEN 8 ELSE 0 END + CASE WHEN n_skills >= 10 THEN 15 WHEN n_skills >= 5 THEN 10 WHEN n_skills > 0 THEN 5 ELSE 0 END",
        "deep": f"CASE {_SEVEN.format(10)} WHEN 0 THEN 0 WHEN 1 THEN 20 WHEN 2 THEN 40 WHEN 3 THEN 60 ELSE 30 + 10 * {_SEVEN.format(10)} END",
        "headings": "floor((CAST(heading_summary OR summary_len > 20 AS INT) + CAST(heading_skills OR has_skills AS INT) + CAST(heading_experience OR nb > 0 AS INT) + CAST(heading_projects OR has_projects AS INT) + CAST(heading_education OR has_education AS INT)) * 20)",
        "with_depth": "least(75, " + _points(("has_email", 10), ("summary_len > 50", 10), ("has_skills", 10), ("has_education", 10)) + " + least(25, least(16, deep_jobs * 8 + solid_jobs * 4) + " + _FLAG.format("n_items >= 3", 5) + ") + least(10, " + _points(("has_projects", 4), ("has_certifications", 3), ("has_achievements", 3)) + "))",
        "three_sections": "CASE WHEN summary_len > 0 AND nb > 0 AND has_skills THEN 90 ELSE " + _points(("summary_len > 0", 30), ("nb > 0", 30), ("has_skills", 30)) + " END",
    },
    "formatting": {
        "live": "least(100, 20 + " + _points(("nb > 0", 25), ("has_dates", 15), ("abbreviations <= 20", 20), ("nb > 0 AND ok_len > 0.8 * nb", 20)) + ")",
        "penalties": "greatest(0, 100 - (" + _points(("pipes", 20), ("images", 20), ("emoji OR stars", 10), ("decoration5", 10), ("summary_words > 150 OR words_over_150 > 0", 10), ("CAST(summary_len > 0 AS INT) + CAST(nb > 0 AS INT) + CAST(has_skills AS INT) + CAST(has_education AS INT) < 3", 10)) + "))",
        "production": f"least(100, 50 + 5 * {_SEVEN.format(10)} + " + _points(("nb > 0", 10), ("has_education", 10)) + ")",
        "contact": "100 - (" + _points(("table_words", 20), ("icon_words", 15), ("CAST(summary_len > 0 AS INT) + CAST(has_skills AS INT) + CAST(nb > 0 AS INT) + CAST(has_education AS INT) < 3", 15), ("NOT has_email", 8), ("NOT has_phone", 6)) + ")",
        "long_bullets": "greatest(30, 100 - least(25, over_200 * 5) - " + _FLAG.format("summary_signs > 10", 10) + " - dup_bullets * 8 - long_block * 5)",
        "simple": "100 - (" + _points(("decoration", 20), ("table_row", 20), ("emoji", 20)) + ")",
        "improved": "least(100, greatest(0, 100 - (" + _points(("image_tags", 20), ("table_words OR pipes", 20), ("rare_signs > 5", 15), ("whole_words > 200", 10)) + ") + " + _FLAG.format("marked_lines > 10", 5) + "))",
        "bullet_curve": "least(95, floor(CASE WHEN nb = 0 THEN 0 ELSE least(93, 40 + nb * 21 / 10.0) END + 3 + " + _points(("summary_len > 20", 2), ("has_skills", 2)) + " + 0.5))",
        "third": "greatest(0, CASE WHEN nb BETWEEN 10 AND 30 THEN least(100, 105 - {0}) ELSE 100 - {0} END)".format("(" + _points(("pipe_pair", 30), ("icons", 30), ("emoji", 30), ("pipe_cell", 20), ("special_signs > 20", "least(20, floor(special_signs / 5.0))"), ("NOT (summary_len > 0 AND nb > 0 AND has_education)", 10)) + ")"),
        "start_80": "greatest(35, 80 - over_200 * 5 - " + _FLAG.format("summary_signs > 8", 8) + " - " + _FLAG.format("summary_len > 500", 5) + ")",
        "capped": "greatest(0, 100 - (" + _points(("decoration", 20), ("table_row OR table_word", 15), ("emoji", 10), ("summary_words > 100", 10)) + " + least(20, words_over_35 * 5) + least(15, tiny * 5) + least(10, words_to_2 * 2)))",
        "additive": "least(100, 50 + " + _points(("has_dates", 20), ("abbreviations < 20", 20), ("nb > 5 AND nb < 50", 10)) + ")",
        "bullet_bands": "CASE WHEN nb >= 10 THEN 85 WHEN nb >= 5 THEN 70 ELSE 50 END",
    },
    "verbs": {
        "live_percent": "CASE WHEN nb = 0 THEN 0 ELSE floor(any_token * 100.0 / nb + 0.5) END",
        "first_word": "CASE WHEN nb = 0 THEN 50 ELSE floor(strong_first * 100.0 / nb + 0.5) END",
        "first_word_or_none": "CASE WHEN nb = 0 THEN 0 ELSE floor(strong_first * 100.0 / nb + 0.5) END",
        "points": "CASE WHEN nb = 0 THEN 50 ELSE greatest(10, least(100, floor((2 * (strong_first - double_verb) + strong_metric - weak_or_double + 0.5 * plain_long) * 100.0 / nb - least(30, weak_or_double * 30.0 / nb) + 0.5))) END",
        "share_other": "CASE WHEN nb = 0 THEN 0 ELSE floor((strong_first * 100 + (nb - strong_first) * 35) / (1.0 * nb) + 0.5) END",
        "less_weak": "CASE WHEN nb = 0 THEN 0 ELSE greatest(0, floor((strong_first * 100 - weak_first * 15) / (1.0 * nb) + 0.5)) END",
        "less_weak_40": "CASE WHEN nb = 0 THEN 0 ELSE greatest(0, floor(strong_first * 100.0 / nb - least(40, weak_first * 40.0 / nb) + 0.5)) END",
        "with_metrics": "CASE WHEN nb = 0 THEN 0 ELSE least(100, floor((strong_first * 40 + strong_any_metric * 50) / (1.0 * nb) + 0.5)) END",
        "experience_quality": "CASE WHEN nb = 0 THEN 0 ELSE floor((strong_first * 30 + metric * 40 + strong_any_metric * 20) / (1.0 * nb) + least(distinct_strong, 10) + 0.5) END",
        "bonus": "CASE WHEN nb = 0 THEN 0 ELSE least(100, floor(strong_first * 100.0 / nb + least(20, 10 * counted_results) + 0.5)) END",
        "bounded_tenths": "CASE WHEN nb = 0 THEN 0 ELSE floor(floor(bounded_verbs * 100.0 / nb + 0.5) / 10.0 + 0.5) END",
        "weak_count": "weak_bullets",
        "anywhere": "CASE WHEN nb = 0 THEN 100 ELSE floor(any_strong * 100.0 / nb + 0.5) END",
    },
    "readability": {
        "live": "CASE WHEN norm_sentences = 0 OR norm_words = 0 THEN 50 WHEN norm_words >= 10 * norm_sentences AND norm_words <= 20 * norm_sentences THEN 100 WHEN norm_words < 10 * norm_sentences THEN greatest(30, floor(100 - (10 - norm_words / (1.0 * norm_sentences)) * 5 + 0.5)) ELSE greatest(30, floor(100 - (norm_words / (1.0 * norm_sentences) - 20) * 2 + 0.5)) END",
        "deductions": "CASE WHEN nb = 0 THEN 50 ELSE greatest(0, 100 - 2 * words_over_20 - " + _FLAG.format("repeated > 0", 5) + " - " + _FLAG.format("summary_words > 150 OR words_over_150 > 0", 10) + " - least(3, no_end)) END",
        "production": "50 + " + _points(("summary_len > 100", 10), ("has_skills", 10), ("has_certifications", 5)) + " + CASE WHEN nb = 0 THEN 0 ELSE least(10, floor(digit * 10.0 / nb + 0.5)) END",
        "mean_words": "CASE WHEN nb = 0 THEN 45 ELSE least(100, greatest(0, 100 - CASE WHEN sum_words > 24 * nb THEN least(35, floor((sum_words / (1.0 * nb) - 24) * 2 + 0.5)) WHEN sum_words < 8 * nb THEN 12 ELSE 0 END + least(12, floor(metric * 20.0 / nb + 0.5)) + least(8, floor(alpha_first * 10.0 / nb + 0.5)))) END",
        "length_penalties": "CASE WHEN nb = 0 THEN 40 ELSE greatest(25, 80 - 4 * over_180 - 2 * over_140 - 3 * under_30 - 3 * (nb - strong_first) - 2 * (nb - metric) - " + _FLAG.format("sum_len < 50 * nb OR sum_len > 200 * nb", 10) + " - " + _FLAG.format("summary_len > 500", 5) + " - " + _FLAG.format("summary_len > 800", 10) + ") END",
        "half_long": "CASE WHEN nb = 0 THEN 0 ELSE floor(100 - words_over_20 * 50.0 / nb + 0.5) END",
        "third": "CASE WHEN nb = 0 THEN 0 ELSE greatest(0, least(100, floor(100 - least(30, words_over_25 * 5) - least(20, words_under_5 * 3) - least(20, repeated_long * 2) - least(15, (weak_opening + wide_gaps) * 3) + least(10, structured * 10.0 / nb) + 0.5))) END",
        "start_75": "CASE WHEN nb = 0 THEN 40 ELSE least(85, greatest(20, 75 - 4 * over_180 - 3 * under_30 - 3 * (nb - strong_first) - 2 * (nb - metric) - 15 * dup_bullets - " + _FLAG.format("summary_len > 500", 8) + " - " + _FLAG.format("summary_len > 1000", 15) + ")) END",
        "length_and_metrics": "CASE WHEN nb = 0 THEN 50 ELSE least(100, floor(CASE WHEN floor(sum_len / (1.0 * nb) + 0.5) BETWEEN 60 AND 160 THEN 82 WHEN floor(sum_len / (1.0 * nb) + 0.5) BETWEEN 40 AND 59 THEN 68 WHEN floor(sum_len / (1.0 * nb) + 0.5) > 160 THEN 72 ELSE 42 END + metric * 18.0 / nb + 0.5)) END",
        "simple": "CASE WHEN nb = 0 THEN 0 ELSE 100 - least(30, words_over_35 * 7) END",
        "capped": "greatest(0, 100 - (least(25, words_over_35 * 5) + least(20, repeated_plain * 3) + least(15, dup_sentences * 5) + " + _points(("any_wide_gap", 10), ("summary_words > 0 AND summary_words < 10", 5)) + "))",
        "ratios_tenths": "CASE WHEN norm_sentences = 0 OR norm_words = 0 THEN 0 WHEN norm_words >= 10 * norm_sentences AND norm_words <= 20 * norm_sentences THEN 100 WHEN norm_words < 10 * norm_sentences THEN greatest(50, floor(100 - (10 - norm_words / (1.0 * norm_sentences)) * 5 + 0.5)) ELSE greatest(20, floor(100 - (norm_words / (1.0 * norm_sentences) - 20) + 0.5)) END",
        "additive": "CASE WHEN whole_letters = 0 THEN 0 ELSE least(100, CASE WHEN whole_letters > 3 * whole_words AND whole_letters < 7 * whole_words THEN 40 ELSE 30 END + CASE WHEN whole_stops = 0 THEN 0 WHEN whole_words < 25 * whole_stops THEN 30 WHEN whole_words < 40 * whole_stops THEN 20 ELSE 0 END + CASE WHEN inner_signs THEN 30 ELSE 0 END) END",
        "length_bands": "CASE WHEN nb = 0 THEN 50 WHEN sum_len >= 80 * nb AND sum_len <= 150 * nb THEN 90 WHEN sum_len > 150 * nb THEN 60 WHEN sum_len >= 40 * nb THEN 75 ELSE 50 END",
    },
}


def verb_curve(percent: str) -> str:
    """0 to 100 from the share of bullets with a verb; the steps at 25, 50 and 75 are the rule's own."""
    return f"CASE WHEN {percent} >= 90 THEN 100 WHEN {percent} >= 75 THEN 80 + ({percent} - 75) * 10 / 15.0 WHEN {percent} >= 50 THEN 50 + ({percent} - 50) * 10 / 25.0 WHEN {percent} >= 25 THEN 20 + ({percent} - 25) * 10 / 25.0 ELSE 0 END"


def scores(features: DataFrame, family: str, raw: tuple[str, ...] = ()) -> DataFrame:
    """resume_id and a column for each profile of the family, then the features ``raw`` as they are."""
    return features.select("resume_id", *[F.expr(e).cast("long").alias(k) for k, e in PROFILES[family].items()], *raw)


def composite(features: DataFrame, keyword_score: Column) -> DataFrame:
    """The live composite: .4 keywords, .2 completeness, .2 formatting, .1 verbs, .1 readability."""
    percent = PROFILES["verbs"]["live_percent"]
    rows = features.withColumns({
        "keyword_match": t.clamped(keyword_score),
        "section_completeness": F.expr(PROFILES["completeness"]["live"]).cast("double"),
        "formatting": F.expr(PROFILES["formatting"]["live"]).cast("double"),
        "percent": F.expr(percent).cast("double"),
        "readability": F.expr(PROFILES["readability"]["live"]).cast("double"),
    })
    rows = rows.withColumn("action_verbs", t.clamped(F.expr(verb_curve("percent"))))
    total = t.rounded(F.col("keyword_match") * 0.4 + F.col("section_completeness") * 0.2 + F.col("formatting") * 0.2 + F.col("action_verbs") * 0.1 + F.col("readability") * 0.1)
    return rows.withColumn("total_score", total.cast("long"))
