"""Queries of bullet wording: contexts, expansions, keyword placement, results, and records of rewriting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dictionaries import STRONG_VERBS, WEAK_OPENINGS, WEAK_PATTERNS
from ..operators import features as f, rewriting as r, wording as w
from ._register import query
from .suggestions import _CAP, _SUGGESTED, OPENINGS, _suggested

#: The fixed tables, and rules for words of the given documents behind them.
CONTEXTS = (*w.CONTEXTS, ("thation|elle", "growth"), ("ing|keit", "support"))
EXPANSIONS = (*w.EXPANSIONS, ("the.*th", "for the whole team"), ("le.*ment", "for all users"))
HINTS = (*w.RESULT_HINTS, ("the|der", " (e.g., X of Y)"))
PATTERNS = (*WEAK_PATTERNS, ("the\\s+", "Led "), ("an?\\s+", "Built "))
STARTS = (*WEAK_OPENINGS, *OPENINGS, ("the an", "Planned"))
WEAK_WORDS = {"helped": "facilitated", "worked": "developed", "and": "plus", "de": "of"}
STRONG = [*STRONG_VERBS, "that", "this", "from"]
_RESULT = "\\d+[%x]?|reduced|increased|improved|efficiency|performance|throughput"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _first_rule(column: str, rules, other: str | None) -> str:
    whens = "".join(f" WHEN regexp_matches({column}, {_quoted(p)}) THEN {_quoted(label)}" for p, label in rules)
    return f"CASE{whens} ELSE {'NULL' if other is None else _quoted(other)} END"


@query("bullet_contexts", f"SELECT resume_id, pos, {_first_rule('lower(text)', CONTEXTS, None)} AS context FROM fx_bullets", "fx_bullets")
def bullet_contexts(v):
    return v.bullets.select("resume_id", "pos", w.context(F.col("text"), CONTEXTS).alias("context"))


def _expanded_sql(x: str) -> str:
    return rf"CASE WHEN len(string_split_regex(trim({x}), '\s+')) >= 8 THEN trim({x}) ELSE trim({x}) || ' ' || {_first_rule(f'lower({x})', EXPANSIONS, w.EXPANSION_ELSE)} END"


@query("short_bullets_expanded", f"SELECT resume_id, pos, md5({_expanded_sql('text')}) AS digest FROM fx_bullets", "fx_bullets")
def short_bullets_expanded(v):
    return v.bullets.select("resume_id", "pos", F.md5(w.expanded(F.col("text"), EXPANSIONS).cast("binary")).alias("digest"))


@query("result_hints", f"SELECT resume_id, pos, {_first_rule('lower(text)', HINTS, w.RESULT_HINT_ELSE)} AS hint FROM fx_bullets WHERE NOT regexp_matches(text, '[0-9]')", "fx_bullets")
def result_hints(v):
    rows = v.bullets.where(~F.col("text").rlike("[0-9]"))
    return rows.select("resume_id", "pos", w.result_hint(F.col("text"), HINTS).alias("hint"))


def _pattern_sql(x: str) -> str:
    whens = "".join(f" WHEN regexp_matches({x}, {_quoted('(?i)^' + p)}) THEN regexp_replace({x}, {_quoted('(?i)^' + p)}, {_quoted(new)})" for p, new in PATTERNS)
    return f"CASE{whens} END"


@query("weak_patterns_replaced", f"SELECT resume_id, pos, md5({_pattern_sql('text')}) AS digest FROM fx_bullets WHERE {_pattern_sql('text')} IS NOT NULL", "fx_bullets")
def weak_patterns_replaced(v):
    new = r.replace_pattern(F.col("text"), PATTERNS)
    return v.bullets.where(new.isNotNull()).select("resume_id", "pos", F.md5(new.cast("binary")).alias("digest"))


_STARTS = f"(VALUES {', '.join(f'({_quoted(a)}, {_quoted(b)})' for a, b in STARTS)}) s(weak, strong)"


@query("longest_openings", f"""SELECT resume_id, pos, md5(strong || ' ' || {_CAP.format('rest')}) AS digest FROM (SELECT resume_id, pos, strong, trim(substr(text, length(weak) + 1)) AS rest,
row_number() OVER (PARTITION BY resume_id, pos ORDER BY length(weak) DESC, weak) AS n FROM fx_bullets JOIN {_STARTS} ON starts_with(lower(replace(text, 'İ', 'i\u0307')), weak)) WHERE n = 1""", "fx_bullets")
def longest_openings(v):
    new = r.longest_opening(F.col("text"), STARTS)
    return v.bullets.where(new.isNotNull()).select("resume_id", "pos", F.md5(new.cast("binary")).alias("digest"))


_WEAK = "CASE" + "".join(rf" WHEN regexp_matches(text, '(?i)\b{a}\b') THEN regexp_replace(text, '(?i)\b{a}\b', '{b}')" for a, b in WEAK_WORDS.items()) + " ELSE text END"


@query("first_weak_words", f"SELECT resume_id, pos, md5({_WEAK}) AS digest FROM fx_bullets", "fx_bullets")
def first_weak_words(v):
    return v.bullets.select("resume_id", "pos", F.md5(w.first_weak_word(F.col("text"), WEAK_WORDS).cast("binary")).alias("digest"))


@query("bullet_rewrite_records", rf"""SELECT resume_id, pos, md5(new) AS rewritten, md5(long) AS expanded, regexp_matches(lower(long), '{_RESULT}') AS has_result,
CASE WHEN len(string_split_regex(long, '\s+')) > 20 THEN 'low' WHEN new <> bare THEN 'high' ELSE 'medium' END AS confidence FROM (SELECT *, {_expanded_sql('new')} AS long FROM (SELECT *, coalesce({_pattern_sql('bare')}, bare) AS new FROM (SELECT resume_id, pos, trim(text) AS bare FROM fx_bullets)))""", "fx_bullets")
def bullet_rewrite_records(v):
    rows = v.bullets.select("resume_id", "pos", w.rewritten(F.col("text"), PATTERNS, _RESULT, EXPANSIONS).alias("x"))
    return rows.select("resume_id", "pos", F.md5(F.col("x.rewritten").cast("binary")).alias("rewritten"), F.md5(F.col("x.expanded").cast("binary")).alias("expanded"), "x.has_result", "x.confidence")


@query("verb_candidates", "SELECT resume_id, pos, verb, CASE verb " + " ".join(f"WHEN '{k}' THEN '{','.join(x)}'" for k, x in {**w.STRONGER, 'the': ['led', 'ran']}.items()) + r" ELSE '' END AS candidates FROM (SELECT resume_id, pos, lower(string_split_regex(trim(text), '\s+')[1]) AS verb FROM fx_bullets)", "fx_bullets")
def verb_candidates(v):
    verb = F.lower(F.get(F.split(F.trim("text"), "\\s+"), F.lit(0)))
    return v.bullets.select("resume_id", "pos", verb.alias("verb"), F.array_join(w.stronger_verbs(verb, {**w.STRONGER, "the": ["led", "ran"]}), ",").alias("candidates"))


_CHART = r"""CASE WHEN regexp_matches(main, '^(.+?using\s+[^.]+?)\s+to\s+(.+)$') THEN regexp_extract(main, '^(.+?using\s+[^.]+?)\s+to\s+(.+)$', 1) || ' and built ' || kw || ' dashboards to visualize insights and support data-driven decision making.'
  WHEN contains(main, 'using') THEN main || ' and built ' || kw || ' dashboards to visualize insights.' ELSE main || ' and visualized results with ' || kw END"""
_STACK = r"(?i)^(.+?(?:using|with)\s+)([^.]+?)(\s+(?:to|for|,|\.).*)?$"
_LISTED = rf"""CASE WHEN regexp_matches(main, '{_STACK}') THEN regexp_extract(main, '{_STACK}', 1) || trim(regexp_extract(main, '{_STACK}', 2)) ||
  CASE WHEN contains(regexp_extract(main, '{_STACK}', 2), ',') OR regexp_matches(regexp_extract(main, '{_STACK}', 2), '(?i)\s+and\s+\w+$') THEN ', ' ELSE ' and ' END || kw || regexp_extract(main, '{_STACK}', 3) ELSE main END"""
_THING, _WORK = r"(?i)^([^.]+?)\s+(system|service|platform|feature|app|application|api|solution|dashboard)", r"(?i)^([^.]+?)\s+(query|process|algorithm|workflow)"
_ACTIVE = rf"""CASE WHEN about = 'development' AND regexp_matches(main, '{_THING}') THEN regexp_extract(main, '{_THING}', 1) || ' ' || kw || '-powered ' || regexp_extract(main, '{_THING}', 2) || substr(main, length(regexp_extract(main, '{_THING}')) + 1)
  WHEN about IN ('data-analysis', 'optimization') AND regexp_matches(main, '{_WORK}') THEN regexp_extract(main, '{_WORK}') || ' using ' || kw || substr(main, length(regexp_extract(main, '{_WORK}')) + 1) ELSE main || ' with ' || kw END"""
_METHOD = rf"""CASE WHEN lower(regexp_extract(main, '^(\w+)', 1)) IN ({', '.join(map(_quoted, STRONG))}) THEN regexp_extract(main, '^(\w+)', 1) || ' using ' || kw || ' methodology' || substr(main, length(regexp_extract(main, '^(\w+)', 1)) + 1) ELSE main || ' using ' || kw || ' principles' END"""


def _placed(source: str, keys: str) -> str:
    """``source`` (keys, bare, main, kw) with ``x`` (the keyword placed, how surely) and whether it is there."""
    return f"""SELECT {keys}, kw, bare, main, contains(lower(bare), lower(kw)) AS there,
CASE WHEN (contains(lower(bare), 'analyz') OR contains(lower(bare), 'data')) AND regexp_matches(kw, {_quoted(w.CHART_TOOLS)}) THEN {{'t': {_CHART}, 'c': 'high'}}
  WHEN contains(lower(bare), 'using ') OR contains(lower(bare), ' with ') THEN {{'t': {_LISTED}, 'c': 'high'}} WHEN about IS NOT NULL AND tool THEN {{'t': {_ACTIVE}, 'c': 'medium'}}
  WHEN regexp_matches(kw, {_quoted(w.METHODS)}) THEN {{'t': {_METHOD}, 'c': 'medium'}} WHEN tool OR about IS NOT NULL THEN {{'t': main || CASE WHEN tool THEN ' leveraging ' ELSE ' with ' END || kw, 'c': 'low'}} END AS x
FROM (SELECT *, {_first_rule('lower(main)', CONTEXTS, None)} AS about, regexp_matches(kw, {_quoted(w.TOOLS)}) AS tool FROM ({source}))"""


_PLACED = _placed("""SELECT b.resume_id, b.pos, trim(b.text) AS bare, trim(string_split_regex(trim(b.text), '[.•]')[1]) AS main, k.kw
FROM fx_bullets b JOIN (SELECT resume_id, jd_id FROM fx_resumes WHERE jd_id IS NOT NULL) p USING (resume_id) JOIN (SELECT jd_id, CASE WHEN rnk = 1 THEN upper(substr(keyword, 1, 1)) || substr(keyword, 2) ELSE 'rest ' || keyword END AS kw FROM fx_jd_keywords WHERE rnk <= 2) k USING (jd_id)""", "resume_id, pos")


@query("keywords_integrated", f"""SELECT resume_id, pos, kw AS keyword, md5(CASE WHEN done THEN trim(x.t) ELSE bare END) AS digest, CASE WHEN there THEN 'high' WHEN done THEN x.c ELSE 'low' END AS confidence, done AS integrated
FROM (SELECT *, coalesce(NOT there AND x.t IS NOT NULL AND x.t <> main, false) AS done FROM ({_PLACED}))""", "fx_bullets fx_resumes fx_jd_keywords")
def keywords_integrated(v):
    """The first keyword of the requirement, as a name, and the second, as a way of working, placed in every bullet."""
    from .scores import _keywords, _pairs

    shown = F.when(F.col("rnk") == 1, F.concat(F.upper(F.substring("keyword", 1, 1)), F.substring("keyword", 2, 2**31 - 1))).otherwise(F.concat(F.lit("rest "), "keyword"))
    words = _keywords(v).where("rnk <= 2").select(F.col("jd_id").alias("__j"), shown.alias("keyword"))
    wanted = _pairs(v).join(words, F.col("jd_id") == F.col("__j")).select(F.col("resume_id").alias("__r"), "keyword")
    rows = v.bullets.join(wanted, F.col("resume_id") == F.col("__r")).withColumn("x", w.integrated(F.col("text"), F.col("keyword"), STRONG, CONTEXTS))
    return rows.select("resume_id", "pos", "keyword", F.md5(F.col("x.improved").cast("binary")).alias("digest"), "x.confidence", "x.integrated")


@query("metric_families", "SELECT resume_id, count(*) AS bullets, " + ", ".join(f"count_if(regexp_matches(text, {_quoted(p)})) AS {name}" for name, p in f.METRIC_FAMILIES.items()) + " FROM fx_bullets GROUP BY resume_id", "fx_bullets")
def metric_families(v):
    counts = [F.count_if(F.col("text").rlike(f.ascii_bounds(p))).alias(name) for name, p in f.METRIC_FAMILIES.items()]
    return v.bullets.groupBy("resume_id").agg(F.count(F.lit(1)).alias("bullets"), *counts)


@query("bullet_flags", rf"""SELECT resume_id, pos, concat_ws(',', CASE WHEN list_contains(['with', 'than', 'then'], verb) THEN 'weak_verb' END, CASE WHEN NOT list_contains(['that', 'this', 'from'], verb) THEN 'no_verb' END,
CASE WHEN NOT regexp_matches(text, '[0-9]') THEN 'no_metrics' END, CASE WHEN len(string_split_regex(trim(text), '\s+')) < 5 THEN 'too_short' END) AS issues FROM (SELECT *, lower(string_split_regex(trim(text), '\s+')[1]) AS verb FROM fx_bullets)""", "fx_bullets")
def bullet_flags(v):
    """What a bullet lacks: a verb that is not weak, a number, length."""
    verb = F.lower(F.get(F.split(F.trim("text"), "\\s+"), F.lit(0)))
    tests = (("weak_verb", verb.isin("with", "than", "then")), ("no_verb", ~verb.isin("that", "this", "from")), ("no_metrics", ~F.col("text").rlike("[0-9]")), ("too_short", F.size(F.split(F.trim("text"), "\\s+")) < 5))
    return v.bullets.select("resume_id", "pos", F.concat_ws(",", *[F.when(test, name) for name, test in tests]).alias("issues"))


_OPEN = " OR ".join(f"contains(improved_text, {_quoted(m)})" for m in w.PLACEHOLDERS)


@query("auto_applicable", f"""SELECT resume_id, rank, type, coalesce(improved_text <> '', false) AND CASE type WHEN 'keyword' THEN NOT contains(improved_text, '(e.g.,') WHEN 'action_verb' THEN NOT ({_OPEN}) ELSE false END AS applicable FROM ({_SUGGESTED})""", "fx_tokens fx_jd_keywords fx_bullets fx_lines fx_features fx_resumes")
def auto_applicable(v):
    return _suggested(v).select("resume_id", "rank", "type", w.auto_applicable(F.col("type"), F.col("improved_text"), F.lit(False)).alias("applicable"))


@query("suggestion_parts", r"""SELECT resume_id, pos, len(parts) AS n, array_to_string(parts, '|') AS parts FROM (SELECT resume_id, pos, CASE WHEN len(regexp_extract_all(text, '"([^"]+)"', 1)) > 0 THEN regexp_extract_all(text, '"([^"]+)"', 1)
ELSE list_filter(list_transform(string_split_regex(text, '\s*(,|;|\band\b)\s*'), lambda x: trim(x)), lambda x: x <> '') END AS parts FROM fx_bullets)""", "fx_bullets")
def suggestion_parts(v):
    """Skills read out of a sentence: what stands in quotes, else its parts."""
    parts = r.quoted_or_listed(F.col("text"))
    return v.bullets.select("resume_id", "pos", F.size(parts).alias("n"), F.array_join(parts, "|").alias("parts"))
