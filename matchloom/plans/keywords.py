"""Queries of keyword extraction, canonical keywords, sections and classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dictionaries import STOP_WORDS, TECHNICAL_POINTS
from ..operators import extraction as x
from ..operators.dashboards import top_k
from ..sources.fixtures import STOP, SYNONYMS
from ._register import query

CATEGORIES = [("language", ["ation", "ment"]), ("practice", ["ther", "ing"]), ("tool", ["elle", "ver"])]
NAMES = {"rest": "REST API", "ther": "Thermal", "ment": "Mention", "with": "WITH"}
IGNORED = ["that", "from", "than", "avec"]
TECHNICAL = {"api": ["rest api", "rest"], "heat": ["thermal", "thation"], "short": ["er", "on"]}


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _norm(column: str) -> str:
    from .scores import _norm as norm

    return norm(column)


_STOPS = _list(STOP_WORDS)
_POINTS = " + ".join(f"CASE WHEN regexp_matches(keyword, '{p}') THEN {n * 10} ELSE 0 END" for p, n in TECHNICAL_POINTS).replace("\\\\", "\\")
_CANDIDATES = f"""SELECT jd_id, keyword, min(ord) AS ord FROM (
  SELECT jd_id, unnest(g) AS keyword, unnest(range(0, len(g))) AS ord FROM (
    SELECT jd_id, list_concat(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), w) AS g FROM (
      SELECT jd_id, list_filter(string_split({_norm('jd_text')}, ' '), lambda t: t <> '' AND NOT list_contains({_STOPS}, t)) AS w FROM fx_jds))) GROUP BY 1, 2"""


@query("jd_candidates_ranked", f"""SELECT jd_id, keyword, points, rank FROM (SELECT *, row_number() OVER (PARTITION BY jd_id ORDER BY points DESC, ord) AS rank FROM (
SELECT *, len(string_split(keyword, ' ')) * 20 + length(keyword) + {_POINTS} AS points FROM ({_CANDIDATES}))) WHERE rank <= 20""", "fx_jds")
def jd_candidates_ranked(v):
    return x.ranked_candidates(x.candidates(v.jds, "jd_id", "jd_text", STOP_WORDS), "jd_id", TECHNICAL_POINTS, 20)


def _category_sql() -> str:
    out = ""
    for name, terms in CATEGORIES:
        out += " WHEN " + " OR ".join(f"contains(keyword, '{t}') OR contains('{t}', keyword)" for t in terms) + f" THEN '{name}'"
    return f"CASE{out} ELSE 'general' END"


def _canonical_sql() -> str:
    return "CASE" + "".join(f" WHEN list_contains({_list(forms)}, keyword) THEN '{name}'" for name, forms in SYNONYMS.items()) + " ELSE keyword END"


_PHRASES = f"""SELECT jd_id, keyword, count(*) AS frequency, min(ord) AS ord, count(*) * len(string_split(keyword, ' ')) AS score FROM (
  SELECT jd_id, pos - 1 AS ord, token AS keyword FROM fx_jd_tokens
  UNION ALL SELECT jd_id, pos - 1, token || ' ' || lead(token) OVER (PARTITION BY jd_id ORDER BY pos) FROM fx_jd_tokens)
WHERE keyword IS NOT NULL AND len(list_filter(string_split(keyword, ' '), lambda t: length(t) < 4 OR list_contains({_list(STOP)}, t))) = 0 GROUP BY 1, 2"""
_INSIDE = "coalesce(contains(CASE WHEN instr(lower(jd_text), '{0}') > 0 THEN substr(lower(jd_text), instr(lower(jd_text), '{0}'), {1}) END, keyword), false)"
_ENHANCED = f"""SELECT jd_id, keyword, frequency, category, importance, canonical, rank FROM (
SELECT *, row_number() OVER (PARTITION BY jd_id ORDER BY score DESC, ord, keyword) AS rank FROM (
SELECT *, row_number() OVER (PARTITION BY jd_id, canonical ORDER BY score DESC, ord, keyword) AS n FROM (
SELECT p.*, {_category_sql()} AS category, {_canonical_sql()} AS canonical,
  CASE WHEN {_INSIDE.format('ther', 60)} THEN 'Nice_to_have' WHEN {_INSIDE.format('rest', 60)} OR frequency >= 3 THEN 'Critical' WHEN frequency = 2 THEN 'Important' ELSE 'Nice_to_have' END AS importance
FROM ({_PHRASES}) p JOIN fx_jds USING (jd_id))) WHERE n = 1) WHERE rank <= 25"""


@query("jd_keywords_enhanced", _ENHANCED, "fx_jd_tokens fx_jds")
def jd_keywords_enhanced(v):
    found = x.frequent_phrases(v.jds, "jd_id", "jd_text", STOP)
    texts = v.jds.select(F.col("jd_id").alias("__j"), "jd_text")
    rows = x.with_importance(x.categorised(found, CATEGORIES).join(texts, F.col("jd_id") == F.col("__j")), "jd_text", "rest", "ther", 60)
    rows = x.without_synonyms(rows, "jd_id", SYNONYMS)
    ranked = top_k(rows, "jd_id", [F.desc("score"), F.asc("ord"), F.asc("keyword")], 25)
    return ranked.select("jd_id", "keyword", "frequency", "category", "importance", "canonical", "rank")


def _names_sql() -> str:
    return "CASE" + "".join(f" WHEN low = '{k}' THEN '{n}'" for k, n in NAMES.items()) + f" WHEN length(low) >= 3 OR list_contains({_list(sorted({t for v in TECHNICAL.values() for t in v}))}, low) THEN keyword END"


@query("canonical_keywords", f"""SELECT jd_id, shown AS keyword, CASE WHEN tech THEN 8 ELSE 3 END AS priority_tenths,
CASE {" ".join(f"WHEN list_contains({_list(v)}, lower(shown)) THEN '{k}'" for k, v in TECHNICAL.items())} END AS category, tech AS is_technical FROM (
SELECT *, list_contains({_list(sorted({t for v in TECHNICAL.values() for t in v}))}, lower(shown)) AS tech, row_number() OVER (PARTITION BY jd_id, lower(shown) ORDER BY pos) AS n FROM (
SELECT jd_id, pos, token AS keyword, lower(trim(token)) AS low, {_names_sql()} AS shown FROM (SELECT jd_id, pos, token, token AS keyword, lower(trim(token)) AS low FROM fx_jd_tokens)) WHERE NOT list_contains({_list(IGNORED)}, low) AND shown IS NOT NULL) WHERE n = 1""", "fx_jd_tokens")
def canonical_keywords(v):
    from ..operators.matching import token_rows

    rows = token_rows(v.jds, "jd_id", "jd_text").select("jd_id", F.col("token").alias("keyword"), F.col("pos").alias("ord"))
    return x.canonical_keywords(rows, "jd_id", IGNORED, NAMES, TECHNICAL)


@query("section_items", """SELECT resume_id, row_number() OVER (PARTITION BY resume_id ORDER BY pos) AS place, text FROM (
SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY resume_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS open FROM (
SELECT *, CASE WHEN regexp_matches(text, '(?i)rest') THEN 1 WHEN regexp_matches(text, '^[A-D]') THEN 0 END AS mark FROM fx_bullets)) WHERE open = 1 AND mark IS NULL AND regexp_matches(text, '^[E-Z]') QUALIFY place <= 10""", "fx_bullets")
def section_items(v):
    return x.section_items(v.bullets.select("resume_id", "pos", "text"), "resume_id", "(?i)rest", "^[E-Z]", "^[A-D]", 10)


@query("jd_lines", r"""SELECT jd_id, len(y) AS n_lines, array_to_string(y[1:8], '|') AS lines FROM (SELECT jd_id, list_filter(list_transform(list_filter(list_transform(string_split(jd_text, chr(10)), lambda l: trim(l)),
lambda l: length(l) > 15 AND length(l) < 400 AND (regexp_matches(l, '^[-•*]\s+') OR regexp_matches(l, '^\d+\.\s+') OR regexp_matches(l, '(?i)^(the|on|in|re|an)')) AND NOT regexp_matches(l, '(?i)^(there|ander)')),
lambda l: trim(regexp_replace(regexp_replace(l, '^[-•*]\s+', ''), '^\d+\.\s+', ''))), lambda l: length(l) > 10) AS y FROM fx_jds)""", "fx_jds")
def jd_lines(v):
    keep = lambda l: (F.length(l) > 15) & (F.length(l) < 400) & (l.rlike("^[-•*]\\s+") | l.rlike("^\\d+\\.\\s+") | l.rlike("(?i)^(the|on|in|re|an)")) & ~l.rlike("(?i)^(there|ander)")  # noqa: E731, E741
    lines = F.filter(F.transform(F.split("jd_text", "\n"), lambda l: F.trim(l)), keep)  # noqa: E741
    bare = F.filter(F.transform(lines, lambda l: F.trim(F.regexp_replace(F.regexp_replace(l, "^[-•*]\\s+", ""), "^\\d+\\.\\s+", ""))), lambda l: F.length(l) > 10)  # noqa: E741
    return v.jds.select("jd_id", F.size(bare).alias("n_lines"), F.array_join(F.slice(bare, 1, 8), "|").alias("lines"))


@query("jd_metadata", r"""SELECT jd_id, len(string_split_regex(jd_text, '\s+')) AS n_words, regexp_matches(jd_text, '(?i)ther|elle') AS has_education, regexp_matches(jd_text, '(?i)rest|ing') AS has_experience, left(jd_text, 200) AS summary FROM fx_jds""", "fx_jds")
def jd_metadata(v):
    return v.jds.select("jd_id", F.size(F.split("jd_text", "\\s+")).alias("n_words"), F.col("jd_text").rlike("(?i)ther|elle").alias("has_education"), F.col("jd_text").rlike("(?i)rest|ing").alias("has_experience"), F.substring("jd_text", 1, 200).alias("summary"))


@query("jd_titles", r"""SELECT jd_id, coalesce(nullif(trim(regexp_extract(jd_text, '(?i)(?:the|of)\s+([^\n,\.]+?)(?:tion|ing)', 1)), ''), nullif(trim(regexp_extract(jd_text, '(?im)^([^\n,\.]+?)(?:er|ou)', 1)), ''), 'Software Engineer') AS title FROM fx_jds""", "fx_jds")
def jd_titles(v):
    return v.jds.select("jd_id", x.first_match(F.col("jd_text"), ["(?i)(?:the|of)\\s+([^\\n,\\.]+?)(?:tion|ing)", "(?im)^([^\\n,\\.]+?)(?:er|ou)"], "Software Engineer").alias("title"))


@query("resume_levels", "SELECT resume_id, CASE WHEN regexp_matches(text, '(?i)thation') THEN 'lead' WHEN regexp_matches(text, '(?i)elle|keit') THEN 'senior' WHEN regexp_matches(text, '(?i)rest') THEN 'mid' ELSE 'entry' END AS level FROM fx_resumes", "fx_resumes")
def resume_levels(v):
    return v.resumes.select("resume_id", x.labelled(F.col("text"), [("(?i)thation", "lead"), ("(?i)elle|keit", "senior"), ("(?i)rest", "mid")], "entry").alias("level"))


@query("skill_sources", """SELECT resume_id, source, count(*) AS n FROM (SELECT resume_id, skill, min_by(source, ord) AS source FROM (
SELECT resume_id, token AS skill, 0 AS ord, 'opening' AS source FROM fx_tokens WHERE pos <= 10 UNION ALL SELECT resume_id, token, 1, 'body' FROM fx_tokens WHERE pos > 10 UNION ALL SELECT resume_id, lower(title), 2, 'title' FROM fx_resumes) GROUP BY 1, 2) GROUP BY 1, 2""", "fx_tokens fx_resumes")
def skill_sources(v):
    from ..operators.matching import token_rows

    rows = token_rows(v.resumes, "resume_id", "text").withColumnRenamed("token", "skill")
    return x.distinct_skills([("opening", rows.where("pos <= 10")), ("body", rows.where("pos > 10")), ("title", v.resumes.select("resume_id", F.col("title").alias("skill")))], "resume_id")


@query("skills_missing_from_text", "SELECT k.jd_id, k.keyword, k.weight FROM fx_jd_keywords k ANTI JOIN (SELECT DISTINCT t.token, r.jd_id FROM fx_tokens t JOIN fx_resumes r USING (resume_id)) m ON m.jd_id = k.jd_id AND m.token = k.keyword", "fx_jd_keywords fx_tokens fx_resumes")
def skills_missing_from_text(v):
    from ..operators.matching import token_rows
    from .scores import _keywords

    used = token_rows(v.resumes, "resume_id", "text").join(v.resumes.select(F.col("resume_id").alias("__r"), "jd_id"), F.col("resume_id") == F.col("__r")).select(F.col("jd_id").alias("__j"), F.col("token").alias("__t")).distinct()
    return _keywords(v).join(used, (F.col("jd_id") == F.col("__j")) & (F.col("keyword") == F.col("__t")), "left_anti").select("jd_id", "keyword", "weight")
