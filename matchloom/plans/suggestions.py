"""Queries of suggestions, rewriting, application and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features, rewriting as r, suggestions as s, validation as q
from ..sources.fixtures import VERBS
from . import component_sql
from ._register import query

#: Weak openings and topics that occur in the given documents.
OPENINGS = (("the ", "Led"), ("and ", "Built"), ("than ", "Drove"), ("de ", "Made"), ("in ", "Ran"))
STRONG = ["led", "built", "is"]
TAILS = (("api|rest|ther", ", in half the time."), ("elle|ment", ", for all users."))
OTHER = ", with less effort."
METRIC = "[0-9]{2}|%"
ADVICE = "Say in two sentences what you do best."
LAYOUT = "Give every section a heading."

#: A capital is the full one, as in the reference's toUpperCase: SS for ß, FI for ﬁ. DuckDB's upper knows those of one character only,
#: and none that Unicode 16 has brought (five letters, and the Garay script's).
_LONG_CAPITALS = {c: c.upper() for c in map(chr, range(0x80, 0x10000)) if len(c.upper()) > 1}
_LONG_CAPITALS |= {"\u019b": "\ua7dc", "\u0264": "\ua7cb", "\u1c8a": "\u1c89", "\ua7cd": "\ua7cc", "\ua7db": "\ua7da"} | {chr(c): chr(c - 0x20) for c in range(0x10D70, 0x10D86)}
_CAP = "CASE substr({0}, 1, 1)" + "".join(f" WHEN '{c}' THEN '{x}'" for c, x in _LONG_CAPITALS.items()) + " ELSE upper(substr({0}, 1, 1)) END || substr({0}, 2)"


def _opening_sql(column: str, openings, gerund=()) -> str:
    out = ""
    for weak, strong in openings:
        rest = f"trim(substr({column}, {len(weak) + 1}))"
        out += f" WHEN starts_with(lower(replace({column}, 'İ', 'i\u0307')), '{weak}') THEN '{strong} ' || {_CAP.format(rest)}"
    return f"CASE{out} END"


def _tail_sql(column: str) -> str:
    whens = "".join(f" WHEN regexp_matches({column}, '(?i){p}') THEN '{t}'" for p, t in TAILS)
    return rf"regexp_replace(trim({column}), '\.\s*$', '') || CASE{whens} ELSE '{OTHER}' END"


@query("bullet_rewrites", f"""SELECT resume_id, pos, {_opening_sql('text', OPENINGS)} AS rewritten FROM fx_bullets WHERE {_opening_sql('text', OPENINGS)} IS NOT NULL""", "fx_bullets")
def bullet_rewrites(v):
    return v.bullets.select("resume_id", "pos", r.replace_opening(F.col("text"), OPENINGS).alias("rewritten")).where("rewritten IS NOT NULL")


@query("bullet_metric_tails", f"SELECT resume_id, pos, md5({_tail_sql('text')}) AS digest FROM fx_bullets WHERE NOT regexp_matches(text, '{METRIC}')", "fx_bullets")
def bullet_metric_tails(v):
    rows = v.bullets.where(~F.col("text").rlike(METRIC))
    return rows.select("resume_id", "pos", F.md5(r.with_metric_tail(F.col("text"), TAILS, OTHER).cast("binary")).alias("digest"))


@query("bullet_punctuation", r"SELECT resume_id, pos, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\.,', ',', 'g'), '\.\.', '.', 'g'), ',\.', '.', 'g'), '\s+,', ',', 'g'), '\s+\.', '.', 'g'))) AS digest FROM fx_bullets", "fx_bullets")
def bullet_punctuation(v):
    return v.bullets.select("resume_id", "pos", F.md5(r.fix_punctuation(F.col("text")).cast("binary")).alias("digest"))


def _sanitised_sql(column: str) -> str:
    out = column
    for p in r.UNFOUNDED:
        out = f"regexp_replace({out}, '{p}', '', 'g')"
    for p, new in ((r"\.\s*\.", "."), (r",\s*\.", "."), (r"\s{2,}", " ")):
        out = f"regexp_replace({out}, '{p}', '{new}', 'g')"
    return f"trim({out})"


@query("bullet_sanitised", f"SELECT resume_id, pos, md5(CASE WHEN x <> '' AND NOT regexp_matches(x, '[.!?]$') THEN x || '.' ELSE x END) AS digest FROM (SELECT resume_id, pos, {_sanitised_sql('text')} AS x FROM fx_bullets)", "fx_bullets")
def bullet_sanitised(v):
    return v.bullets.select("resume_id", "pos", F.md5(r.sanitised(F.col("text")).cast("binary")).alias("digest"))


@query("bullet_cleaned", rf"""SELECT resume_id, pos, md5(CASE WHEN y <> '' AND NOT regexp_matches(y, '[.!?]$') THEN y || '.' ELSE y END) AS digest FROM (
SELECT resume_id, pos, {_CAP.format("array_to_string(list_filter(ws, lambda x, i: i = 1 OR lower(x) <> lower(ws[i - 1])), ' ')")} AS y FROM (
SELECT resume_id, pos, string_split(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '\.+', '.', 'g'), '!+', '!', 'g'), '\?+', '?', 'g'), ',+', ',', 'g')), ' ') AS ws FROM fx_bullets))""", "fx_bullets")
def bullet_cleaned(v):
    return v.bullets.select("resume_id", "pos", F.md5(r.cleaned_bullet(F.col("text")).cast("binary")).alias("digest"))


_WORDS = r"list_filter(list_transform(string_split_regex(lower(text), '\s+'), lambda x: regexp_replace(x, '[^\w\-]', '', 'g')), lambda x: x <> '')"
_LISTED = "['the', 'of', 'and', 'de', 'la']"


@query("bullet_grammar", rf"""SELECT resume_id, pos, concat_ws(',', CASE WHEN trim(text) = '' THEN 'empty' END, CASE WHEN list_contains({_LISTED}, coalesce(ws[1], '')) AND list_contains({_LISTED}, coalesce(ws[2], '')) THEN 'double_verb' END,
CASE WHEN regexp_matches(text, '(?i)^(integrated|handled|processed|managed|coordinated|worked)\s+(analyze|create|build|develop)') THEN 'bad_combination' END,
CASE WHEN len(string_split_regex(text, '\s+')) < 4 THEN 'too_short' END, CASE WHEN regexp_matches(trim(text), '(?i)^(to |with |using |for )') THEN 'preposition' END) AS issues FROM (SELECT *, {_WORDS} AS ws FROM fx_bullets)""", "fx_bullets")
def bullet_grammar(v):
    return v.bullets.select("resume_id", "pos", r.grammar_issues(F.col("text"), ["the", "of", "and", "de", "la"]).alias("issues"))


@query("bullet_keyword_inserted", """SELECT resume_id, pos, md5(CASE WHEN contains(text, 'rest') THEN text WHEN contains(text, 'technologies') THEN replace(text, 'technologies', 'technologies including rest')
WHEN contains(text, 'using') THEN left(text, instr(text, 'using') - 1) || 'using rest and' || substr(text, instr(text, 'using') + 5) ELSE left(text, length(text) - 1) || ', leveraging rest' END) AS digest FROM fx_bullets""", "fx_bullets")
def bullet_keyword_inserted(v):
    return v.bullets.select("resume_id", "pos", F.md5(r.insert_keyword(F.col("text"), F.lit("rest")).cast("binary")).alias("digest"))


@query("duplicate_bullets", "SELECT resume_id, count(*) AS bullets, count(*) - count(DISTINCT lower(text)) AS duplicates FROM fx_bullets GROUP BY resume_id", "fx_bullets")
def duplicate_bullets(v):
    return v.bullets.groupBy("resume_id").agg(F.count(F.lit(1)).alias("bullets"), (F.count(F.lit(1)) - F.count_distinct(F.lower("text"))).alias("duplicates"))


@query("first_bullets", "SELECT resume_id, pos, text FROM (SELECT *, row_number() OVER (PARTITION BY resume_id, lower(trim(text)) ORDER BY pos) AS rn FROM fx_bullets) WHERE rn = 1", "fx_bullets")
def first_bullets(v):
    from ..operators.dashboards import first_of

    return first_of(v.bullets, [F.col("resume_id"), F.lower(F.trim("text"))], [F.asc("pos")]).select("resume_id", "pos", "text")


_TAKEN = f"""SELECT resume_id, 2 AS branch, ord, 'action_verb' AS type, 'experience' AS section, pos, text AS current_text, rewritten AS improved_text, 'medium' AS impact FROM (
  SELECT *, row_number() OVER (PARTITION BY resume_id ORDER BY pos) AS ord FROM (SELECT *, CASE WHEN NOT list_contains(['led', 'built', 'is'], regexp_replace(lower(string_split_regex(trim(text), '\\s+')[1]), '[^a-z]', '', 'g')) THEN {_opening_sql('text', OPENINGS)} END AS rewritten FROM fx_bullets)
  WHERE rewritten IS NOT NULL AND rewritten <> text) WHERE ord <= 3"""
_MISSING = "SELECT p.resume_id, k.keyword, k.rnk FROM (SELECT resume_id, jd_id FROM fx_resumes WHERE jd_id IS NOT NULL) p JOIN fx_jd_keywords k USING (jd_id) ANTI JOIN (SELECT DISTINCT resume_id, token FROM fx_tokens) t ON t.resume_id = p.resume_id AND t.token = k.keyword"
_SUGGESTED = f"""
WITH kw AS (SELECT resume_id, 1 AS branch, ord, 'keyword' AS type, 'skills' AS section, NULL::BIGINT AS pos, 'Skills section' AS current_text, keyword AS improved_text, 'high' AS impact FROM (SELECT *, row_number() OVER (PARTITION BY resume_id ORDER BY rnk) AS ord FROM ({_MISSING})) WHERE ord <= 2),
vb AS ({_TAKEN}),
mt AS (SELECT resume_id, 3 AS branch, ord, 'experience' AS type, 'experience' AS section, pos, text AS current_text, {_tail_sql('text')} AS improved_text, 'high' AS impact FROM (
  SELECT *, row_number() OVER (PARTITION BY resume_id ORDER BY pos) AS ord FROM fx_bullets b WHERE NOT regexp_matches(text, '{METRIC}') AND NOT EXISTS (SELECT 1 FROM vb WHERE vb.resume_id = b.resume_id AND vb.pos = b.pos)) WHERE ord = 1),
sm AS (SELECT resume_id, 4 AS branch, 1 AS ord, 'summary' AS type, 'summary' AS section, NULL::BIGINT AS pos, CASE WHEN x = '' THEN '(No summary)' ELSE x END AS current_text, '{ADVICE}' AS improved_text, 'medium' AS impact FROM (SELECT resume_id, coalesce(lines[1], '') AS x FROM fx_lines) WHERE length(x) < 100),
st AS (SELECT resume_id, 5 AS branch, 1 AS ord, 'formatting' AS type, 'structure' AS section, NULL::BIGINT AS pos, 'Resume structure' AS current_text, '{LAYOUT}' AS improved_text, 'medium' AS impact FROM (SELECT resume_id, CAST({component_sql.COMPONENTS["formatting"]["live"]} AS BIGINT) AS fmt FROM fx_features) WHERE fmt < 70),
every AS (SELECT * FROM kw UNION ALL SELECT * FROM vb UNION ALL SELECT * FROM mt UNION ALL SELECT * FROM sm UNION ALL SELECT * FROM st)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY resume_id ORDER BY branch, ord) AS rank FROM every) WHERE rank <= 6"""


def _suggested(v):
    from .scores import _matches

    missing = _matches(v).where(~F.col("matched")).select("resume_id", "keyword", "rnk")
    verbs = s.verb_rows(v.bullets, OPENINGS, STRONG)
    metrics = s.metric_rows(v.bullets, verbs, METRIC, TAILS, OTHER)
    summary = v.lines.select("resume_id", F.coalesce(F.try_element_at("lines", F.lit(1)), F.lit("")).alias("summary"))
    fmt = features.scores(features.resume_features(v.lines, VERBS["strong"], VERBS["weak"]), "formatting").select("resume_id", F.col("live").alias("formatting"))
    return s.ranked([s.keyword_rows(missing), verbs, metrics, s.summary_rows(summary, ADVICE), s.structure_rows(fmt, LAYOUT)])


@query("suggestions_live", _SUGGESTED, "fx_tokens fx_jd_keywords fx_bullets fx_lines fx_features fx_resumes")
def suggestions_live(v):
    return _suggested(v)


@query("suggestion_impacts", f"SELECT type, impact, count(*) AS n FROM ({_SUGGESTED}) GROUP BY 1, 2", "fx_tokens fx_jd_keywords fx_bullets fx_lines fx_features fx_resumes")
def suggestion_impacts(v):
    return _suggested(v).groupBy("type", "impact").agg(F.count(F.lit(1)).alias("n"))


@query("suggestions_applied", f"""SELECT b.resume_id, b.pos, md5(coalesce(s.improved_text, b.text)) AS digest, s.improved_text IS NOT NULL AS changed FROM fx_bullets b
LEFT JOIN ({_SUGGESTED}) s ON s.resume_id = b.resume_id AND s.pos = b.pos AND s.current_text = b.text""", "fx_tokens fx_jd_keywords fx_bullets fx_lines fx_features fx_resumes")
def suggestions_applied(v):
    rows = s.applied(v.bullets.select("resume_id", "pos", "text"), _suggested(v))
    return rows.select("resume_id", "pos", F.md5(F.col("text").cast("binary")).alias("digest"), "changed")


@query("user_violations", f"""SELECT user_id, concat_ws(',', CASE WHEN coalesce(trim(name) = '', true) THEN 'name_missing' END, CASE WHEN length(coalesce(name, '')) < 2 OR length(coalesce(name, '')) > 17 THEN 'name_length' END,
CASE WHEN NOT coalesce(regexp_matches(email, '{q.EMAIL}'), false) THEN 'email' END, CASE WHEN NOT coalesce(role IN ('USER'), false) THEN 'role' END, CASE WHEN user_id < 10 OR user_id > 1400 THEN 'id_range' END) AS violations FROM fx_users""", "fx_users")
def user_violations(v):
    rules = {"name_missing": q.required("name"), "name_length": q.length_outside("name", 2, 17), "email": q.not_like("email", q.EMAIL), "role": q.not_in("role", ["USER"]), "id_range": q.outside("user_id", 10, 1400)}
    return q.with_violations(v.users, rules).select("user_id", "violations")


@query("jd_validation", "SELECT jd_id, concat_ws(',', CASE WHEN length(coalesce(jd_text, '')) < 200 OR length(coalesce(jd_text, '')) > 50000 THEN 'length' END, CASE WHEN coalesce(trim(jd_text) = '', true) THEN 'missing' END) AS violations FROM fx_jds", "fx_jds")
def jd_validation(v):
    return q.with_violations(v.jds, {"length": q.length_outside("jd_text", 200, 50_000), "missing": q.required("jd_text")}).select("jd_id", "violations")


@query("clean_resumes", "SELECT resume_id, title FROM fx_resumes WHERE template IN ('classic', 'fresher', 'tech') AND length(text) BETWEEN 100 AND 20000", "fx_resumes")
def clean_resumes(v):
    clean, _ = q.split(v.resumes, {"template": q.not_in("template", ["classic", "fresher", "tech"]), "length": q.length_outside("text", 100, 20_000)})
    return clean.select("resume_id", "title")


@query("quarantined_resumes", "SELECT resume_id, concat_ws(',', CASE WHEN template NOT IN ('classic', 'fresher', 'tech') THEN 'template' END, CASE WHEN length(text) NOT BETWEEN 100 AND 20000 THEN 'length' END) AS violations FROM fx_resumes WHERE NOT (template IN ('classic', 'fresher', 'tech') AND length(text) BETWEEN 100 AND 20000)", "fx_resumes")
def quarantined_resumes(v):
    _, bad = q.split(v.resumes, {"template": q.not_in("template", ["classic", "fresher", "tech"]), "length": q.length_outside("text", 100, 20_000)})
    return bad.select("resume_id", "violations")


