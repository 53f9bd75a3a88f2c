"""Queries of features, component scores, keyword matches and composites."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as f
from ..operators import matching as m
from ..sources.fixtures import NEEDS, ROLES, SQL, STOP, SYNONYMS, VERBS
from . import component_sql as c
from ._register import query

_STRONG = "[" + ", ".join(f"'{w}'" for w in VERBS["strong"]) + "]"
_WEAK = "[" + ", ".join(f"'{w}'" for w in VERBS["weak"]) + "]"
_FIRST = r"lower(string_split_regex(trim(x), '\s+')[1])"
_SECOND = r"lower(string_split_regex(trim(x), '\s+')[2])"
_IS_STRONG, _IS_WEAK = f"coalesce(list_contains({_STRONG}, {_FIRST}), false)", f"coalesce(list_contains({_WEAK}, {_FIRST}), false)"
_DOUBLE = f"({_IS_STRONG} AND coalesce(list_contains({_STRONG}, {_SECOND}), false))"
_NWORDS = r"len(list_filter(string_split_regex(x, '\s+'), lambda w: w <> ''))"
_METRIC = f"regexp_matches(x, '{f.METRIC}')".replace("\\\\", "\\")


def _n(test: str) -> str:
    return f"len(list_filter(bullets, lambda x: {test}))"


def _norm(column: str) -> str:
    out = f"lower({column})"
    for pattern in (r"<[^>]*>", r"https?://[^\s]+", r"[^\s@]+@[^\s@]+\.[^\s@]+", r"[a-zA-Z]:[\\/][^\s]*", r"/[a-zA-Z0-9_./\-]*", r"\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}", r"[^a-z0-9\s\-._/]"):
        out = f"regexp_replace({out}, '{pattern}', ' ', 'g')"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


NEEDS["fx_features"] = ["fx_lines"]
SQL["fx_features"] = f"""
SELECT a.*, CAST(CASE WHEN norm_sentences > 0 AND norm_words > 0 THEN floor(0.5 + 1.0 * norm_chars / norm_sentences) ELSE 0 END AS BIGINT) AS chars_a_sentence, coalesce(r.repeated, 0) AS repeated, coalesce(r.repeated_long, 0) AS repeated_long, coalesce(q.repeated_plain, 0) AS repeated_plain FROM (
SELECT resume_id, length(trim(summary)) AS summary_len, len(list_filter(string_split_regex(summary, '\\s+'), lambda w: w <> '')) AS summary_words,
  len(regexp_extract_all(summary, '[!@#$%^&*()_+=\\[\\]{{}};:''",.<>?/\\\\]')) AS summary_signs,
  {c.MORE_FEATURES.format(strong=_IS_STRONG, metric=_METRIC, verbs='|'.join(VERBS['strong']))},
  len(bullets) AS nb, CAST(ceil(len(bullets) / 3.0) AS BIGINT) AS n_items,
  {_n("length(x) > 20 AND length(x) < 200")} AS ok_len, {_n("length(x) > 180")} AS over_180, {_n("length(x) > 140 AND length(x) <= 180")} AS over_140, {_n("length(x) > 200")} AS over_200,
  {_n("length(x) < 30")} AS under_30, {_n("length(x) > 300 AND NOT contains(x, '.')")} AS long_block,
  {_n(_NWORDS + " > 20")} AS words_over_20, {_n(_NWORDS + " > 35")} AS words_over_35, {_n(_NWORDS + " > 150")} AS words_over_150,
  coalesce(list_sum(list_transform(bullets, lambda x: length(x))), 0)::BIGINT AS sum_len, coalesce(list_sum(list_transform(bullets, lambda x: {_NWORDS})), 0)::BIGINT AS sum_words,
  {_n(_IS_STRONG)} AS strong_first, {_n(_IS_WEAK)} AS weak_first, {_n(_DOUBLE)} AS double_verb, {_n(_IS_WEAK + " OR " + _DOUBLE)} AS weak_or_double,
  {_n(f"{_IS_STRONG} AND NOT {_DOUBLE} AND {_METRIC}")} AS strong_metric, {_n(f"NOT {_IS_STRONG} AND NOT {_IS_WEAK} AND {_NWORDS} >= 5")} AS plain_long,
  {_n(" OR ".join(f"contains(lower(x), '{w}')" for w in VERBS["strong"]))} AS any_strong,
  {_n(f"list_has_any(string_split({_norm('x')}, ' '), {_STRONG})")} AS any_token,
  {_n(_METRIC)} AS metric, {_n("regexp_matches(x, '[0-9]')")} AS digit, {_n("regexp_matches(x, '^[A-Za-z]')")} AS alpha_first, {_n("NOT regexp_matches(x, '[.!?]$')")} AS no_end,
  len(bullets) - len(list_distinct(list_transform(bullets, lambda x: lower(x)))) AS dup_bullets, len(regexp_extract_all(whole, '[A-Z]{{2,}}')) AS abbreviations,
  contains(whole, '|') AS pipes, regexp_matches(whole, '\\|.+\\|') AS table_row, regexp_matches(whole, '[*_~`#=]{{3,}}') AS decoration, regexp_matches(whole, '[*_~`#]{{5,}}') AS decoration5,
  {_n(_NWORDS + " > 25")} AS words_over_25, {_n(_NWORDS + " < 5")} AS words_under_5, {_n(_NWORDS + " <= 2")} AS words_to_2, {_n("length(trim(x)) < 5")} AS tiny,
  {_n(f"{_NWORDS} >= 8 AND {_NWORDS} <= 20 AND {_METRIC}")} AS structured, {_n("regexp_matches(x, '^(and|or|the|a) ')")} AS weak_opening, {_n(f"{_IS_STRONG} AND {_METRIC}")} AS strong_any_metric,
  len(list_distinct(list_transform(list_filter(bullets, lambda x: {_IS_STRONG}), lambda x: {_FIRST}))) AS distinct_strong, len(regexp_extract_all(whole, '[*_%#~`@]')) AS special_signs,
  regexp_matches(whole, '\\|.*\\|') AS pipe_pair, regexp_matches(whole, '\\|\\s*\\w+\\s*\\|') AS pipe_cell,
  len(list_filter(string_split(norm, ' '), lambda x: x <> '')) AS norm_words, len(list_filter(list_transform(string_split_regex(norm, '[.!?]+'), lambda x: trim(x)), lambda x: x <> '')) AS norm_sentences
FROM (SELECT *, coalesce(lines[1], '') AS summary, lines[2:] AS bullets, array_to_string(lines, ' ') AS whole, {_norm("array_to_string(lines, ' ')")} AS norm FROM fx_lines)) a
LEFT JOIN (SELECT resume_id, count(*) AS repeated, count_if(n > 5 AND length(w) > 3) AS repeated_long FROM (SELECT resume_id, w, count(*) AS n FROM (
  SELECT resume_id, unnest(string_split(regexp_replace(trim(regexp_replace(lower(array_to_string(lines[2:], ' ')), '[^\\w\\s]', ' ', 'g')), '\\s+', ' ', 'g'), ' ')) AS w FROM fx_lines) WHERE w <> '' GROUP BY 1, 2) WHERE n > 4 GROUP BY 1) r USING (resume_id) LEFT JOIN ({c.PLAIN_WORDS}) q USING (resume_id)"""


def _features(v):
    return f.resume_features(v.lines, VERBS["strong"], VERBS["weak"])


@query("resume_features", "SELECT * FROM fx_features", "fx_features")
def resume_features(v):
    return _features(v)


#: Measures of a family that are no scores from 0 to 100.
_RAW = {"readability": ("chars_a_sentence",)}
for _family in f.PROFILES:
    _more = _RAW.get(_family, ())
    query(f"{_family}_scores", "SELECT resume_id, " + ", ".join([*(f"CAST({e} AS BIGINT) AS {k}" for k, e in c.COMPONENTS[_family].items()), *_more]) + " FROM fx_features", "fx_features")(lambda v, family=_family, more=_more: f.scores(_features(v), family, more))


def _tokens(v):
    return m.token_rows(v.resumes, "resume_id", "text")


def _keywords(v):
    return m.weighted_keywords(m.token_rows(v.jds, "jd_id", "jd_text"), "jd_id", STOP, 15)


def _pairs(v):
    return v.resumes.where("jd_id IS NOT NULL").select("resume_id", "jd_id")


def _matches(v):
    return m.matched_keywords(v.resumes.where("jd_id IS NOT NULL").select("resume_id", "jd_id", "text"), _keywords(v))


@query("jd_keywords", "SELECT jd_id, keyword, weight, rnk FROM fx_jd_keywords", "fx_jd_keywords")
def jd_keywords(v):
    return _keywords(v)


_MATCH = """SELECT p.resume_id, k.jd_id, k.keyword, k.weight, k.rnk, t.token IS NOT NULL AS matched FROM (SELECT resume_id, jd_id FROM fx_resumes WHERE jd_id IS NOT NULL) p
JOIN fx_jd_keywords k USING (jd_id) LEFT JOIN (SELECT DISTINCT resume_id, token FROM fx_tokens) t ON t.resume_id = p.resume_id AND t.token = k.keyword"""


@query("keyword_matches", _MATCH, "fx_tokens fx_jd_keywords")
def keyword_matches(v):
    return _matches(v)


_SCORES = f"""SELECT resume_id, jd_id, count(*) AS n_keywords, count_if(matched) AS n_matched, sum(weight)::BIGINT AS weight, sum(CASE WHEN matched THEN weight ELSE 0 END)::BIGINT AS matched_weight,
  coalesce(string_agg(CASE WHEN NOT matched THEN keyword END, ',' ORDER BY rnk), '') AS missing,
  CAST(floor(count_if(matched) * 100.0 / count(*) + 0.5) AS BIGINT) AS percent, CAST(floor(sum(CASE WHEN matched THEN weight ELSE 0 END) * 100.0 / sum(weight) + 0.5) AS BIGINT) AS weighted_percent FROM ({_MATCH}) GROUP BY 1, 2"""


def _scores(v):
    return m.match_scores(_matches(v))


@query("score_weighted_match", _SCORES, "fx_tokens fx_jd_keywords")
def score_weighted_match(v):
    return _scores(v)


@query("missing_keywords_ranked", f"""SELECT resume_id, keyword, CASE WHEN place <= 3 THEN 'high' WHEN place <= 7 THEN 'medium' ELSE 'low' END AS priority, place
FROM (SELECT *, row_number() OVER (PARTITION BY resume_id ORDER BY rnk) AS place FROM ({_MATCH}) WHERE NOT matched) WHERE place <= 10""", "fx_tokens fx_jd_keywords")
def missing_keywords_ranked(v):
    from ..operators.dashboards import top_k

    rows = _matches(v).where(~F.col("matched"))
    ranked = top_k(rows, "resume_id", [F.asc("rnk")], 10, "place")
    return ranked.select("resume_id", "keyword", F.when(F.col("place") <= 3, "high").when(F.col("place") <= 7, "medium").otherwise("low").alias("priority"), "place")


@query("live_composite", f"""
WITH s AS ({_SCORES}), c AS (
  SELECT f.resume_id, coalesce(CAST(floor(s.percent * 4 + 0.5) AS DOUBLE) / 10, 0) AS k, CAST({c.COMPONENTS["completeness"]["live"]} AS DOUBLE) AS comp, CAST({c.COMPONENTS["formatting"]["live"]} AS DOUBLE) AS fmt,
    CAST({c.COMPONENTS["verbs"]["live_percent"]} AS DOUBLE) AS percent_verbs, CAST({c.COMPONENTS["readability"]["live"]} AS DOUBLE) AS rdb FROM fx_features f LEFT JOIN s USING (resume_id)
), d AS (SELECT *, least(100, greatest(0, CAST({c.VERB_CURVE.format("percent_verbs")} AS DOUBLE))) AS verbs FROM c)
SELECT resume_id, CAST(k AS DECIMAL(10,1)) AS keyword_match, CAST(comp AS BIGINT) AS section_completeness, CAST(fmt AS BIGINT) AS formatting, CAST(verbs AS DECIMAL(10,2)) AS action_verbs, CAST(rdb AS BIGINT) AS readability,
  CAST(floor(k * 0.4 + comp * 0.2 + fmt * 0.2 + verbs * 0.1 + rdb * 0.1 + 0.5) AS BIGINT) AS total_score FROM d""", "fx_features fx_tokens fx_jd_keywords")
def live_composite(v):
    """The keyword component is 0 to 40 and is weighed by .4 once more, as the live profile does."""
    scores = _scores(v).select(F.col("resume_id").alias("__r"), (F.floor(F.col("percent") * 4 + 0.5).cast("double") / 10).alias("k"))
    rows = _features(v).join(scores, F.col("resume_id") == F.col("__r"), "left")
    out = f.composite(rows, F.col("k"))
    return out.select("resume_id", F.col("keyword_match").cast("decimal(10,1)").alias("keyword_match"), F.col("section_completeness").cast("long").alias("section_completeness"), F.col("formatting").cast("long").alias("formatting"), F.col("action_verbs").cast("decimal(10,2)").alias("action_verbs"), F.col("readability").cast("long").alias("readability"), "total_score")


_ROLES = "SELECT resume_id, role, ord, count(*) AS votes FROM fx_tokens JOIN fx_dict_roles ON token = term GROUP BY 1, 2, 3"


@query("resume_roles", f"""SELECT resume_id, coalesce(role, 'general') AS role, coalesce(votes, 0) AS votes FROM (SELECT DISTINCT resume_id FROM fx_tokens)
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY resume_id ORDER BY votes DESC, ord) AS rn FROM ({_ROLES})) WHERE rn = 1) USING (resume_id)""", "fx_tokens fx_dict_roles")
def resume_roles(v):
    rows = [(k, role, term) for k, (role, terms) in enumerate(ROLES.items(), 1) for term in terms]
    return m.vote(_tokens(v), "resume_id", v.spark.createDataFrame(rows, "ord int, role string, term string"), "general")


@query("keyword_synonyms", """SELECT DISTINCT jd_id, keyword, form FROM (SELECT jd_id, keyword, keyword AS form FROM fx_jd_keywords
UNION ALL SELECT k.jd_id, k.keyword, b.form FROM fx_jd_keywords k JOIN fx_dict_syn a ON a.form = k.keyword JOIN fx_dict_syn b ON a.grp = b.grp)""", "fx_jd_keywords fx_dict_syn")
def keyword_synonyms(v):
    rows = [(g, x) for g, forms in SYNONYMS.items() for x in forms]
    return m.with_synonyms(_keywords(v), v.spark.createDataFrame(rows, "grp string, form string"), "jd_id")


@query("similar_keywords", """
SELECT a.keyword AS "left", b.term AS "right", levenshtein(a.keyword, b.term) AS distance FROM (SELECT DISTINCT keyword FROM fx_jd_keywords) a, (SELECT DISTINCT token AS term FROM fx_tokens) b
WHERE abs(length(a.keyword) - length(b.term)) * 20 < 3 * greatest(length(a.keyword), length(b.term)) AND (greatest(length(a.keyword), length(b.term)) - levenshtein(a.keyword, b.term)) * 1.0 / greatest(length(a.keyword), length(b.term)) > 0.85""", "fx_jd_keywords fx_tokens")
def similar_keywords(v):
    """Every word of the résumés against the keywords."""
    return m.similar_terms(_keywords(v).select(F.col("keyword").alias("term")), _tokens(v).select(F.col("token").alias("term")))


@query("score_bands", """SELECT resume_id, total_score, CASE WHEN total_score >= 85 THEN 'excellent' WHEN total_score >= 75 THEN 'good' WHEN total_score >= 60 THEN 'average' ELSE 'poor' END AS band,
CASE WHEN total_score >= 85 THEN 'A' WHEN total_score >= 70 THEN 'B' WHEN total_score >= 50 THEN 'C' ELSE 'D' END AS tier FROM fx_score_now""", "fx_score_now")
def score_bands(v):
    from ..operators.dashboards import latest_per_key

    s = F.col("total_score")
    band = F.when(s >= 85, "excellent").when(s >= 75, "good").when(s >= 60, "average").otherwise("poor")
    tier = F.when(s >= 85, "A").when(s >= 70, "B").when(s >= 50, "C").otherwise("D")
    return latest_per_key(v.reports, "resume_id", "created_at", "report_id").select("resume_id", "total_score", band.alias("band"), tier.alias("tier"))
