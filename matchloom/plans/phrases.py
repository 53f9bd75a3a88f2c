"""Queries of keywords of several words."""

from __future__ import annotations

from ..operators import matching as m
from ..operators import phrase_match as p
from ..sources.fixtures import NEEDS, SQL, STOP, SYNONYMS
from ._register import query
from .profiles import _STEM
from .scores import _keywords

NEEDS["fx_jd_phrases"] = ["fx_jd_tokens", "fx_jd_keywords", "fx_dict_stop"]
SQL["fx_jd_phrases"] = """
SELECT jd_id, keyword FROM fx_jd_keywords UNION ALL
SELECT jd_id, keyword FROM (SELECT jd_id, size, keyword, row_number() OVER (PARTITION BY jd_id, size ORDER BY count(*) DESC, min(pos)) AS place FROM (
  SELECT jd_id, pos, 2 AS size, token || ' ' || lead(token) OVER w AS keyword, ok AND lead(ok) OVER w AS good FROM (SELECT *, length(token) > 2 AND token NOT IN (SELECT term FROM fx_dict_stop) AS ok FROM fx_jd_tokens) WINDOW w AS (PARTITION BY jd_id ORDER BY pos)
  UNION ALL
  SELECT jd_id, pos, 3, token || ' ' || lead(token) OVER w || ' ' || lead(token, 2) OVER w, ok AND lead(ok) OVER w AND lead(ok, 2) OVER w FROM (SELECT *, length(token) > 2 AND token NOT IN (SELECT term FROM fx_dict_stop) AS ok FROM fx_jd_tokens) WINDOW w AS (PARTITION BY jd_id ORDER BY pos)
) WHERE good GROUP BY jd_id, size, keyword) WHERE place <= 5"""


def _phrases(v):
    """A requirement's 15 words, and its 5 most frequent stretches of two and of three words."""
    tokens = m.token_rows(v.jds, "jd_id", "jd_text")
    return _keywords(v).select("jd_id", "keyword").unionByName(p.gram_keywords(tokens, "jd_id", STOP, 2, 5).select("jd_id", "keyword")).unionByName(p.gram_keywords(tokens, "jd_id", STOP, 3, 5).select("jd_id", "keyword"))


def _synonyms(v):
    return v.spark.createDataFrame([(g, x) for g, forms in SYNONYMS.items() for x in forms], "grp string, form string")


_NORM = r"trim(regexp_replace(regexp_replace(lower(text), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_LIKE = "(greatest(length({0}), length({1})) - levenshtein({0}, {1})) * 1.0 / greatest(length({0}), length({1})) > 0.85 AND abs(length({0}) - length({1})) * 20 < 3 * greatest(length({0}), length({1}))"


@query("phrase_matches", f"""
WITH own AS (SELECT resume_id, r.jd_id, {_NORM} AS norm, keyword FROM fx_resumes r JOIN fx_jd_phrases k ON k.jd_id = r.jd_id),
forms AS (SELECT DISTINCT a.form AS keyword, b.form FROM fx_dict_syn a JOIN fx_dict_syn b ON a.grp = b.grp AND a.form <> b.form),
syn AS (SELECT resume_id, o.keyword, min(form) AS form FROM own o JOIN forms f ON f.keyword = o.keyword WHERE contains(norm, form) GROUP BY ALL),
stepped AS (SELECT o.resume_id, o.jd_id, o.keyword, contains(norm, o.keyword) AS exact, form FROM own o LEFT JOIN syn s ON s.resume_id = o.resume_id AND s.keyword = o.keyword),
asked AS (SELECT DISTINCT unnest(string_split(keyword, ' ') || [keyword]) AS term FROM fx_jd_phrases),
vocabulary AS (SELECT DISTINCT token FROM fx_tokens),
near AS (SELECT term, token FROM asked JOIN vocabulary ON {_LIKE.format("term", "token")}),
finds AS (SELECT resume_id, term, min_by(token, pos) AS token FROM (SELECT x.resume_id, n.term, x.token, x.pos FROM fx_tokens x JOIN near n ON n.token = x.token) GROUP BY ALL),
words AS (SELECT s.resume_id, s.keyword, count(f.term) = count(*) AS found FROM (SELECT resume_id, keyword, unnest(list_distinct(string_split(keyword, ' '))) AS word FROM stepped WHERE NOT exact AND form IS NULL AND contains(keyword, ' ')) s LEFT JOIN finds f ON f.resume_id = s.resume_id AND f.term = s.word GROUP BY ALL)
SELECT s.resume_id, s.jd_id, s.keyword, CASE WHEN exact THEN 'exact' WHEN form IS NOT NULL THEN 'synonym' WHEN found THEN 'word_match' WHEN token IS NOT NULL THEN 'fuzzy' ELSE 'none' END AS method,
  CASE WHEN exact THEN s.keyword WHEN form IS NOT NULL THEN form WHEN found THEN s.keyword ELSE token END AS found_as
FROM stepped s LEFT JOIN words w ON w.resume_id = s.resume_id AND w.keyword = s.keyword LEFT JOIN finds f ON f.resume_id = s.resume_id AND f.term = s.keyword""", "fx_resumes fx_tokens fx_jd_phrases fx_dict_syn")
def phrase_matches(v):
    return p.phrase_matches(v.resumes.select("resume_id", "jd_id", "text"), _phrases(v), _synonyms(v))


_ALL = "len(list_filter(words, lambda w: NOT {0})) = 0"
_GROUPED = "keyword IN (SELECT form FROM fx_dict_syn)"
_FORM = "EXISTS (SELECT 1 FROM fx_dict_syn a JOIN fx_dict_syn b ON a.grp = b.grp WHERE a.form = keyword AND contains(norm, b.form))"
_HERE, _INSIDE = "contains(norm, keyword)", _ALL.format("contains(norm, w)")


@query("phrase_ladders", f"""SELECT resume_id, jd_id, keyword,
CASE WHEN {_HERE} THEN 'substring' WHEN {_ALL.format(f"list_contains(stems, {_STEM.format('w')})")} THEN 'stems' ELSE 'none' END AS substring_stems,
CASE WHEN {_HERE} THEN 'substring' WHEN {_INSIDE} THEN 'tokens' WHEN list_contains(stems, {_STEM.format('words[-1]')}) THEN 'stem' ELSE 'none' END AS substring_tokens_stem,
CASE WHEN {_HERE} THEN 'substring' WHEN {_FORM} THEN 'synonym' WHEN {_INSIDE} AND len(words) > 1 THEN 'tokens' ELSE 'none' END AS substring_synonym_tokens,
CASE WHEN {_HERE} THEN 'substring' WHEN {_FORM} THEN 'synonym' ELSE 'none' END AS synonym_both_ways,
CASE WHEN {_FORM} THEN 'synonym' WHEN NOT {_GROUPED} AND contains(' ' || norm || ' ', ' ' || keyword || ' ') THEN 'word' ELSE 'none' END AS synonym_or_word
FROM (SELECT r.*, keyword, string_split(keyword, ' ') AS words FROM (SELECT *, list_transform(list_distinct(string_split(norm, ' ')), lambda w: {_STEM.format('w')}) AS stems FROM (SELECT resume_id, jd_id, {_NORM} AS norm FROM fx_resumes)) r JOIN fx_jd_phrases k ON k.jd_id = r.jd_id)""", "fx_resumes fx_jd_phrases fx_dict_syn")
def phrase_ladders(v):
    return p.stem_phrase_matches(v.resumes.select("resume_id", "jd_id", "text"), _phrases(v), SYNONYMS)
