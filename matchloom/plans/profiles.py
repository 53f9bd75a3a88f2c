"""Queries of composite profiles, feedback, match methods, verbs, votes and de-duplication variants."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import composites as c, features as f, matching as m
from ..operators.dashboards import first_of, one_decimal
from ..sources.fixtures import ROLES, SYNONYMS, VERBS
from . import component_sql as sql
from ._register import query
from .scores import _MATCH, _SCORES, _keywords, _matches, _pairs, _scores, _tokens
from .suggestions import _SUGGESTED, _suggested

_COMPONENTS = f"""SELECT ff.resume_id, coalesce(s.percent, 0) AS k, CAST({sql.COMPONENTS["formatting"]["live"]} AS BIGINT) AS f, CAST({sql.COMPONENTS["completeness"]["live"]} AS BIGINT) AS c,
CAST({sql.COMPONENTS["verbs"]["first_word"]} AS BIGINT) AS a, CAST({sql.COMPONENTS["readability"]["deductions"]} AS BIGINT) AS r, s.percent IS NOT NULL AS has_jd FROM fx_features ff LEFT JOIN ({_SCORES}) s USING (resume_id)"""
_VIEWS = "fx_features fx_tokens fx_jd_keywords fx_resumes"


#: Components that totals and lists are made of, by the names of their columns.
PARTS = {"f": ("formatting", "live"), "c": ("completeness", "live"), "a": ("verbs", "first_word"), "r": ("readability", "deductions")}


def _components(v):
    rows = f.resume_features(v.lines, VERBS["strong"], VERBS["weak"])
    rows = rows.select("resume_id", *[F.expr(f.PROFILES[family][profile]).cast("long").alias(k) for k, (family, profile) in PARTS.items()])
    scores = _scores(v).select(F.col("resume_id").alias("__r"), "percent")
    return rows.join(scores, F.col("resume_id") == F.col("__r"), "left").select("resume_id", F.coalesce("percent", F.lit(0)).alias("k"), "f", "c", "a", "r", F.col("percent").isNotNull().alias("has_jd"))


@query("composite_profiles", "SELECT resume_id, k, f, c, a, r, has_jd, " + ", ".join(f"CAST({e} AS BIGINT) AS {n}" for n, e in sql.TOTALS.items()) + f", {sql.TIER} AS tier FROM ({_COMPONENTS})", _VIEWS)
def composite_profiles(v):
    return c.totals(_components(v))


_STRENGTHS = """coalesce(nullif(concat_ws(';', CASE WHEN k >= 75 THEN 'keywords fit' END, CASE WHEN f >= 85 THEN 'clean format' END, CASE WHEN c >= 80 THEN 'complete' END, CASE WHEN a >= 75 THEN 'strong verbs' END, CASE WHEN r >= 75 THEN 'clear bullets' END), ''), 'good fundamentals')"""
_WEAKNESSES = """coalesce(nullif(concat_ws(';', CASE WHEN k < 70 THEN 'keywords missing' END, CASE WHEN c < 70 THEN 'sections missing' END, CASE WHEN a < 70 THEN 'weak verbs' END, CASE WHEN r < 70 THEN 'unclear bullets' END), ''), 'minor points')"""


@query("score_feedback", f"SELECT resume_id, {_STRENGTHS} AS strengths, {_WEAKNESSES} AS weaknesses FROM ({_COMPONENTS})", _VIEWS)
def score_feedback(v):
    return c.feedback(_components(v)).select("resume_id", "strengths", "weaknesses")


@query("resume_completeness", """SELECT resume_id, least(100, 10 * has_email::INT + 15 * (summary_len > 50)::INT + 20 * has_skills::INT + 25 * (nb > 0)::INT + 15 * has_projects::INT + 10 * has_education::INT + 5 * has_certifications::INT) AS completeness FROM fx_features""", "fx_features")
def resume_completeness(v):
    rows = f.resume_features(v.lines, VERBS["strong"], VERBS["weak"])
    parts = (("has_email", 10), ("summary_len > 50", 15), ("has_skills", 20), ("nb > 0", 25), ("has_projects", 15), ("has_education", 10), ("has_certifications", 5))
    return rows.select("resume_id", F.least(F.lit(100), sum((F.when(F.expr(test), n).otherwise(0) for test, n in parts), F.lit(0))).alias("completeness"))


@query("breakdown_weighted", f"SELECT resume_id, 'keywords' AS component, k AS score, 40 AS weight, CAST(k * 0.4 AS DECIMAL(10,1)) AS points FROM ({_COMPONENTS}) UNION ALL SELECT resume_id, 'formatting', f, 20, CAST(f * 0.2 AS DECIMAL(10,1)) FROM ({_COMPONENTS}) UNION ALL SELECT resume_id, 'completeness', c, 20, CAST(c * 0.2 AS DECIMAL(10,1)) FROM ({_COMPONENTS})", _VIEWS)
def breakdown_weighted(v):
    """The flat breakdown as rows with weights; ``stack`` keeps it one pass."""
    rows = _components(v).select("resume_id", F.expr("stack(3, 'keywords', k, 40, 'formatting', f, 20, 'completeness', c, 20) AS (component, score, weight)"))
    return rows.withColumn("points", (F.col("score") * F.col("weight") / 100).cast("decimal(10,1)"))


def _synonym_sql(text: str, keyword: str) -> str:
    return " OR ".join("(" + f"{keyword} IN (" + ", ".join(f"'{x}'" for x in forms) + ") AND (" + " OR ".join(f"contains({text}, '{x}')" for x in forms) + "))" for forms in SYNONYMS.values())


_STEM = "regexp_replace(regexp_replace({0}, '(s|es|ed|ing|tion|ation)$', ''), 'y$', 'i')"
_SQUASH = r"regexp_replace(lower({0}), '[.\-_/\\]', '', 'g')"


@query("match_methods", f"""SELECT r.resume_id, r.jd_id, k.keyword, CASE WHEN contains(norm, keyword) THEN 'exact' WHEN {_synonym_sql('norm', 'keyword')} THEN 'synonym'
WHEN len(list_filter(string_split(keyword, ' '), lambda w: NOT list_contains(toks, w))) = 0 THEN 'words' WHEN length(keyword) >= 4 AND list_contains(stems, {_STEM.format('keyword')}) THEN 'stem'
WHEN contains({_SQUASH.format('norm')}, {_SQUASH.format('keyword')}) THEN 'squashed' WHEN length(keyword) >= 4 AND len(list_filter(toks, lambda w: starts_with(w, left(keyword, 4)))) > 0 THEN 'prefix' ELSE 'none' END AS method
FROM (SELECT *, list_transform(toks, lambda w: {_STEM.format('w')}) AS stems FROM (SELECT *, list_distinct(string_split(norm, ' ')) AS toks FROM (SELECT resume_id, jd_id, trim(regexp_replace(regexp_replace(lower(text), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS norm FROM fx_resumes WHERE jd_id IS NOT NULL))) r JOIN fx_jd_keywords k USING (jd_id)""", "fx_resumes fx_jd_keywords")
def match_methods(v):
    words = _keywords(v).groupBy("jd_id").agg(F.collect_list("keyword").alias("keywords"))
    pairs = v.resumes.where("jd_id IS NOT NULL").select("resume_id", "jd_id", "text").join(words, "jd_id")
    return c.match_methods(pairs, SYNONYMS)


@query("sectioned_scores", f"""SELECT resume_id, jd_id, CAST(floor(least(100, pow(greatest(0, e / w * 100 - p) / 100, 0.9) * 100) + 0.5) AS BIGINT) AS score FROM (
SELECT resume_id, jd_id, sum(weight) AS w, sum(CASE WHEN n_finds > 0 THEN weight * CASE section WHEN 'summary' THEN 1.2 WHEN 'opening' THEN 1.0 WHEN 'body' THEN 0.9 ELSE 0.7 END * CASE n_finds WHEN 1 THEN 0.6 WHEN 2 THEN 0.85 ELSE 1.0 END ELSE 0 END)::DOUBLE AS e,
  sum(CASE WHEN n_finds * 1.0 / greatest(1, n_tokens) > 0.05 THEN 5 ELSE 0 END) AS p FROM (
SELECT p.resume_id, p.jd_id, k.weight, coalesce(x.n_finds, 0) AS n_finds, CASE WHEN x.at <= 10 THEN 'summary' WHEN x.at <= 50 THEN 'opening' WHEN x.at <= 200 THEN 'body' ELSE 'other' END AS section, n.n_tokens
FROM (SELECT resume_id, jd_id FROM fx_resumes WHERE jd_id IS NOT NULL) p JOIN fx_jd_keywords k USING (jd_id) JOIN (SELECT resume_id, count(*) AS n_tokens FROM fx_tokens GROUP BY 1) n USING (resume_id)
LEFT JOIN (SELECT resume_id, token, count(*) AS n_finds, min(pos) AS at FROM fx_tokens GROUP BY 1, 2) x ON x.resume_id = p.resume_id AND x.token = k.keyword) GROUP BY 1, 2)""", "fx_resumes fx_tokens fx_jd_keywords")
def sectioned_scores(v):
    tokens = _tokens(v)
    finds = tokens.groupBy(F.col("resume_id").alias("__r"), F.col("token").alias("__t")).agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("at"))
    sizes = tokens.groupBy("resume_id").agg(F.count(F.lit(1)).alias("n_tokens"))
    rows = _pairs(v).join(_keywords(v), "jd_id").join(sizes, "resume_id").join(finds, (F.col("resume_id") == F.col("__r")) & (F.col("keyword") == F.col("__t")), "left")
    at = F.col("at")
    section = F.when(at <= 10, "summary").when(at <= 50, "opening").when(at <= 200, "body").otherwise("other")
    return c.sectioned_score(rows.select("resume_id", "jd_id", "weight", F.coalesce("n", F.lit(0)).alias("n_finds"), section.alias("section"), "n_tokens"))


@query("verb_strength", """SELECT resume_id, count(*) AS total, count(DISTINCT token) AS distinct_verbs, count_if(token IN ('that', 'this')) AS strong, count_if(token IN ('from', 'les')) AS medium, count_if(token IN ('with', 'than', 'then')) AS weak,
least(10, CAST(floor((3 * count_if(token IN ('that', 'this')) + 2 * count_if(token IN ('from', 'les')) + count_if(token IN ('with', 'than', 'then'))) * 1.0 / count(*) + 0.5) AS BIGINT)) AS strength, CAST(floor(count(DISTINCT token) * 100.0 / count(*) + 0.5) AS BIGINT) AS diversity
FROM fx_tokens WHERE token IN ('that', 'this', 'from', 'les', 'with', 'than', 'then') GROUP BY resume_id""", "fx_tokens")
def verb_strength(v):
    strong, medium, weak = ["that", "this"], ["from", "les"], ["with", "than", "then"]
    verbs = _tokens(v).where(F.col("token").isin(strong + medium + weak)).select("resume_id", F.col("token").alias("verb"))
    return c.verb_strength(verbs, "resume_id", strong, medium, weak)


def _votes_sql() -> tuple[str, str]:
    votes = {name: " + ".join(f"contains(lower(text), '{x}')::INT" for x in terms) for name, terms in ROLES.items()}
    most = "greatest(" + ", ".join(votes.values()) + ")"
    return "CASE " + " ".join(f"WHEN {n} = {most} AND {most} > 0 THEN '{k}'" for k, n in votes.items()) + " ELSE 'general' END", most


@query("resume_domains", f"SELECT resume_id, {_votes_sql()[0]} AS domain, {_votes_sql()[1]} AS votes FROM fx_resumes", "fx_resumes")
def resume_domains(v):
    label, votes = c.contained_votes(F.col("text"), list(ROLES.items()), "general")
    return v.resumes.select("resume_id", label.alias("domain"), votes.alias("votes"))


@query("suggestions_distinct", f"SELECT resume_id, type, section, rank FROM (SELECT *, row_number() OVER (PARTITION BY resume_id, type ORDER BY rank) AS n FROM ({_SUGGESTED})) WHERE n = 1", "fx_tokens fx_jd_keywords fx_bullets fx_lines fx_features fx_resumes")
def suggestions_distinct(v):
    return first_of(_suggested(v), [F.col("resume_id"), F.col("type")], [F.asc("rank")]).select("resume_id", "type", "section", "rank")


@query("suggestions_by_impact", f"""SELECT resume_id, place, type, impact FROM (SELECT *, row_number() OVER (PARTITION BY resume_id ORDER BY CASE impact WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, rank) AS place FROM ({_SUGGESTED})) WHERE place <= 4""", "fx_tokens fx_jd_keywords fx_bullets fx_lines fx_features fx_resumes")
def suggestions_by_impact(v):
    order = Window.partitionBy("resume_id").orderBy(F.when(F.col("impact") == "high", 0).when(F.col("impact") == "medium", 1).otherwise(2), "rank")
    return _suggested(v).withColumn("place", F.row_number().over(order)).where("place <= 4").select("resume_id", "place", "type", "impact")


@query("impact_shares", f"SELECT impact, count(*) AS n, CAST(floor(count(*) * 1000.0 / sum(count(*)) OVER () + 0.5) / 10 AS DECIMAL(18,1)) AS share FROM ({_SUGGESTED}) GROUP BY impact", "fx_tokens fx_jd_keywords fx_bullets fx_lines fx_features fx_resumes")
def impact_shares(v):
    counts = _suggested(v).groupBy("impact").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", one_decimal(F.col("n") * 100 / F.sum("n").over(Window.partitionBy())))


@query("adaptive_top_keywords", """SELECT jd_id, keyword, place FROM (SELECT *, row_number() OVER (PARTITION BY jd_id ORDER BY n DESC, first_at) AS place, greatest(15, least(20, ceil(0.35 * count(*) OVER (PARTITION BY jd_id)))) AS k FROM (
SELECT jd_id, token AS keyword, count(*) AS n, min(pos) AS first_at FROM fx_jd_tokens WHERE length(token) > 3 GROUP BY 1, 2)) WHERE place <= k""", "fx_jd_tokens")
def adaptive_top_keywords(v):
    counts = m.token_rows(v.jds, "jd_id", "jd_text").where(F.length("token") > 3).groupBy("jd_id", F.col("token").alias("keyword")).agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("at"))
    k = F.greatest(F.lit(15), F.least(F.lit(20), F.ceil(F.count(F.lit(1)).over(Window.partitionBy("jd_id")) * 0.35)))
    return counts.withColumns({"k": k, "place": F.row_number().over(Window.partitionBy("jd_id").orderBy(F.desc("n"), "at"))}).where("place <= k").select("jd_id", "keyword", "place")


@query("missing_by_severity", f"""SELECT resume_id, severity, count(*) AS n, string_agg(keyword, ',' ORDER BY rnk) AS keywords FROM (SELECT *, CASE WHEN weight >= 4 THEN 'critical' WHEN weight >= 2 THEN 'important' ELSE 'optional' END AS severity FROM ({_MATCH}) WHERE NOT matched) GROUP BY 1, 2""", "fx_tokens fx_jd_keywords")
def missing_by_severity(v):
    rows = _matches(v).where("NOT matched")
    severity = F.when(F.col("weight") >= 4, "critical").when(F.col("weight") >= 2, "important").otherwise("optional")
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rnk", "keyword"))), lambda x: x["keyword"]), ",")
    return rows.withColumn("severity", severity).groupBy("resume_id", "severity").agg(F.count(F.lit(1)).alias("n"), names.alias("keywords"))


@query("all_pair_candidates", """SELECT a.resume_id, k.jd_id, count(*) AS n_matched, CAST(floor(count(*) * 100.0 / any_value(n.n) + 0.5) AS BIGINT) AS percent FROM (SELECT DISTINCT resume_id, token FROM fx_tokens) a JOIN fx_jd_keywords k ON a.token = k.keyword JOIN (SELECT jd_id, count(*) AS n FROM fx_jd_keywords GROUP BY 1) n ON n.jd_id = k.jd_id GROUP BY 1, 2""", "fx_tokens fx_jd_keywords")
def all_pair_candidates(v):
    """Scores of every résumé against every requirement through shared tokens alone: no cross join; a pair that is absent has 0.

    Words are distinct in a résumé's row, so pairs are counted where it is read and a task's counts are those of its split.
    """
    words = m.counted_broadcast(_keywords(v).select("keyword").distinct())
    tokens = v.resumes.select("resume_id", F.array_distinct(t.tokens(t.words_only(F.col("text")))).alias("tokens"))
    once, shared = m.by_repeated_key(tokens, v.resumes.select("resume_id"), "resume_id")
    of = lambda rows: rows.select("resume_id", F.explode("tokens").alias("token")).join(words, F.col("token") == F.col("keyword"), "left_semi").select("resume_id", "token")
    own = of(once) if shared is None else of(once).unionByName(of(shared).distinct())
    keywords = _keywords(v).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("jd_id")))
    hits = own.join(m.counted_broadcast(keywords.select("jd_id", "keyword", "n")), F.col("token") == F.col("keyword"))
    return hits.groupBy("resume_id", "jd_id").agg(F.count(F.lit(1)).alias("n_matched"), t.rounded(F.count(F.lit(1)) * 100 / F.first("n")).cast("long").alias("percent"))


@query("capitalised_titles", "SELECT resume_id, upper(substr(title, 1, 1)) || substr(title, 2) AS title FROM fx_resumes", "fx_resumes")
def capitalised_titles(v):
    return v.resumes.select("resume_id", t.capitalised(F.col("title")).alias("title"))
