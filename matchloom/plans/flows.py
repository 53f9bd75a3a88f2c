"""Queries of flows: apply and score again, generic scores, display lists, text builders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import features as f, flows as x, matching as m, suggestions as s
from ..sources.fixtures import ROLES, VERBS
from ._register import query
from .profiles import _COMPONENTS, _VIEWS, _components
from .scores import _MATCH, _keywords, _matches, _norm, _pairs, _tokens
from .suggestions import _SUGGESTED, _suggested

_SV = "fx_tokens fx_jd_keywords fx_bullets fx_lines fx_features fx_resumes"


@query("built_texts", f"SELECT resume_id, length(x) AS n, md5(x) AS digest FROM (SELECT resume_id, {_norm('title || CASE WHEN trim(y) <> chr(32) THEN chr(32) || trim(y) ELSE chr(32) END')} AS x FROM (SELECT resume_id, title, array_to_string(lines[2:], ' ') || ' ' || coalesce(lines[1], '') AS y FROM fx_lines JOIN (SELECT resume_id, title FROM fx_resumes) USING (resume_id)))", "fx_lines fx_resumes")
def built_texts(v):
    rows = v.lines.join(v.resumes.select(F.col("resume_id").alias("__r"), "title"), F.col("resume_id") == F.col("__r"))
    text = x.built_text([F.col("title"), F.array_join(F.slice("lines", 2, 2**31 - 2), " "), F.coalesce(F.try_element_at("lines", F.lit(1)), F.lit(""))], t.strip_markup)
    return rows.select("resume_id", F.length(text).alias("n"), F.md5(text.cast("binary")).alias("digest"))


_APPLIED = f"""SELECT resume_id, sum(CASE WHEN regexp_matches(new, '^(Led|Built|Drove|Made|Ran) ') THEN 1 ELSE 0 END)::BIGINT AS new_first, sum(CASE WHEN regexp_matches(text, '^(Led|Built|Drove|Made|Ran) ') THEN 1 ELSE 0 END)::BIGINT AS old_first,
sum(length(new))::BIGINT AS new_len, sum(length(text))::BIGINT AS old_len FROM (SELECT b.resume_id, b.text, coalesce(s.improved_text, b.text) AS new FROM fx_bullets b LEFT JOIN ({_SUGGESTED}) s ON s.resume_id = b.resume_id AND s.pos = b.pos AND s.current_text = b.text) GROUP BY 1"""


@query("applied_and_scored", f"SELECT resume_id, old_first AS old_strong_first, old_len AS old_sum_len, new_first AS new_strong_first, new_len AS new_sum_len, new_first - old_first AS delta_strong_first, new_len - old_len AS delta_sum_len FROM ({_APPLIED})", _SV)
def applied_and_scored(v):
    """Suggestions applied, features made again, and the difference."""
    summary = v.lines.select("resume_id", F.coalesce(F.try_element_at("lines", F.lit(1)), F.lit("")).alias("summary")).where(F.col("resume_id").isNotNull())
    new = s.applied(v.bullets.select("resume_id", "pos", "text"), _suggested(v))
    score = lambda lines: f.resume_features(lines, ["led", "built", "drove", "made", "ran"], VERBS["weak"]).select("resume_id", "strong_first", "sum_len", "nb")
    after = x.lines_of(new, summary).join(v.lines.select("resume_id", *f.SECTIONS), "resume_id")
    out = x.score_difference(score(v.lines).where("nb > 0"), score(after), ["strong_first", "sum_len"])
    return out.select("resume_id", "old_strong_first", "old_sum_len", "new_strong_first", "new_sum_len", "delta_strong_first", "delta_sum_len")


@query("suggestions_unapplied", f"SELECT resume_id, type, rank FROM ({_SUGGESTED}) WHERE lower(trim(regexp_replace(current_text, '\\s+', ' ', 'g'))) NOT IN (SELECT lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) FROM fx_bullets WHERE bullet_index = 0)", _SV)
def suggestions_unapplied(v):
    """The history is the first bullet of each job, which counts as applied."""
    return x.unapplied(_suggested(v), v.bullets.where("bullet_index = 0").select("text")).select("resume_id", "type", "rank")


@query("skills_or_sentences", r"SELECT resume_id, count_if(ok) AS skills, count_if(NOT ok) AS sentences FROM (SELECT resume_id, len(string_split_regex(trim(text), '\s+')) <= 4 AND length(text) <= 40 AND NOT regexp_matches(text, '[.!?]$') AS ok FROM fx_bullets) GROUP BY resume_id", "fx_bullets")
def skills_or_sentences(v):
    rows = v.bullets.withColumn("ok", x.is_skill(F.col("text")))
    return rows.groupBy("resume_id").agg(F.count_if("ok").alias("skills"), F.count_if(~F.col("ok")).alias("sentences"))


def _missing(v):
    return _matches(v).where("NOT matched").select("resume_id", "keyword", "weight", "rnk")


@query("missing_by_domain", f"""SELECT resume_id, keyword, points, place FROM (SELECT *, row_number() OVER (PARTITION BY resume_id ORDER BY points DESC, rnk) AS place FROM (SELECT *, CASE WHEN keyword IN ('ther', 'rest', 'than') THEN 20 ELSE 0 END + length(keyword) + CASE WHEN regexp_matches(keyword, 'tion|ing') THEN 10 ELSE 0 END - (rnk - 1) AS points FROM ({_MATCH}) WHERE NOT matched)) WHERE place <= 5""", "fx_tokens fx_jd_keywords fx_resumes")
def missing_by_domain(v):
    rows = x.domain_priority(_missing(v), ["ther", "rest", "than"], "tion|ing")
    return rows.where("place <= 5").select("resume_id", "keyword", "points", "place")


@query("missing_display", f"""SELECT resume_id, keyword, bucket, place FROM (SELECT *, row_number() OVER (PARTITION BY resume_id, bucket ORDER BY rnk) AS place FROM (SELECT *, CASE WHEN weight >= 2 THEN 'high' ELSE 'medium' END AS bucket FROM ({_MATCH}) WHERE NOT matched)) WHERE place <= CASE bucket WHEN 'high' THEN 8 ELSE 7 END""", "fx_tokens fx_jd_keywords fx_resumes")
def missing_display(v):
    return x.two_buckets(_missing(v), F.col("weight") >= 2, 8, 7).select("resume_id", "keyword", "bucket", "place")


_VOTED = "SELECT resume_id, role FROM (SELECT resume_id, role, row_number() OVER (PARTITION BY resume_id ORDER BY count(*) DESC, ord) AS n FROM fx_tokens JOIN fx_dict_roles ON token = term GROUP BY resume_id, role, ord) WHERE n = 1"


@query("generic_scores", f"""SELECT resume_id, role, percent, CASE WHEN percent >= 100 THEN 'top' WHEN percent >= 50 THEN 'average' ELSE 'low' END AS label FROM (
SELECT w.resume_id, w.role, CAST(floor(count(t.token) * 100.0 / count(*) + 0.5) AS BIGINT) AS percent FROM (SELECT v.resume_id, v.role, d.term FROM ({_VOTED}) v JOIN fx_dict_roles d USING (role)) w
LEFT JOIN (SELECT DISTINCT resume_id, token FROM fx_tokens) t ON t.resume_id = w.resume_id AND t.token = w.term GROUP BY 1, 2)""", "fx_tokens fx_dict_roles")
def generic_scores(v):
    roles = v.spark.createDataFrame([(k, role, term) for k, (role, terms) in enumerate(ROLES.items(), 1) for term in terms], "ord int, role string, term string")
    tokens = _tokens(v)
    voted = m.vote(tokens, "resume_id", roles, "general").where("votes > 0")
    return x.generic_score(tokens, roles, voted)


RULES = [("k < 70", "add keywords", 1), ("a < 70", "use stronger verbs", 2), ("c < 80", "complete the sections", 2), ("f < 80", "clean the format", 3)]


@query("recommendations", "SELECT resume_id, row_number() OVER (PARTITION BY resume_id ORDER BY priority, ord) AS place, advice FROM (" + " UNION ALL ".join(f"SELECT resume_id, {p} AS priority, {n} AS ord, '{advice}' AS advice FROM ({_COMPONENTS}) WHERE {test}" for n, (test, advice, p) in enumerate(RULES)) + ")", _VIEWS)
def recommendations(v):
    return x.recommendations(_components(v), RULES)


@query("flat_and_nested", "SELECT resume_id, CASE WHEN len(lines) > 0 THEN 1 ELSE 0 END AS n_jobs, CASE WHEN len(lines) > 0 THEN title END AS company, 2 AS n_items FROM fx_lines JOIN (SELECT resume_id, title FROM fx_resumes) USING (resume_id)", "fx_lines fx_resumes")
def flat_and_nested(v):
    """Nested documents to the flat form and back."""
    rows = v.lines.join(v.resumes.select(F.col("resume_id").alias("__r"), "title"), F.col("resume_id") == F.col("__r"))
    job = F.struct(F.lit("Dev").alias("role"), F.col("title").alias("company"))
    nested = rows.select("resume_id", F.when(F.size("lines") > 0, F.array(job)).otherwise(F.array().cast("array<struct<role:string,company:string>>")).alias("experience"), F.array(F.struct(F.lit("A").alias("category"), F.array(F.lit("Go"), F.lit("SQL")).alias("items"))).alias("skills"))
    back = x.nested_form(x.flat_form(nested))
    return back.select("resume_id", F.size("experience").alias("n_jobs"), F.get("experience", F.lit(0))["company"].alias("company"), F.size(F.get("skills", F.lit(0))["items"]).alias("n_items"))


@query("keyword_sections", """SELECT p.resume_id, k.keyword, CASE WHEN x.at_pos <= 10 THEN 'summary' WHEN x.at_pos <= 50 THEN 'opening' WHEN x.at_pos IS NOT NULL THEN 'body' ELSE 'none' END AS section FROM (SELECT resume_id, jd_id FROM fx_resumes WHERE jd_id IS NOT NULL) p
JOIN (SELECT * FROM fx_jd_keywords WHERE rnk <= 5) k USING (jd_id) LEFT JOIN (SELECT resume_id, token, min(pos) AS at_pos FROM fx_tokens GROUP BY 1, 2) x ON x.resume_id = p.resume_id AND x.token = k.keyword""", "fx_resumes fx_jd_keywords fx_tokens")
def keyword_sections(v):
    finds = _tokens(v).groupBy(F.col("resume_id").alias("__r"), F.col("token").alias("__t")).agg(F.min("pos").alias("at"))
    rows = _pairs(v).join(_keywords(v).where("rnk <= 5"), "jd_id").join(finds, (F.col("resume_id") == F.col("__r")) & (F.col("keyword") == F.col("__t")), "left")
    return rows.select("resume_id", "keyword", F.when(F.col("at") <= 10, "summary").when(F.col("at") <= 50, "opening").when(F.col("at").isNotNull(), "body").otherwise("none").alias("section"))


@query("suggestion_validation", f"""SELECT resume_id, rank, concat_ws(',', CASE WHEN type NOT IN ('keyword', 'action_verb', 'experience', 'summary') THEN 'type' END, CASE WHEN coalesce(trim(improved_text) = '', true) THEN 'text' END, CASE WHEN improved_text = current_text THEN 'unchanged' END, CASE WHEN section = 'experience' AND pos IS NULL THEN 'index' END) AS violations FROM ({_SUGGESTED})""", _SV)
def suggestion_validation(v):
    from ..operators import validation as q

    rules = {"type": q.not_in("type", ["keyword", "action_verb", "experience", "summary"]), "text": q.required("improved_text"), "unchanged": F.col("improved_text") == F.col("current_text"), "index": (F.col("section") == "experience") & F.col("pos").isNull()}
    return q.with_violations(_suggested(v), rules).select("resume_id", "rank", "violations")
