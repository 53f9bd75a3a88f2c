"""Queries of ingest, sinks, dictionary matching and further profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import dictionary_match as x, matching as m
from ..operators.dashboards import first_of, top_k
from ..sources import store
from ..sources.fixtures import STOP
from ._register import query
from .scores import _keywords, _matches, _pairs, _tokens

TERMS = [("rest", 10), ("than", 5), ("elle", 8), ("keit", 8), ("of the", 6), ("des", 1)]
BUCKETS = [("verbs", ["ing", "ed"]), ("nouns", ["tion", "keit", "ment"]), ("articles", ["the", "les", "der"])]


@query("json_ingest", """SELECT resume_id, title AS resume_title, CASE WHEN resume_id % 5 = 0 THEN 0 ELSE 2 END AS n_skills, CASE WHEN resume_id % 3 = 0 THEN 1 ELSE 0 END AS n_jobs,
len(lines) AS n_achievements, CASE WHEN resume_id % 3 = 0 THEN len(lines) ELSE 0 END AS n_bullets FROM fx_lines JOIN (SELECT resume_id, title FROM fx_resumes) USING (resume_id)""", "fx_lines fx_resumes")
def json_ingest(v):
    """Nested documents as JSON texts, parsed with defaults, cleaned, and counted."""
    key = F.col("resume_id")
    rows = v.lines.join(v.resumes.select(F.col("resume_id").alias("__r"), "title"), F.col("resume_id") == F.col("__r"))
    job = F.struct(F.lit("C").alias("company"), F.lit("R").alias("role"), F.when(key % 3 == 0, "2020").alias("startDate"), F.col("lines").alias("bullets"))
    doc = F.to_json(F.struct(key.alias("resumeId"), F.col("title").alias("resumeTitle"), F.when(key % 5 != 0, "Go, SQL,").alias("skills"), F.array(job).alias("experience"), F.array_join(F.transform("lines", lambda x, i: F.concat(F.lit("- "), i, F.lit(" "), x)), "\n").alias("achievements")))
    parsed = store.parsed_resumes(rows.select(doc.alias("value")))
    count = lambda c: F.coalesce(F.aggregate(c, F.lit(0), lambda s, g: s + F.size(g)), F.lit(0))
    return parsed.select(F.col("resumeId").alias("resume_id"), F.col("resumeTitle").alias("resume_title"), count(F.transform("skills", lambda g: g["items"])).alias("n_skills"), F.size("experience").alias("n_jobs"), F.size("achievements").alias("n_achievements"), count(F.transform("experience", lambda e: e["bullets"])).alias("n_bullets"))


@query("reports_by_day", "SELECT CAST(created_at AS DATE) AS created_date, count(*) AS n, sum(total_score)::BIGINT AS total FROM fx_reports WHERE created_at >= TIMESTAMP '1998-01-01' GROUP BY 1", "fx_reports")
def reports_by_day(v):
    """Reports appended by month, and read back with the partitions that the filter leaves."""
    rows = v.reports.withColumns({"created_date": F.to_date("created_at"), "month": F.date_format("created_at", "yyyy-MM")})
    kept = store.written(rows.repartition("month"), "reports", ["month"])
    return kept.where("month >= '1998-01'").groupBy("created_date").agg(F.count(F.lit(1)).alias("n"), F.sum("total_score").alias("total"))


def _word_count_sql(term: str, text: str = "lower(text)") -> str:
    return rf"len(regexp_extract_all({text}, '\b{term}\b'))"


_FINDS = " UNION ALL ".join(f"SELECT resume_id, '{term}' AS term, {weight} AS weight, {_word_count_sql(term)} AS n FROM fx_resumes" for term, weight in TERMS)


@query("dictionary_finds", f"SELECT * FROM ({_FINDS}) WHERE n > 0", "fx_resumes")
def dictionary_finds(v):
    return x.boundary_finds(v.resumes, "resume_id", "text", TERMS)


@query("dictionary_weights", f"SELECT resume_id, sum(weight * n)::BIGINT AS total, count(*) AS n_terms, max_by(term, weight * n * 1000 - ord) AS best FROM (SELECT f.*, o.ord FROM ({_FINDS}) f JOIN (VALUES {', '.join(f'({k}, {chr(39)}{term}{chr(39)})' for k, (term, _) in enumerate(TERMS))}) o(ord, term) USING (term)) WHERE n > 0 GROUP BY resume_id", "fx_resumes")
def dictionary_weights(v):
    order = F.array_position(F.array(*[F.lit(term) for term, _ in TERMS]), F.col("term")) - 1
    rows = x.boundary_finds(v.resumes, "resume_id", "text", TERMS).withColumn("ord", order)
    return rows.groupBy("resume_id").agg(F.sum(F.col("weight") * F.col("n")).alias("total"), F.count(F.lit(1)).alias("n_terms"), F.max_by("term", F.col("weight") * F.col("n") * 1000 - F.col("ord")).alias("best"))


_BEHIND = "CASE WHEN instr(lower(jd_text), '{0}') > 0 THEN substr(lower(jd_text), instr(lower(jd_text), '{0}'), 80) ELSE '' END"
_SECTIONED = " UNION ALL ".join(rf"SELECT jd_id, '{term}' AS term, {_word_count_sql(term, 'lower(jd_text)')} * {weight} * CASE WHEN contains({_BEHIND.format('ther')}, '{term}') THEN 15 WHEN contains({_BEHIND.format('ing')}, '{term}') THEN 8 ELSE 10 END AS points FROM fx_jds" for term, weight in TERMS)


@query("jd_dictionary_points", f"SELECT * FROM ({_SECTIONED}) WHERE points > 0", "fx_jds")
def jd_dictionary_points(v):
    return x.section_weighted(v.jds, "jd_id", "jd_text", TERMS, "ther", "ing", 80)


def _bucket_sql(column: str) -> str:
    return "CASE" + "".join(" WHEN " + " OR ".join(f"contains({column}, '{w}')" for w in words) + f" THEN '{name}'" for name, words in BUCKETS) + " ELSE 'other' END"


@query("keyword_buckets", f"SELECT jd_id, {_bucket_sql('keyword')} AS bucket, count(*) AS n, string_agg(keyword, ',' ORDER BY keyword) AS keywords FROM fx_jd_keywords GROUP BY 1, 2", "fx_jd_keywords")
def keyword_buckets(v):
    rows = _keywords(v).withColumn("bucket", x.bucket(F.col("keyword"), BUCKETS, "other"))
    return rows.groupBy("jd_id", "bucket").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("keyword")), ",").alias("keywords"))


@query("first_distinct_tokens", "SELECT jd_id, count(*) AS n, string_agg(token, ' ' ORDER BY at_pos) AS tokens FROM (SELECT *, row_number() OVER (PARTITION BY jd_id ORDER BY at_pos) AS rn FROM (SELECT jd_id, token, min(pos) AS at_pos FROM fx_jd_tokens GROUP BY 1, 2)) WHERE rn <= 40 GROUP BY jd_id", "fx_jd_tokens")
def first_distinct_tokens(v):
    tokens = x.first_distinct(t.tokens(t.words_only(F.col("jd_text"))), 40)
    return v.jds.select("jd_id", F.size(tokens).cast("long").alias("n"), F.array_join(tokens, " ").alias("tokens"))


@query("keyword_cues", """SELECT resume_id, len(c) AS n_finds, CASE WHEN len(list_filter(c, lambda s: contains(lower(s), 'thation') OR contains(lower(s), 'elle'))) > 0 THEN 'critical'
WHEN len(list_filter(c, lambda s: contains(lower(s), 'ing'))) > 0 OR len(c) >= 3 THEN 'high' ELSE 'normal' END AS importance FROM (SELECT resume_id, regexp_extract_all(text, '(.{0,20}rest.{0,20})', 1) AS c FROM fx_resumes) WHERE len(c) > 0""", "fx_resumes")
def keyword_cues(v):
    rows = v.resumes.select("resume_id", t.context_characters(F.col("text"), "rest", 20).alias("c")).where(F.size("c") > 0)
    return rows.select("resume_id", F.size("c").alias("n_finds"), x.with_cues(F.col("c"), ["thation", "elle"], ["ing"]).alias("importance"))


@query("contained_keywords", """SELECT resume_id, keyword, other, how FROM (SELECT *, row_number() OVER (PARTITION BY resume_id, keyword ORDER BY how, p) AS n FROM (
SELECT a.resume_id, a.token AS keyword, k.keyword AS other, k.rnk AS p, CASE WHEN a.token = k.keyword THEN 1 WHEN contains(a.token, k.keyword) THEN 2 WHEN contains(k.keyword, a.token) THEN 3 END AS how
FROM (SELECT DISTINCT resume_id, token FROM fx_tokens WHERE length(token) > 3) a JOIN (SELECT resume_id, jd_id FROM fx_resumes WHERE jd_id IS NOT NULL) r USING (resume_id) JOIN fx_jd_keywords k USING (jd_id)) WHERE how IS NOT NULL) WHERE n = 1""", "fx_tokens fx_resumes fx_jd_keywords")
def contained_keywords(v):
    own = _tokens(v).where("length(token) > 3").groupBy("resume_id", F.col("token").alias("keyword")).agg(F.min("pos").alias("ord"))
    wanted = _pairs(v).join(_keywords(v), "jd_id").select("resume_id", "keyword", F.col("rnk").alias("ord"))
    return x.contained_keywords(own, wanted, "resume_id")


@query("all_tokens_matches", """SELECT p.resume_id, k.jd_id, count(*) AS n_words, count(t.token) AS n_found, count(*) = count(t.token) AS all_found FROM (SELECT resume_id, jd_id FROM fx_resumes WHERE jd_id IS NOT NULL) p
JOIN (SELECT jd_id, keyword FROM fx_jd_keywords WHERE rnk <= 3) k USING (jd_id) LEFT JOIN (SELECT DISTINCT resume_id, token FROM fx_tokens) t ON t.resume_id = p.resume_id AND t.token = k.keyword GROUP BY 1, 2""", "fx_resumes fx_jd_keywords fx_tokens")
def all_tokens_matches(v):
    rows = _matches(v).where("rnk <= 3")
    return rows.groupBy("resume_id", "jd_id").agg(F.count(F.lit(1)).alias("n_words"), F.count_if("matched").alias("n_found"), F.bool_and("matched").alias("all_found"))


@query("skill_merge", """SELECT jd_id, category, string_agg(term, ',' ORDER BY term) AS skills FROM (SELECT DISTINCT jd_id, CASE WHEN length(term) > 4 THEN 'long' ELSE 'short' END AS category, term FROM (
SELECT jd_id, keyword AS term FROM fx_jd_keywords UNION ALL SELECT jd_id, lower(term) FROM fx_jds JOIN fx_library ON library_id = jd_id)) GROUP BY 1, 2""", "fx_jd_keywords fx_jds fx_library")
def skill_merge(v):
    """Skill lists of two sources united by category, each term once."""
    own = _keywords(v).select("jd_id", F.col("keyword").alias("term"))
    more = v.jds.join(v.library, F.col("library_id") == F.col("jd_id")).select("jd_id", F.lower("term").alias("term"))
    rows = own.unionByName(more).withColumn("category", F.when(F.length("term") > 4, "long").otherwise("short"))
    return rows.groupBy("jd_id", "category").agg(F.array_join(F.array_sort(F.collect_set("term")), ",").alias("skills"))


@query("summary_enrichment", """SELECT resume_id, coalesce(string_agg(keyword, ', ' ORDER BY rnk), '') AS added, md5(summary || coalesce(' Skilled in ' || string_agg(keyword, ', ' ORDER BY rnk) || '.', '')) AS digest FROM (SELECT resume_id, jd_id, coalesce(lines[1], '') AS summary FROM fx_lines WHERE jd_id IS NOT NULL) s
LEFT JOIN (SELECT jd_id, keyword, rnk FROM fx_jd_keywords WHERE rnk <= 5) k ON k.jd_id = s.jd_id AND NOT contains(lower(summary), keyword) GROUP BY resume_id, summary""", "fx_lines fx_jd_keywords")
def summary_enrichment(v):
    rows = v.lines.where("jd_id IS NOT NULL").select("resume_id", "jd_id", F.coalesce(F.try_element_at("lines", F.lit(1)), F.lit("")).alias("summary"))
    words = _keywords(v).where("rnk <= 5").groupBy(F.col("jd_id").alias("__j")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rnk", "keyword"))), lambda k: k["keyword"]).alias("ks"))
    met = rows.join(words, F.col("jd_id") == F.col("__j"), "left")
    missing = F.filter(F.coalesce("ks", F.array().cast("array<string>")), lambda k: ~F.contains(F.lower("summary"), k))
    added = F.array_join(missing, ", ")
    enriched = F.when(added == "", F.col("summary")).otherwise(F.concat("summary", F.lit(" Skilled in "), added, F.lit(".")))
    return met.select("resume_id", added.alias("added"), F.md5(enriched.cast("binary")).alias("digest"))


@query("title_matches", "SELECT resume_id, title, len(list_filter(string_split(lower(title), ' '), lambda w: contains(lower(text), w))) > 0 AS title_in_text FROM fx_resumes", "fx_resumes")
def title_matches(v):
    return v.resumes.select("resume_id", "title", F.exists(F.split(F.lower("title"), " "), lambda w: F.contains(F.lower("text"), w)).alias("title_in_text"))


@query("edit_bounds", """SELECT e.resume_id, e.pos, b.text IS NOT NULL AS valid FROM (SELECT resume_id, resume_id % 12 AS pos FROM fx_resumes) e LEFT JOIN fx_bullets b ON b.resume_id = e.resume_id AND b.pos = e.pos""", "fx_resumes fx_bullets")
def edit_bounds(v):
    """Edits checked against the bullets that exist."""
    edits = v.resumes.select(F.col("resume_id").alias("r"), (F.col("resume_id") % 12).alias("p"))
    met = edits.join(v.bullets.select("resume_id", "pos", F.lit(True).alias("there")), (F.col("r") == F.col("resume_id")) & (F.col("p") == F.col("pos")), "left")
    return met.select(F.col("r").alias("resume_id"), F.col("p").alias("pos"), F.coalesce("there", F.lit(False)).alias("valid"))


@query("repetitive_bullets", r"""SELECT resume_id, pos, len(ws) AS n_words, len(list_distinct(ws)) * 2 < len(ws) AS repetitive FROM (SELECT resume_id, pos, list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '') AS ws FROM fx_bullets)""", "fx_bullets")
def repetitive_bullets(v):
    words = F.filter(F.split(F.lower("text"), "\\s+"), lambda w: w != "")
    return v.bullets.select("resume_id", "pos", F.size(words).alias("n_words"), (F.size(F.array_distinct(words)) * 2 < F.size(words)).alias("repetitive"))


@query("bullet_length_clamp", r"""SELECT resume_id, pos, array_to_string(ws[1:18], ' ') AS text, len(ws) < 5 AS too_short FROM (SELECT resume_id, pos, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS ws FROM fx_bullets)""", "fx_bullets")
def bullet_length_clamp(v):
    words = F.filter(F.split("text", "\\s+"), lambda w: w != "")
    return v.bullets.select("resume_id", "pos", F.array_join(F.slice(words, 1, 18), " ").alias("text"), (F.size(words) < 5).alias("too_short"))


@query("user_latest_resume", "SELECT user_id, resume_id, title FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, resume_id) AS rn FROM fx_resumes) WHERE rn = 1", "fx_resumes")
def user_latest_resume(v):
    return first_of(v.resumes, [F.col("user_id")], [F.desc("created_at"), F.asc("resume_id")]).select("user_id", "resume_id", "title")


@query("user_top_resumes", "SELECT user_id, resume_id, downloads, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY downloads DESC, resume_id) AS place FROM fx_resumes) WHERE place <= 3", "fx_resumes")
def user_top_resumes(v):
    return top_k(v.resumes.drop("text"), "user_id", [F.desc("downloads"), F.asc("resume_id")], 3, "place").select("user_id", "resume_id", "downloads", "place")


@query("section_sizes", "SELECT resume_id, len(lines) AS n_lines, greatest(len(lines) - 1, 0) AS n_bullets, CAST(ceil(greatest(len(lines) - 1, 0) / 3.0) AS BIGINT) AS n_items, len(lines) > 5 AS substantial FROM fx_lines", "fx_lines")
def section_sizes(v):
    n = F.size("lines")
    return v.lines.select("resume_id", n.alias("n_lines"), F.greatest(n - 1, F.lit(0)).alias("n_bullets"), F.ceil(F.greatest(n - 1, F.lit(0)) / 3).alias("n_items"), (n > 5).alias("substantial"))


@query("keyword_list_checks", f"SELECT jd_id, count(*) AS n, count(DISTINCT token) AS n_distinct, count(DISTINCT CASE WHEN length(token) BETWEEN 2 AND 100 AND token NOT IN ({', '.join(repr(w) for w in STOP)}) AND NOT regexp_matches(token, '^[0-9]+$') THEN token END) AS n_valid FROM fx_jd_tokens GROUP BY jd_id", "fx_jd_tokens")
def keyword_list_checks(v):
    token = F.col("token")
    valid = F.length(token).between(2, 100) & ~token.isin(STOP) & ~token.rlike("^[0-9]+$")
    return m.token_rows(v.jds, "jd_id", "jd_text").groupBy("jd_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("token").alias("n_distinct"), F.count_distinct(F.when(valid, token)).alias("n_valid"))
