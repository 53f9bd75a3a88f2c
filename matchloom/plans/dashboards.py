"""Queries of the dashboards and of the stored snapshots."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import dashboards as d
from ._register import query


@query("users_with_resume_count", "SELECT user_id, name, email, role, is_active, coalesce(n, 0) AS resume_count FROM fx_users LEFT JOIN (SELECT user_id, count(*) AS n FROM fx_resumes GROUP BY user_id) USING (user_id)", "fx_users fx_resumes")
def users_with_resume_count(v):
    safe = v.users.drop("password_hash")
    return d.with_count(safe, v.resumes, "user_id", "resume_count").select("user_id", "name", "email", "role", "is_active", "resume_count")


@query("users_page", "SELECT user_id, name, email, created_at FROM fx_users ORDER BY created_at DESC, user_id LIMIT 10 OFFSET 10", "fx_users")
def users_page(v):
    return d.page(v.users, [F.desc("created_at"), F.asc("user_id")], 2, 10).select("user_id", "name", "email", "created_at")


@query("users_page_count", "SELECT count(*) AS total, CAST(ceil(count(*) / 10.0) AS BIGINT) AS pages FROM fx_users", "fx_users")
def users_page_count(v):
    return d.page_count(v.users, 10)


@query("users_search", "SELECT user_id, name, email FROM fx_users WHERE regexp_matches(name, '(?i)00000001') OR regexp_matches(email, '(?i)42@X')", "fx_users")
def users_search(v):
    return v.users.where(F.col("name").rlike("(?i)00000001") | F.col("email").rlike("(?i)42@X")).select("user_id", "name", "email")


@query("user_role_stats", "SELECT count(*) AS users, count_if(is_active) AS active_users, count_if(role = 'ADMIN') AS admins FROM fx_users", "fx_users")
def user_role_stats(v):
    return v.users.agg(F.count(F.lit(1)).alias("users"), F.count_if("is_active").alias("active_users"), F.count_if(F.col("role") == "ADMIN").alias("admins"))


@query("user_role_counts", "SELECT role, is_active, count(*) AS n FROM fx_users GROUP BY role, is_active", "fx_users")
def user_role_counts(v):
    return v.users.groupBy("role", "is_active").agg(F.count(F.lit(1)).alias("n"))


@query("resumes_with_owner", "SELECT resume_id, title, user_id, coalesce(u.name, 'Unknown User') AS owner_name, u.email AS owner_email FROM fx_resumes r LEFT JOIN fx_users u USING (user_id)", "fx_resumes fx_users")
def resumes_with_owner(v):
    return d.with_owner(v.resumes.select("resume_id", "title", "user_id"), v.users)


@query("resumes_with_latest_score", "SELECT resume_id, title, total_score, s.created_at AS scored_at FROM fx_resumes r LEFT JOIN fx_score_now s USING (resume_id)", "fx_resumes fx_score_now")
def resumes_with_latest_score(v):
    reports = v.reports.withColumnRenamed("created_at", "scored_at")
    return d.with_latest(v.resumes.select("resume_id", "title"), reports, "resume_id", "scored_at", "report_id", ["total_score", "scored_at"])


@query("resume_effective_jd", """
SELECT r.resume_id, coalesce(r.own_jd_id, n.jd_id) AS jd_id, coalesce(length(jd_text), 0) AS jd_chars
FROM fx_resumes r LEFT JOIN (SELECT resume_id, jd_id FROM (SELECT *, row_number() OVER (PARTITION BY resume_id ORDER BY created_at DESC, report_id) AS rn FROM fx_reports) WHERE rn = 1) n USING (resume_id)
LEFT JOIN fx_jds j ON j.jd_id = coalesce(r.own_jd_id, n.jd_id)""", "fx_resumes fx_reports fx_jds")
def resume_effective_jd(v):
    reports = v.reports.withColumnRenamed("jd_id", "report_jd")
    rows = d.with_latest(v.resumes.select("resume_id", "own_jd_id"), reports, "resume_id", "created_at", "report_id", ["report_jd"])
    rows = rows.select("resume_id", F.coalesce("own_jd_id", "report_jd").alias("jd"))
    return rows.join(v.jds, F.col("jd") == F.col("jd_id"), "left").select("resume_id", F.col("jd").alias("jd_id"), F.coalesce(F.length("jd_text"), F.lit(0)).alias("jd_chars"))


@query("score_history", "SELECT resume_id, report_id, created_at, total_score, recency FROM (SELECT *, row_number() OVER (PARTITION BY resume_id ORDER BY created_at DESC, report_id) AS recency FROM fx_reports) WHERE recency <= 20", "fx_reports")
def score_history(v):
    return d.latest_per_key(v.reports, "resume_id", "created_at", "report_id", 20).select("resume_id", "report_id", "created_at", "total_score", "recency")


@query("score_history_improvement", """
SELECT resume_id, count(*) AS n_reports, max(total_score) FILTER (recency = 1) AS newest, max(total_score) FILTER (recency = last) AS oldest,
       max(total_score) FILTER (recency = 1) - max(total_score) FILTER (recency = last) AS improvement
FROM (SELECT *, max(recency) OVER (PARTITION BY resume_id) AS last FROM (SELECT *, row_number() OVER (PARTITION BY resume_id ORDER BY created_at DESC, report_id) AS recency FROM fx_reports) WHERE recency <= 10) GROUP BY resume_id""", "fx_reports")
def score_history_improvement(v):
    rows = d.latest_per_key(v.reports, "resume_id", "created_at", "report_id", 10)
    out = rows.groupBy("resume_id").agg(F.count(F.lit(1)).alias("n_reports"), F.min_by("total_score", "recency").alias("newest"), F.max_by("total_score", "recency").alias("oldest"))
    return out.withColumn("improvement", F.col("newest") - F.col("oldest"))


@query("dashboard_totals", """
SELECT (SELECT count(*) FROM fx_users) AS users, (SELECT count(*) FROM fx_resumes) AS resumes, (SELECT sum(downloads)::BIGINT FROM fx_resumes) AS downloads,
       (SELECT CAST(floor(avg(total_score) * 10 + 0.5) / 10 AS DECIMAL(18,1)) FROM fx_score_now) AS average_score, (SELECT count_if(total_score >= 80) FROM fx_score_now) AS good_scores""", "fx_users fx_resumes fx_score_now")
def dashboard_totals(v):
    users = v.users.agg(F.count(F.lit(1)).alias("users"))
    resumes = v.resumes.agg(F.count(F.lit(1)).alias("resumes"), F.sum("downloads").alias("downloads"))
    now = d.latest_per_key(v.reports, "resume_id", "created_at", "report_id")
    scores = now.agg(d.one_decimal(F.coalesce(F.avg("total_score"), F.lit(0))).alias("average_score"), F.count_if(F.col("total_score") >= 80).alias("good_scores"))
    one = lambda row: row.withColumn("__one", F.lit(1))  # noqa: E731  one row each
    return one(users).join(one(resumes), "__one").join(one(scores), "__one").drop("__one")


@query("monthly_resumes", "SELECT year(created_at) AS year, month(created_at) AS month, count(*) AS n, strftime(min(created_at), '%b') AS label FROM fx_resumes GROUP BY 1, 2 ORDER BY 1, 2", "fx_resumes")
def monthly_resumes(v):
    return d.monthly(v.resumes, "created_at").orderBy("year", "month")


@query("score_histogram", """
WITH b AS (SELECT CASE WHEN total_score <= 20 THEN 0 WHEN total_score <= 40 THEN 1 WHEN total_score <= 60 THEN 2 WHEN total_score <= 80 THEN 3 ELSE 4 END AS bucket FROM fx_score_now WHERE total_score BETWEEN 0 AND 100)
SELECT v.bucket, v.label, count(b.bucket) AS n, CAST(floor(count(b.bucket) * 1000.0 / sum(count(b.bucket)) OVER () + 0.5) / 10 AS DECIMAL(18,1)) AS share
FROM (VALUES (0, '0-20'), (1, '21-40'), (2, '41-60'), (3, '61-80'), (4, '81-100')) v(bucket, label) LEFT JOIN b ON b.bucket = v.bucket GROUP BY v.bucket, v.label""", "fx_score_now")
def score_histogram(v):
    return d.histogram(d.latest_per_key(v.reports, "resume_id", "created_at", "report_id"), "total_score", [0, 20, 40, 60, 80, 100])


@query("template_usage", "SELECT template, coalesce(label, template) AS label, count(*) AS n FROM fx_resumes LEFT JOIN fx_templates USING (template) GROUP BY 1, 2", "fx_resumes fx_templates")
def template_usage(v):
    label = F.create_map(*[F.lit(x) for pair in (("classic", "Classic Professional"), ("fresher", "Fresher"), ("tech", "Experienced Tech")) for x in pair])
    return v.resumes.groupBy("template").agg(F.count(F.lit(1)).alias("n")).select("template", F.coalesce(F.try_element_at(label, F.col("template")), F.col("template")).alias("label"), "n")


@query("template_normalised", "SELECT resume_id, CASE WHEN lower(trim(template)) IN ('classic', 'fresher', 'tech') THEN lower(trim(template)) WHEN lower(trim(template)) = 'experienced-tech' THEN 'tech' ELSE 'classic' END AS template FROM fx_resumes", "fx_resumes")
def template_normalised(v):
    low = F.lower(F.trim("template"))
    return v.resumes.select("resume_id", F.when(low.isin("classic", "fresher", "tech"), low).when(low == "experienced-tech", "tech").otherwise("classic").alias("template"))


@query("user_dashboard", """
SELECT r.user_id, count(*) AS resumes, CAST(floor(avg(s.total_score) * 10 + 0.5) / 10 AS DECIMAL(18,1)) AS average_score, sum(r.downloads)::BIGINT AS downloads,
       max(r.created_at) AS last_update, bool_or(r.jd_id IS NOT NULL) AS any_jd FROM fx_resumes r LEFT JOIN fx_score_now s USING (resume_id) GROUP BY r.user_id""", "fx_resumes fx_score_now")
def user_dashboard(v):
    rows = d.with_latest(v.resumes.drop("text"), v.reports.withColumnRenamed("created_at", "scored_at"), "resume_id", "scored_at", "report_id", ["total_score"])
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("resumes"), d.one_decimal(F.avg("total_score")).alias("average_score"), F.sum("downloads").alias("downloads"), F.max("created_at").alias("last_update"), F.bool_or(F.col("jd_id").isNotNull()).alias("any_jd"))


@query("library_stats", "SELECT count(*) AS roles, sum(n)::BIGINT AS keywords, CAST(floor(avg(n) * 10 + 0.5) / 10 AS DECIMAL(18,1)) AS mean_keywords FROM (SELECT role, count(DISTINCT term) AS n FROM fx_library GROUP BY role)", "fx_library")
def library_stats(v):
    per = v.library.groupBy("role").agg(F.count_distinct("term").alias("n"))
    return per.agg(F.count(F.lit(1)).alias("roles"), F.sum("n").alias("keywords"), d.one_decimal(F.avg("n")).alias("mean_keywords"))


@query("library_search", "SELECT library_id, role, string_agg(term, ' ' ORDER BY term) AS terms FROM fx_library WHERE is_active GROUP BY library_id, role HAVING regexp_matches(role, '(?i)#12') OR bool_or(regexp_matches(term, '(?i)^a')) ORDER BY library_id LIMIT 50", "fx_library")
def library_search(v):
    rows = v.library.where("is_active").groupBy("library_id", "role").agg(F.collect_list("term").alias("terms"))
    found = rows.where(F.col("role").rlike("(?i)#12") | F.exists("terms", lambda t: t.rlike("(?i)^a")))
    return found.orderBy("library_id").limit(50).select("library_id", "role", F.array_join(F.array_sort("terms"), " ").alias("terms"))


@query("template_stats", "SELECT template, count(*) AS n, sum(downloads)::BIGINT AS usage, CAST(floor(avg(total_score) * 10 + 0.5) / 10 AS DECIMAL(18,1)) AS mean_score FROM fx_resumes LEFT JOIN fx_score_now USING (resume_id) GROUP BY template", "fx_resumes fx_score_now")
def template_stats(v):
    rows = d.with_latest(v.resumes.drop("text"), v.reports.withColumnRenamed("created_at", "scored_at"), "resume_id", "scored_at", "report_id", ["total_score"])
    return rows.groupBy("template").agg(F.count(F.lit(1)).alias("n"), F.sum("downloads").alias("usage"), d.one_decimal(F.avg("total_score")).alias("mean_score"))


@query("recent_resumes", "SELECT resume_id, title, created_at FROM fx_resumes ORDER BY created_at DESC, resume_id LIMIT 5", "fx_resumes")
def recent_resumes(v):
    return d.page(v.resumes, [F.desc("created_at"), F.asc("resume_id")], 1, 5).select("resume_id", "title", "created_at")


@query("score_leaderboard", "SELECT resume_id, total_score, row_number() OVER (ORDER BY total_score DESC, resume_id) AS place FROM fx_score_now ORDER BY place LIMIT 25", "fx_score_now")
def score_leaderboard(v):
    now = d.latest_per_key(v.reports, "resume_id", "created_at", "report_id")
    best = now.orderBy(F.desc("total_score"), "resume_id").limit(25)
    return best.select("resume_id", "total_score", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("total_score"), "resume_id")).alias("place"))


FEED_SQL = """
SELECT kind, item_id, happened FROM (
  (SELECT 'user' AS kind, user_id AS item_id, created_at AS happened FROM fx_users ORDER BY created_at DESC, user_id LIMIT 5)
  UNION ALL (SELECT 'resume', resume_id, created_at FROM fx_resumes ORDER BY created_at DESC, resume_id LIMIT 5)
  UNION ALL (SELECT 'report', report_id, created_at FROM fx_reports ORDER BY created_at DESC, report_id LIMIT 5)
  UNION ALL (SELECT 'download', resume_id, created_at FROM fx_resumes WHERE downloads > 0 ORDER BY created_at DESC, resume_id LIMIT 5)
) ORDER BY happened DESC, kind, item_id LIMIT 12"""


@query("activity_feed", FEED_SQL, "fx_users fx_resumes fx_reports")
def activity_feed(v):
    branch = lambda rows, kind, key: rows.select(F.lit(kind).alias("kind"), F.col(key).alias("item_id"), F.col("created_at").alias("happened"))
    return d.feed([branch(v.users, "user", "user_id"), branch(v.resumes, "resume", "resume_id"), branch(v.reports, "report", "report_id"), branch(v.resumes.where("downloads > 0"), "download", "resume_id")], 5, 12)


@query("scored_resumes", "SELECT resume_id, title, downloads, jd_id FROM fx_resumes WHERE downloads > 0 AND jd_id IS NOT NULL", "fx_resumes")
def scored_resumes(v):
    return v.resumes.where((F.col("downloads") > 0) & F.col("jd_id").isNotNull()).select("resume_id", "title", "downloads", "jd_id")


@query("resume_by_owner", "SELECT resume_id, user_id, title FROM fx_resumes WHERE user_id = 7", "fx_resumes")
def resume_by_owner(v):
    return v.resumes.where("user_id = 7").select("resume_id", "user_id", "title")


@query("backfill_scores", """
SELECT r.resume_id, r.downloads AS old_score, coalesce(s.total_score, r.downloads) AS new_score, s.total_score IS NOT NULL AND s.total_score IS DISTINCT FROM r.downloads AS changed
FROM fx_resumes r LEFT JOIN fx_score_now s USING (resume_id)""", "fx_resumes fx_score_now")
def backfill_scores(v):
    rows = d.with_latest(v.resumes.select("resume_id", F.col("downloads").alias("old_score")), v.reports, "resume_id", "created_at", "report_id", ["total_score"])
    changed = F.col("total_score").isNotNull() & ~F.col("total_score").eqNullSafe(F.col("old_score"))
    return rows.select("resume_id", "old_score", F.coalesce("total_score", "old_score").alias("new_score"), changed.alias("changed"))


@query("snapshot_upsert", """
SELECT coalesce(s.user_id, c.user_id) AS user_id, coalesce(c.name, s.name) AS name, coalesce(c.email, s.email) AS email
FROM (SELECT user_id, name, email FROM fx_users) s
FULL JOIN (SELECT user_id + 25 AS user_id, CASE WHEN user_id % 3 = 0 THEN NULL ELSE 'new ' || name END AS name, CASE WHEN user_id % 2 = 0 THEN NULL ELSE upper(email) END AS email FROM fx_users WHERE user_id % 5 = 0) c ON s.user_id = c.user_id""", "fx_users")
def snapshot_upsert(v):
    base = v.users.select("user_id", "name", "email")
    changes = base.where("user_id % 5 = 0").select((F.col("user_id") + 25).alias("user_id"), F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("new "), "name")).alias("name"), F.when(F.col("user_id") % 2 != 0, F.upper("email")).alias("email"))
    return d.merged(base, changes, "user_id")


@query("snapshot_delete", "SELECT user_id, name FROM fx_users WHERE user_id NOT IN (SELECT key FROM fx_access)", "fx_users fx_access")
def snapshot_delete(v):
    return d.without_keys(v.users.select("user_id", "name"), v.access.select(F.col("key").alias("user_id")), "user_id")


@query("download_counters", "SELECT r.resume_id, r.downloads + coalesce(n, 0) AS downloads FROM fx_resumes r LEFT JOIN (SELECT key, count(*) AS n FROM fx_access GROUP BY key) e ON e.key = r.resume_id", "fx_resumes fx_access")
def download_counters(v):
    return d.counters_added(v.resumes.select("resume_id", "downloads"), v.access.select(F.col("key").alias("resume_id")), "resume_id", "downloads")


@query("role_keywords_added", """
SELECT role, term FROM (SELECT DISTINCT role, lower(term) AS term FROM fx_library) UNION SELECT DISTINCT role, 'added' FROM fx_library WHERE role LIKE '%2%'""", "fx_library")
def role_keywords_added(v):
    have = v.library.select("role", F.lower("term").alias("term")).distinct()
    adds = v.library.where(F.col("role").contains("2")).select("role", F.lit("added").alias("term")).distinct()
    return have.unionByName(adds.join(have, ["role", "term"], "left_anti"))


@query("role_keywords_removed", "SELECT DISTINCT role, lower(term) AS term FROM fx_library WHERE lower(term) NOT IN (SELECT lower(term) FROM fx_library WHERE library_id % 97 = 0)", "fx_library")
def role_keywords_removed(v):
    have = v.library.select("role", F.lower("term").alias("term")).distinct()
    return have.join(v.library.where("library_id % 97 = 0").select(F.lower("term").alias("term")).distinct(), "term", "left_anti").select("role", "term")


@query("library_top_terms", "SELECT role, term, n, rnk FROM (SELECT role, term, count(*) AS n, row_number() OVER (PARTITION BY role ORDER BY count(*) DESC, term) AS rnk FROM fx_library GROUP BY role, term) WHERE rnk <= 10", "fx_library")
def library_top_terms(v):
    counts = v.library.groupBy("role", "term").agg(F.count(F.lit(1)).alias("n"))
    return d.top_k(counts, "role", [F.desc("n"), F.asc("term")], 10, "rnk").select("role", "term", "n", "rnk")


@query("score_delta", """
SELECT resume_id, a.total_score AS score_before, b.total_score AS score_after, b.total_score - a.total_score AS delta,
       CASE WHEN a.total_score = 0 THEN NULL ELSE CAST(floor((b.total_score - a.total_score) * 1000.0 / a.total_score + 0.5) / 10 AS DECIMAL(18,1)) END AS delta_percent,
       a.total_score || ' → ' || b.total_score || ' (' || CASE WHEN b.total_score >= a.total_score THEN '+' ELSE '' END || (b.total_score - a.total_score) || ')' AS label
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY resume_id ORDER BY created_at DESC, report_id) AS rn FROM fx_reports) WHERE rn = 2) a
JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY resume_id ORDER BY created_at DESC, report_id) AS rn FROM fx_reports) WHERE rn = 1) b USING (resume_id)""", "fx_reports")
def score_delta(v):
    rows = d.latest_per_key(v.reports, "resume_id", "created_at", "report_id", 2)
    two = rows.groupBy("resume_id").agg(F.max(F.when(F.col("recency") == 2, F.col("total_score"))).alias("score_before"), F.max(F.when(F.col("recency") == 1, F.col("total_score"))).alias("score_after")).where("score_before IS NOT NULL")
    delta = F.col("score_after") - F.col("score_before")
    label = F.concat("score_before", F.lit(" → "), "score_after", F.lit(" ("), F.when(delta >= 0, "+").otherwise(""), delta, F.lit(")"))
    return two.select("resume_id", "score_before", "score_after", delta.alias("delta"), d.one_decimal(F.try_divide(delta * 100, F.col("score_before"))).alias("delta_percent"), label.alias("label"))
