"""Views over the given tables that stand for the engine's own tables, in Spark and in SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import trimmed
from .store import spread

SQL = {
    "fx_users": """
SELECT c_custkey AS user_id, c_name AS name, lower(c_name) || '@x.test' AS email,
       CASE WHEN c_custkey % 50 = 0 THEN 'ADMIN' ELSE 'USER' END AS role, c_acctbal >= 0 AS is_active,
       TIMESTAMP '2023-01-01' + to_hours(c_custkey) AS created_at, 'h' || c_custkey AS password_hash FROM customer""",
    "fx_resumes": """
SELECT doc_id AS resume_id, doc_id % 150 AS user_id, doc_id % (SELECT greatest(1, count(*)) FROM benchmark) AS jd_id, CASE WHEN doc_id % 9 <> 0 THEN doc_id % (SELECT greatest(1, count(*)) FROM benchmark) END AS own_jd_id, source AS title,
       CASE doc_id % 4 WHEN 0 THEN 'classic' WHEN 1 THEN 'fresher' WHEN 2 THEN 'tech' ELSE 'other' END AS template,
       TIMESTAMP '2023-01-01' + to_hours(doc_id * 7) AS created_at, n_chars % 7 AS downloads, coalesce(text, '') AS text FROM documents""",
    "fx_lines": r"""
SELECT *, CASE WHEN contains(lines[2], ',') THEN len(string_split(lines[2], ',')) ELSE 0 END AS n_skills, greatest(len(lines) - 9, 0) AS n_projects, coalesce(contains(lines[3], ','), false)::INT AS n_education,
       (coalesce(length(lines[4]), 0) > 120)::INT AS n_certifications, (coalesce(length(lines[5]), 0) > 120)::INT AS n_achievements
FROM (SELECT resume_id, jd_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines,
             regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') AS has_email, regexp_matches(text, '\+?[0-9][0-9 ()-]{7,}[0-9]') AS has_phone, len(regexp_extract_all(text, '[0-9]{4}')) AS n_dated FROM fx_resumes)""",
    "fx_bullets": """
SELECT resume_id, p - 1 AS pos, (p - 2) // 3 AS item_index, (p - 2) % 3 AS bullet_index, lines[p] AS text
FROM (SELECT resume_id, lines, unnest(range(2, len(lines) + 1)) AS p FROM fx_lines)""",
    "fx_jds": "SELECT item_id AS jd_id, text AS jd_text FROM benchmark",
    "fx_reports": """
SELECT o_orderkey AS report_id, o_custkey AS resume_id, o_orderdate AS created_at, CAST(floor(o_totalprice) AS BIGINT) % 101 AS total_score, o_orderkey % (SELECT greatest(1, count(*)) FROM benchmark) AS jd_id FROM orders""",
    "fx_score_now": """
SELECT resume_id, total_score, created_at, report_id FROM (SELECT *, row_number() OVER (PARTITION BY resume_id ORDER BY created_at DESC, report_id) AS rn FROM fx_reports) WHERE rn = 1""",
    "fx_library": """
SELECT p_partkey AS library_id, p_brand AS role, p_type AS category, 1 + p_size % 5 AS weight, p_partkey % 10 <> 0 AS is_active, unnest(string_split(p_name, ' ')) AS term FROM part""",
    "fx_access": "SELECT event_id, user_id AS key, ts, event_type AS action FROM events",
    "fx_templates": "SELECT * FROM (VALUES ('classic', 'Classic Professional', 1), ('fresher', 'Fresher', 2), ('tech', 'Experienced Tech', 3)) v(template, label, ord)",
    "fx_dict_stop": "SELECT * FROM (VALUES ('the'), ('and'), ('for'), ('that'), ('les'), ('des'), ('der'), ('die'), ('los'), ('las')) v(term)",
    "fx_dict_verbs": "SELECT * FROM (VALUES ('that', 'strong'), ('this', 'strong'), ('from', 'strong'), ('with', 'weak'), ('than', 'weak'), ('then', 'weak')) v(term, class)",
    "fx_dict_syn": "SELECT * FROM (VALUES ('rest', 'rest'), ('rest', 'threst'), ('rest', 'ther'), ('thin', 'thin'), ('thin', 'thing'), ('with', 'with'), ('with', 'avec')) v(grp, form)",
    "fx_dict_roles": "SELECT * FROM (VALUES (1, 'alpha', 'that'), (1, 'alpha', 'rest'), (2, 'beta', 'elle'), (2, 'beta', 'ment'), (3, 'gamma', 'sich'), (3, 'gamma', 'keit')) v(ord, role, term)",
    "fx_tokens": r"""
SELECT resume_id, unnest(range(1, len(tokens) + 1)) AS pos, unnest(tokens) AS token
FROM (SELECT resume_id, list_filter(string_split_regex(trim(regexp_replace(regexp_replace(lower(text), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS tokens FROM fx_resumes)""",
    "fx_jd_tokens": r"""
SELECT jd_id, unnest(range(1, len(tokens) + 1)) AS pos, unnest(tokens) AS token
FROM (SELECT jd_id, list_filter(string_split_regex(trim(regexp_replace(regexp_replace(lower(jd_text), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS tokens FROM fx_jds)""",
    "fx_jd_keywords": """
SELECT jd_id, token AS keyword, least(n, 5) AS weight, rnk FROM (
  SELECT jd_id, token, count(*) AS n, row_number() OVER (PARTITION BY jd_id ORDER BY count(*) DESC, min(pos)) AS rnk
  FROM fx_jd_tokens WHERE length(token) > 2 AND token NOT IN (SELECT term FROM fx_dict_stop) GROUP BY jd_id, token) WHERE rnk <= 15""",
}

#: Which views a view's SQL names.
NEEDS = {
    "fx_lines": ["fx_resumes"],
    "fx_bullets": ["fx_lines"],
    "fx_score_now": ["fx_reports"],
    "fx_tokens": ["fx_resumes"],
    "fx_jd_tokens": ["fx_jds"],
    "fx_jd_keywords": ["fx_jd_tokens", "fx_dict_stop"],
}


def with_views(names: list[str], sql: str) -> str:
    """``sql`` after the views that it names, in the order of their needs."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    views = ",\n".join(f"{n} AS ({SQL[n].strip()})" for n in order)
    body = sql.strip()
    if not views:
        return body
    return f"WITH {views},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {views}\n{body}"


STOP = ["the", "and", "for", "that", "les", "des", "der", "die", "los", "las"]
VERBS = {"strong": ["that", "this", "from"], "weak": ["with", "than", "then"]}
SYNONYMS = {"rest": ["rest", "threst", "ther"], "thin": ["thin", "thing"], "with": ["with", "avec"]}
ROLES = {"alpha": ["that", "rest"], "beta": ["elle", "ment"], "gamma": ["sich", "keit"]}


EMAIL, PHONE = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}", "\\+?[0-9][0-9 ()-]{7,}[0-9]"


class Views:
    """The fixture views as DataFrames; each is made once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def users(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.table("customer").select(key.alias("user_id"), F.col("c_name").alias("name"), F.concat(F.lower("c_name"), F.lit("@x.test")).alias("email"), F.when(key % 50 == 0, "ADMIN").otherwise("USER").alias("role"), (F.col("c_acctbal") >= 0).alias("is_active"), _hours(key).alias("created_at"), F.concat(F.lit("h"), key).alias("password_hash"))

    @cached_property
    def resumes(self) -> DataFrame:
        """``jd_id`` gives every résumé a requirement; ``own_jd_id`` is absent from one in nine."""
        key = F.col("doc_id")
        template = F.element_at(F.array(*map(F.lit, ("classic", "fresher", "tech", "other"))), (key % 4 + 1).cast("int"))
        return spread(self.table("documents")).select(key.alias("resume_id"), (key % 150).alias("user_id"), F.pmod(key, F.lit(self.n_jds)).alias("jd_id"), F.when(key % 9 != 0, F.pmod(key, F.lit(self.n_jds))).alias("own_jd_id"), F.col("source").alias("title"), template.alias("template"), _hours(key * 7).alias("created_at"), (F.col("n_chars") % 7).alias("downloads"), F.coalesce("text", F.lit("")).alias("text"))

    @cached_property
    def lines(self) -> DataFrame:
        return self.lined.drop("text")

    @cached_property
    def lined(self) -> DataFrame:
        """Texts with their trimmed lines, and what stands for a résumé's sections: contact data and numbers from the text, and signs of single lines."""
        lines = F.filter(F.transform(F.split("text", "\n"), lambda x: trimmed(x)), lambda x: x != "")
        rows = self.resumes.select("resume_id", "jd_id", "text", lines.alias("lines"), (F.contains("text", F.lit("@")) & F.col("text").rlike(EMAIL.replace("+@", "@"))).alias("has_email"), F.col("text").rlike(PHONE).alias("has_phone"), F.regexp_count("text", F.lit("[0-9]{4}")).alias("n_dated"))
        line = lambda k: F.coalesce(F.try_element_at("lines", F.lit(k)), F.lit(""))
        return rows.withColumns({
            "n_skills": F.when(line(2).contains(","), F.size(F.split(line(2), ","))).otherwise(0),
            "n_projects": F.greatest(F.size("lines") - 9, F.lit(0)),
            "n_education": line(3).contains(",").cast("int"),
            "n_certifications": (F.length(line(4)) > 120).cast("int"),
            "n_achievements": (F.length(line(5)) > 120).cast("int"),
        })

    @cached_property
    def bullets(self) -> DataFrame:
        # outer, as an inner one is filtered by the number of lines first, for which they are made twice
        rows = self.lines.select("resume_id", F.posexplode_outer("lines").alias("pos", "text")).where("pos > 0")
        return rows.select("resume_id", F.col("pos").cast("long").alias("pos"), F.expr("(pos - 1) div 3").alias("item_index"), ((F.col("pos") - 1) % 3).cast("long").alias("bullet_index"), "text")

    @cached_property
    def jds(self) -> DataFrame:
        return self.table("benchmark").select(F.col("item_id").alias("jd_id"), F.col("text").alias("jd_text"))

    @cached_property
    def n_jds(self) -> int:
        return max(1, self.jds.count())

    @cached_property
    def reports(self) -> DataFrame:
        return self.table("orders").select(F.col("o_orderkey").alias("report_id"), F.col("o_custkey").alias("resume_id"), F.col("o_orderdate").alias("created_at"), (F.floor("o_totalprice") % 101).alias("total_score"), F.pmod("o_orderkey", F.lit(self.n_jds)).alias("jd_id"))

    @cached_property
    def library(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("library_id"), F.col("p_brand").alias("role"), F.col("p_type").alias("category"), (1 + F.col("p_size") % 5).alias("weight"), (F.col("p_partkey") % 10 != 0).alias("is_active"), F.explode(F.split("p_name", " ")).alias("term"))

    @cached_property
    def access(self) -> DataFrame:
        return self.table("events").select("event_id", F.col("user_id").alias("key"), "ts", F.col("event_type").alias("action"))

    @cached_property
    def templates(self) -> DataFrame:
        return self.spark.createDataFrame([("classic", "Classic Professional", 1), ("fresher", "Fresher", 2), ("tech", "Experienced Tech", 3)], "template string, label string, ord int")


def _hours(n):
    return F.timestamp_seconds(F.lit(1672531200) + n * 3600)
