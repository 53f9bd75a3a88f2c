"""Queries of nested résumés."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as f
from ..operators import nested as n
from ..sources import store
from ..sources.fixtures import VERBS
from . import component_sql as c
from ._register import query
from .suggestions import _sanitised_sql


def _nested(v):
    """Documents as nested résumés: the first line is the summary; bullets are two jobs and a project of three each."""
    rows = v.lines.join(v.resumes.select(F.col("resume_id").alias("__r"), "title"), F.col("resume_id") == F.col("__r"))
    summary = F.coalesce(F.try_element_at("lines", F.lit(1)), F.lit(""))
    part = lambda k: F.slice("lines", k, 3)
    words = F.slice(F.filter(F.split(summary, " "), lambda x: x != ""), 1, 3)
    filled = lambda items, name: F.filter(items, lambda x: F.size(x[name]) > 0)
    return rows.select(
        "resume_id", "title", summary.alias("summary"),
        filled(F.array(F.struct(F.lit("General").alias("category"), words.alias("items"))), "items").alias("skills"),
        filled(F.array(F.struct(F.lit("A").alias("company"), part(2).alias("bullets")), F.struct(F.lit("B").alias("company"), part(5).alias("bullets"))), "bullets").alias("experience"),
        filled(F.array(F.struct(F.lit("P").alias("title"), part(8).alias("bullets"))), "bullets").alias("projects"),
        F.array(F.struct(F.col("title").alias("institution"), F.lit("BSc").alias("degree"), F.lit(None).cast("string").alias("description"))).alias("education"),
        F.array().cast("array<struct<name:string,issuer:string>>").alias("certifications"),
    )


def _edits(docs):
    """An edit of every kind for each document, stale, repeated and invalid ones, too."""
    bullet = F.get(F.get("experience", F.lit(0))["bullets"], F.lit(0))
    added = F.concat(F.lit("Added "), F.substring("summary", 1, 20))
    rows = [
        ("summary", None, None, None, F.concat(F.lit("Short: "), F.substring("summary", 1, 30))),
        ("experience", 0, 0, bullet, F.concat(F.lit("Led "), bullet)),
        ("experience", 0, 0, bullet, F.concat(F.lit("Stale "), bullet)),
        ("experience", 1, 7, None, added),
        ("experience", 1, None, None, added),
        ("experience", 9, 0, None, F.lit("x")),
        ("projects", 0, 2, None, F.concat(F.lit("Third "), F.col("title"))),
        ("skills", None, None, None, F.lit("Spark")),
        ("skills", None, None, None, F.lit("spark")),
        ("education", 0, None, None, F.concat(F.lit("Thesis on "), F.col("title"))),
        ("certifications", None, None, None, F.lit("Certified")),
        ("certifications", 0, None, None, F.lit("Certified twice")),
        ("hobbies", 0, None, None, F.lit("x")),
    ]
    text = lambda x: (x if x is not None else F.lit(None)).cast("string")
    told = [F.struct(F.lit(k).alias("seq"), F.lit(s).alias("section"), F.lit(i).cast("int").alias("item_index"), F.lit(b).cast("int").alias("bullet_index"), text(old).alias("current_text"), text(new).alias("improved_text")) for k, (s, i, b, old, new) in enumerate(rows)]
    return docs.select("resume_id", F.explode(F.array(*told)).alias("e")).select("resume_id", "e.*")


def _clean(x: str) -> str:
    return f"(CASE WHEN {_sanitised_sql(x)} <> '' AND NOT regexp_matches({_sanitised_sql(x)}, '[.!?]$') THEN {_sanitised_sql(x)} || '.' ELSE {_sanitised_sql(x)} END)"


_DOCS = "SELECT resume_id, title, s, lines, lines[2:4] AS a, lines[5:7] AS b, lines[8:10] AS p, list_filter(string_split(s, ' '), lambda x: x <> '')[1:3] AS w FROM (SELECT l.resume_id, r.title, l.lines, coalesce(l.lines[1], '') AS s FROM fx_lines l JOIN fx_resumes r ON r.resume_id = l.resume_id)"


@query("nested_edits_applied", f"""SELECT resume_id, 'Short: ' || left(s, 30) AS summary,
md5(concat_ws('|', CASE WHEN len(a) > 0 THEN array_to_string([{_clean("'Led ' || a[1]")}] || a[2:], '/') END, CASE WHEN len(b) > 0 THEN array_to_string(b || [{_clean("'Added ' || left(s, 20)")}], '/') END)) AS jobs,
md5(CASE WHEN len(p) > 0 THEN array_to_string(p[1:2] || [{_clean("'Third ' || title")}], '/') ELSE '' END) AS projects,
array_to_string(w || ['Spark'], '/') AS skills, 'Thesis on ' || title AS education, 'Certified twice' AS certifications,
concat_ws(',', 'applied', CASE WHEN len(a) > 0 THEN 'applied,stale' ELSE 'invalid,invalid' END, CASE WHEN len(b) > 0 THEN 'applied,exists' ELSE 'invalid,invalid' END, 'invalid', CASE WHEN len(p) > 0 THEN 'applied' ELSE 'invalid' END, 'applied,exists,applied,applied,applied,invalid') AS edit_log
FROM ({_DOCS})""", "fx_lines fx_resumes")
def nested_edits_applied(v):
    docs = _nested(v)
    out = n.with_edits(docs, _edits(docs))
    lists = lambda column, name: F.transform(column, lambda x: F.array_join(x[name], "/"))
    return out.select(
        "resume_id", "summary", F.md5(F.array_join(lists("experience", "bullets"), "|").cast("binary")).alias("jobs"), F.md5(F.array_join(lists("projects", "bullets"), "|").cast("binary")).alias("projects"),
        F.array_join(lists("skills", "items"), "|").alias("skills"), F.get("education", F.lit(0))["description"].alias("education"), F.array_join(F.transform("certifications", lambda x: x["name"]), "|").alias("certifications"), F.array_join("edit_log", ",").alias("edit_log"),
    )


@query("nested_sanitised", f"""SELECT resume_id, CASE WHEN resume_id % 7 = 0 THEN '' ELSE trim(s) END AS summary, CASE WHEN len(w) > 0 THEN 1 ELSE 0 END AS n_groups,
array_to_string(list_filter(list_transform(a || b, lambda x, i: CASE WHEN (CASE WHEN i > len(a) THEN i - len(a) ELSE i END) = 2 THEN '' WHEN (CASE WHEN i > len(a) THEN i - len(a) ELSE i END) = 3 THEN 'Consider adding ' || left(x, 10) || ' 40%' ELSE x END), lambda x: x <> ''), '/') AS bullets,
'' AS degree, title AS institution FROM ({_DOCS})""", "fx_lines fx_resumes")
def nested_sanitised(v):
    """Advice put among the texts goes, with the group that holds nothing else; measured results stay."""
    put = lambda x, i: F.when(i == 1, F.concat(F.lit("Add measurable impact to "), F.substring(x, 1, 20))).when(i == 2, F.concat(F.lit("Consider adding "), F.substring(x, 1, 10), F.lit(" 40%"))).otherwise(x)
    docs = _nested(v).withColumns({
        "summary": F.when(F.col("resume_id") % 7 == 0, F.lit(" This suggestion is no content ")).otherwise(F.col("summary")),
        "experience": F.transform("experience", lambda e: e.withField("bullets", F.transform(e["bullets"], put))),
        "skills": F.concat("skills", F.array(F.struct(F.lit("Advice").alias("category"), F.array(F.lit("consider adding Spark")).alias("items")))),
        "education": F.transform("education", lambda e: e.withField("degree", F.lit("currently 3, target 5"))),
    })
    out = n.sanitised_resumes(docs)
    school = F.get("education", F.lit(0))
    return out.select("resume_id", "summary", F.size("skills").alias("n_groups"), F.array_join(F.flatten(F.transform("experience", lambda e: e["bullets"])), "/").alias("bullets"), school["degree"].alias("degree"), school["institution"].alias("institution"))


_FORMAT = c.COMPONENTS["formatting"]["live"].replace("has_dates", "(nb > 0)")


@query("parsed_resume_scores", f"""WITH d AS (SELECT resume_id, CAST({c.COMPONENTS["completeness"]["live"]} AS DOUBLE) AS comp, CAST({_FORMAT} AS DOUBLE) AS fmt, CAST({c.COMPONENTS["verbs"]["live_percent"]} AS DOUBLE) AS share, CAST({c.COMPONENTS["readability"]["live"]} AS DOUBLE) AS rdb FROM fx_features),
e AS (SELECT *, least(100, greatest(0, CAST({c.VERB_CURVE.format("share")} AS DOUBLE))) AS verbs FROM d)
SELECT resume_id, CAST(comp AS BIGINT) AS section_completeness, CAST(fmt AS BIGINT) AS formatting, CAST(verbs AS DECIMAL(10,2)) AS action_verbs, CAST(rdb AS BIGINT) AS readability, CAST(floor(comp * 0.2 + fmt * 0.2 + verbs * 0.1 + rdb * 0.1 + 0.5) AS BIGINT) AS total_score FROM e""", "fx_features")
def parsed_resume_scores(v):
    """Nested JSON documents in, the live composite out, by way of ``store.parsed_resumes`` and ``store.resume_lines``."""
    some = lambda count, make: F.transform(F.when(F.col(count) > 0, F.sequence(F.lit(1), F.col(count).cast("int"))).otherwise(F.array().cast("array<int>")), make)
    named = lambda prefix: (lambda i: F.concat(F.lit(prefix), i))
    job = F.struct(F.lit("C").alias("company"), F.lit("R").alias("role"), F.lit("2020").alias("startDate"), F.slice("lines", 2, 2**31 - 2).alias("bullets"))
    doc = F.struct(
        F.col("resume_id").alias("resumeId"), F.try_element_at("lines", F.lit(1)).alias("summary"),
        F.struct(F.when(F.col("has_email"), "a@b.co").alias("email"), F.when(F.col("has_phone"), "12345678").alias("phone")).alias("personalInfo"),
        some("n_skills", named("S")).alias("skills"), F.filter(F.array(job), lambda e: F.size(e["bullets"]) > 0).alias("experience"), some("n_projects", lambda i: F.struct(F.concat(F.lit("P"), i).alias("title"))).alias("projects"),
        some("n_education", lambda i: F.struct(F.lit("I").alias("institution"), F.lit("D").alias("degree"))).alias("education"), some("n_certifications", lambda i: F.struct(F.lit("N").alias("name"))).alias("certifications"),
        F.array_join(some("n_achievements", named("A")), "\n").alias("achievements"),
    )
    parsed = store.parsed_resumes(v.lines.select(F.to_json(doc).alias("value")))
    out = f.composite(f.resume_features(store.resume_lines(parsed), VERBS["strong"], VERBS["weak"]), F.lit(0.0))
    return out.select("resume_id", F.col("section_completeness").cast("long").alias("section_completeness"), F.col("formatting").cast("long").alias("formatting"), F.col("action_verbs").cast("decimal(10,2)").alias("action_verbs"), F.col("readability").cast("long").alias("readability"), "total_score")
