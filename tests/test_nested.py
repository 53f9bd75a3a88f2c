"""Edits and cleaning of nested résumés, and keywords of several words, against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from matchloom.operators import nested, phrase_match

DOC = "resume_id long, summary string, skills array<struct<category:string,items:array<string>>>, experience array<struct<company:string,bullets:array<string>>>, projects array<struct<title:string,bullets:array<string>>>, education array<struct<institution:string,degree:string,description:string>>, certifications array<struct<name:string,issuer:string>>, achievements array<string>"
EDIT = "resume_id long, seq int, section string, item_index int, bullet_index int, current_text string, improved_text string"


def docs(spark):
    full = (1, "Old", [("Web", ["React"]), ("Data", None)], [("A", ["built x", "ran y"]), ("B", None)], [("P", ["made z"])], [("S", "BSc", None)], [("AWS", "X")], ["one"])
    return spark.createDataFrame([full, (2, None, None, None, None, None, None, None)], DOC)


def edits(spark):
    rows = [
        (0, "experience", 0, 1, "ran y", "Led y"), (1, "experience", 0, 1, "ran y", "again"), (2, "experience", 1, 0, None, "New"), (3, "experience", 1, None, None, "New."), (4, "experience", 5, 0, None, "x"),
        (5, "skills", None, None, None, "SQL"), (6, "skills", None, None, None, "sql"), (7, "summary", None, None, None, "Now"), (8, "projects", 0, 0, "gone", "y"), (9, "education", 0, None, None, "Thesis"),
        (10, "certifications", 0, None, None, "GCP"), (11, "certifications", None, None, None, "K8s"), (12, "certifications", None, None, None, "K8s"), (13, "skills", None, None, None, None), (14, None, 0, 0, None, "x"),
    ]
    return spark.createDataFrame([(k, *r) for k in (1, 2) for r in rows], EDIT)


def test_edits_in_order(spark):
    first, second = nested.with_edits(docs(spark), edits(spark)).orderBy("resume_id").collect()
    assert first.edit_log == ["applied", "stale", "applied", "exists", "invalid", "applied", "exists", "applied", "stale", "applied", "applied", "applied", "exists", "invalid", "invalid"]
    assert first.summary == "Now" and first.achievements == ["one"]
    assert [list(j.bullets) for j in first.experience] == [["built x", "Led y."], ["New."]] and list(first.projects[0].bullets) == ["made z"]
    assert [tuple(g) for g in first.skills] == [("Web", ["React", "SQL"]), ("Data", None)]
    assert first.education[0].description == "Thesis" and [tuple(c) for c in first.certifications] == [("GCP", "X"), ("K8s", "")]
    assert second.summary == "Now" and [tuple(g) for g in second.skills] == [("Technical Skills", ["SQL"])] and [c.name for c in second.certifications] == ["GCP", "K8s"]
    assert second.experience == [] and second.achievements is None


def test_edits_twice_are_once(spark):
    once = nested.with_edits(docs(spark), edits(spark)).drop("edit_log")
    twice = nested.with_edits(once, edits(spark)).drop("edit_log")
    rows = lambda d: d.orderBy("resume_id").collect()
    assert [r.experience for r in rows(once)] == [r.experience for r in rows(twice)]
    assert [(r.summary, r.skills, r.projects, r.education) for r in rows(once)] == [(r.summary, r.skills, r.projects, r.education) for r in rows(twice)]
    none = nested.with_edits(docs(spark), edits(spark).limit(0)).where("resume_id = 1").first()
    assert none.summary == "Old" and none.edit_log == []


@pytest.mark.parametrize("text,want", [("  Built x ", "Built x"), ("Consider adding Go", ""), ("add 3 bullets", ""), ("Add impact of 40%", "Add impact of 40%"), ("This suggestion", ""), ("Grew to target 50", ""), ("served 5k", "served 5k"), ("", ""), (None, None)])
def test_advice_goes(spark, text, want):
    assert spark.createDataFrame([(text,)], "x string").select(nested.without_advice(F.col("x")).alias("y")).first().y == want


def test_whole_documents_are_cleaned(spark):
    row = (1, " consider adding more ", [("A", ["consider adding Go"]), ("B", ["Go ", None, "add SQL"]), None], [("add ", ["Built", "requires manual work"])], None, [("S ", "target 5", "add this")], [("AWS ", None)], ["x", "add measurable"])
    got = nested.sanitised_resumes(spark.createDataFrame([row], DOC)).first()
    assert got.summary == "" and [tuple(g) for g in got.skills] == [("B", ["Go"])]
    assert [tuple(e) for e in got.experience] == [("add ", ["Built"])] and got.projects is None
    assert tuple(got.education[0]) == ("S", "", "add this") and tuple(got.certifications[0]) == ("AWS", None) and got.achievements == ["x"]


def test_phrase_methods(spark):
    texts = [(1, 1, "Led database optimisation and a REST  API in nodejs"), (2, 1, "performance optimizations of databases; kubernets"), (3, 1, "")]
    keywords = [(1, x) for x in ("rest api", "javascript", "node.js", "database optimization", "performance optimization", "kubernetes", "data")]
    synonyms = spark.createDataFrame([("node", "nodejs"), ("node", "node.js")], "grp string, form string")
    got = phrase_match.phrase_matches(spark.createDataFrame(texts, "resume_id long, jd_id long, text string"), spark.createDataFrame(keywords, "jd_id long, keyword string"), synonyms)
    found = {(r.resume_id, r.keyword): (r.method, r.found_as) for r in got.collect()}
    assert len(found) == 21
    assert found[1, "rest api"] == ("exact", "rest api") and found[1, "node.js"] == ("synonym", "nodejs")
    assert found[1, "database optimization"] == ("word_match", "database optimization") and found[1, "data"] == ("exact", "data")
    assert found[2, "performance optimization"] == ("exact", "performance optimization") and found[2, "kubernetes"] == ("fuzzy", "kubernets")
    assert found[2, "javascript"] == ("none", None) and all(found[3, k][0] == "none" for _, k in keywords)
