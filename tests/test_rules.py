"""Rules held against values worked out by hand, on résumés of the nested form and on single texts."""

import json

from pyspark.sql import functions as F

from matchloom.operators import features as f, matching as m, records as r, wording as w
from matchloom.sources import store

STRONG, WEAK = ["built", "led"], ["helped", "worked"]


def scored(spark, doc):
    rows = store.resume_lines(store.parsed_resumes(spark.createDataFrame([(json.dumps(doc),)], "value string")))
    features = f.resume_features(rows, STRONG, WEAK)
    return {family: f.scores(features, family).first().asDict() for family in f.PROFILES}


def test_scores_of_a_parsed_resume(spark):
    doc = {
        "resumeId": 1, "summary": "Engineer with ten years of work on large systems and teams.", "skills": "Go, SQL, Java",
        "personalInfo": {"fullName": "A B", "email": "a@b.cd"},
        "experience": [{"company": "C", "role": "R", "startDate": "2020", "bullets": ["Built 3 services that cut costs by 40%", "Helped the team with tests and reviews"]}],
        "education": [{"school": "S", "degree": "D"}],
    }
    got = scored(spark, doc)
    # summary, skills, experience and education are there: four of seven
    assert (got["completeness"]["live"], got["completeness"]["deep"], got["completeness"]["required_five"]) == (60, 70, 80)
    assert got["completeness"]["weighted"] == 15 + 20 + 25 + 15
    # structure 20, bullets 25, dates 15, few abbreviations 20, all bullets of good length 20
    assert got["formatting"]["live"] == 100
    assert got["formatting"]["contact"] == 100 - 6  # no phone
    assert (got["verbs"]["first_word"], got["verbs"]["bonus"], got["verbs"]["weak_count"]) == (50, 60, 1)
    assert got["verbs"]["with_metrics"] == 45  # (40 + 50) / 2


def test_scores_without_anything(spark):
    got = scored(spark, {"resumeId": 2})
    assert got["completeness"]["live"] == got["completeness"]["deep"] == got["completeness"]["with_depth"] == 0
    assert got["formatting"]["live"] == 40  # structure and few abbreviations
    assert (got["verbs"]["first_word"], got["verbs"]["anywhere"], got["readability"]["live"]) == (50, 100, 50)


def test_repeated_words(spark):
    rows = spark.createDataFrame([(["a", "a", "b", "b", "b", "c"],), ([],), (["x"],)], "w array<string>")
    assert [x[0] for x in rows.select(f.more_often(F.col("w"), 1)).collect()] == [2, 0, 0]
    assert [x[0] for x in rows.select(f.more_often(F.col("w"), 2)).collect()] == [1, 0, 0]


def test_keywords_are_placed_by_the_first_way_that_suits(spark):
    rows = [
        ("Analyzed data using Python to find patterns", "Tableau", "Analyzed data using Python and built Tableau dashboards to visualize insights and support data-driven decision making.", "high"),
        ("Built pages with React", "Redux", "Built pages with React and Redux", "high"),
        ("Developed reporting system for sales", "Kafka", "Developed reporting Kafka-powered system for sales", "medium"),
        ("Built a team culture", "agile", "Built using agile methodology a team culture", "medium"),
        ("Won a prize", "Go", "Won a prize leveraging Go", "low"),
        ("Won a prize", "patience", "Won a prize", "low"),
        ("Wrote Go code", "go", "Wrote Go code", "high"),
    ]
    docs = spark.createDataFrame([x[:2] for x in rows], "text string, keyword string")
    got = docs.select(w.integrated(F.col("text"), F.col("keyword"), ["built"], contexts=(("analyz|data", "data-analysis"), ("develop", "development"))).alias("x")).select("x.*").collect()
    assert [(g.improved, g.confidence) for g in got] == [x[2:] for x in rows]


def test_drifting_breakdowns(spark):
    rows = ['{"keywordMatch":{"score":5}}', '{"keywordMatch":6}', '{"keywordMatch":0,"keywordMatchScore":{"score":7}}', "{}", "no json"]
    docs = spark.createDataFrame([(x,) for x in rows], "record string")
    assert [x[0] for x in docs.select(r.drifting_score(F.col("record"), "keywordMatch", "keywordMatchScore")).collect()] == [5, 6, 7, 0, 0]


def test_similar_terms_against_all_pairs(spark):
    """Misspellings, insertions and cuts of long words, short words, and unlike words."""
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    words = ["development", "developmemt", "xdevelopment", "developmen", "develpoment", "java", "javas", "internationalisation", "internationalization", "intrnationalisation", "a" * 30, "a" * 28 + "bb", "kubernetes", "kuberetes"]
    terms = spark.createDataFrame([(x,) for x in words], "term string")
    want = {(a, b) for a in words for b in words if (max(len(a), len(b)) - distance(a, b)) / max(len(a), len(b)) > 0.85}
    assert {(x.left, x.right) for x in m.similar_terms(terms, terms).collect()} == want
