"""Literal inputs of résumé matching, and functions without a query of their own."""

import json

import pytest
from pyspark.sql import functions as F

from matchloom.functions import dates, dictionaries as w, text as t
from matchloom.operators import extraction, features, matching, rewriting as r, suggestions as s, validation as q
from matchloom.sources import store


def value(spark, column, **inputs):
    row = spark.createDataFrame([tuple(inputs.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in inputs.items()))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("a,b,want", [("kitten", "sitting", 4 / 7), ("", "", 1.0), ("Node.js", "nodejs", 1.0)])
def test_similarity(spark, a, b, want):
    assert value(spark, t.similarity(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(want)


def test_markup_is_stripped(spark):
    text = "<b>Built</b> API see https://x.test/a mail me@x.test on 01/02/2020 /usr/lib C:\\dir CI/CD node.js!"
    assert value(spark, t.strip_markup(F.col("x")), x=text) == "built api see mail on 01 ci node.js"


@pytest.mark.parametrize("score,want", [(150.0, 100), (-10.0, 0), (float("nan"), 0), (45.0, 45), (float("inf"), 100)])
def test_scores_are_clamped(spark, score, want):
    assert value(spark, t.clamped(F.col("x")), x=score) == want


@pytest.mark.parametrize("text,want", [("2020-03-05", "2020-03"), ("3/2020", "2020-03"), ("Sept 2019", "2019-09"), ("March 2021", "2021-03"), ("2018", "2018-01"), ("Present", ""), (None, "")])
def test_month_text(spark, text, want):
    assert (value(spark, dates.month_text(F.col("x")), x=text) or "") == want


def test_weak_openings(spark):
    one = lambda x: value(spark, r.replace_opening(F.col("x"), w.WEAK_OPENINGS, ("worked on", "involved in")), x=x)
    assert one("Worked on building the api") == "Developed The api"
    assert one("responsible for deployments") == "Engineered Deployments"
    assert one("Led a team") is None
    assert value(spark, r.replace_pattern(F.col("x"), w.WEAK_PATTERNS), x="Assisted with audits") == "Supported audits"
    assert value(spark, r.longest_opening(F.col("x"), (("helped", "Improved"), ("helped with", "Enhanced"))), x="helped with tests") == "Enhanced Tests"


def test_grammar(spark):
    issues = lambda x: value(spark, r.grammar_issues(F.col("x"), w.STRONG_VERBS), x=x)
    assert issues("Created developed new system") == "double_verb"
    assert issues("Integrated analyze large datasets") == "bad_combination"
    assert issues("to do it") == "too_short,preposition"
    assert issues("Developed a scalable service layer") == ""


def test_cleaning(spark):
    assert value(spark, r.sanitised(F.col("x")), x="Built it, resulting in 20% improvement") == "Built it."
    assert value(spark, r.cleaned_bullet(F.col("x")), x="built  the the api!!") == "Built the api!"
    assert value(spark, r.fix_punctuation(F.col("x")), x="a .,b ,c") == "a,b,c"
    assert value(spark, r.insert_keyword(F.col("x"), F.lit("SQL")), x="Reports using Excel.") == "Reports using SQL and Excel."
    assert value(spark, F.array_join(r.quoted_or_listed(F.col("x")), "|"), x='Add "React" and "Node.js"') == "React|Node.js"


def test_metric_tails(spark):
    tail = lambda x: value(spark, r.with_metric_tail(F.col("x"), w.METRIC_TAILS, w.METRIC_TAIL_ELSE), x=x)
    assert tail("Wrote a REST endpoint.").endswith("response time by 30%.")
    assert tail("Sold pens") == "Sold pens" + w.METRIC_TAIL_ELSE


def test_rolling_hash(spark):
    def plain(text):
        h = 0
        for c in text:
            h = (h * 31 + ord(c)) % 2**32
        return abs(h - 2**32 if h >= 2**31 else h)

    for x in ("", "a", "hello world", "polygenelubricants"):
        assert value(spark, t.rolling_hash(F.col("x")), x=x) == plain(x)
    assert value(spark, t.base36(F.lit(35 * 36 + 10)), x="") == "za"


def test_resumes_from_json(spark):
    doc = {
        "resumeId": 1,
        "skills": "Go, SQL , ",
        "experience": [{"company": "A", "role": "Dev", "startDate": "2020", "bullets": ["x", "y"]}, {"company": " ", "role": "Dev", "startDate": "2020"}],
        "projects": [{"name": "P", "bullets": ["z"]}, {}],
        "education": [{"school": "S", "degree": "BSc"}, {"school": "S"}],
        "certifications": [{"name": "C"}, {"issuer": "I"}],
        "achievements": "- one\n• two\n\n- one",
    }
    other = {"resumeId": 2, "skills": '[{"category":"Web","items":["React"]},{"category":"None","items":[]}]', "achievements": '[{"title":"T","description":"D"}]'}
    rows = store.parsed_resumes(spark.createDataFrame([(json.dumps(doc),), (json.dumps(other),), ("no json",)], "value string")).collect()
    first, second, third = sorted(rows, key=lambda x: x.resumeId or 99)
    assert first.resumeTitle == "Untitled Resume" and first.fullName == "Your Name" and first.templateId == "classic"
    assert [(g.category, list(g["items"])) for g in first.skills] == [("General", ["Go", "SQL"])]
    assert [len(x) for x in (first.experience, first.projects, first.education, first.certifications)] == [1, 1, 1, 1]
    assert first.achievements == ["one", "two"] and second.achievements == ["T: D"]
    assert [(g.category, list(g["items"])) for g in second.skills] == [("Web", ["React"])]
    assert third.resumeId is None and third.skills == []
    frame = store.parsed_resumes(spark.createDataFrame([(json.dumps(doc),)], "value string"))
    assert [(b.section, b.item_index, b.bullet_index, b.text) for b in store.bullets_of(frame).collect()] == [("experience", 0, 0, "x"), ("experience", 0, 1, "y"), ("projects", 0, 0, "z")]


def test_reports_are_appended(spark, tmp_path):
    rows = spark.sql("SELECT 1L AS report_id, TIMESTAMP '2024-01-02 03:04:05' AS created_at")
    for _ in range(2):
        store.append_reports(rows, str(tmp_path / "reports"))
    assert spark.read.parquet(str(tmp_path / "reports")).where("created_date = DATE '2024-01-02'").count() == 2
    assert store.written(rows, "t").collect() == rows.collect()


def test_blocked_similarity_join_equals_brute_force(spark):
    left = ["javascript", "postgresql", "kubernetes", "react", "tensorflow", "microservices", "abcdefgh"]
    right = ["javascrip", "javascripts", "postgresq1", "kubernets", "kubernetes", "reacts", "react", "tensorflows", "micro-services", "bcdefgh", "abcdefg", "xabcdefgh", "abcdxefgh"]
    a, b = (spark.createDataFrame([(x,) for x in xs], "term string") for xs in (left, right))
    both = a.select(F.col("term").alias("l")).crossJoin(b.select(F.col("term").alias("r")))
    longest = F.greatest(F.length("l"), F.length("r"))
    want = {(x.l, x.r) for x in both.where((longest - F.levenshtein("l", "r")) / longest > 0.85).collect()}
    assert {(x.left, x.right) for x in matching.similar_terms(a, b).collect()} == want


def test_sections(spark):
    lines = ["Intro", "Responsibilities:", "- Build", "text", "- Test", "", "- not here", "Responsibilities", "1. Run"]
    rows = spark.createDataFrame([(1, k, x) for k, x in enumerate(lines)], "id long, pos long, text string")
    got = extraction.section_items(rows, "id", "(?i)responsibilit", "^(-|\\d+\\.)", "^\\s*$", 10)
    assert [x.text for x in got.orderBy("place").collect()] == ["- Build", "- Test", "1. Run"]


def test_component_scores_stay_in_range(spark, sf_dir):
    from matchloom.sources.fixtures import VERBS, Views

    rows = features.resume_features(Views(spark, sf_dir).lines, VERBS["strong"], VERBS["weak"])
    for family, profiles in features.PROFILES.items():
        got = features.scores(rows, family).agg(*[F.min(p).alias(f"a{k}") for k, p in enumerate(profiles)], *[F.max(p).alias(f"b{k}") for k, p in enumerate(profiles)]).first()
        assert all(x <= 100 for x in got) and all(x >= -200 for x in got), family


def test_composite_weights(spark):
    from matchloom.sources.fixtures import VERBS

    lines = spark.createDataFrame([(2310, ["A summary of more than ten characters.", "Built a thing that works for everyone."])], "resume_id long, lines array<string>")
    row = features.composite(features.resume_features(lines, w.STRONG_VERBS, VERBS["weak"]), F.lit(100.0)).first()
    want = 0.4 * row.keyword_match + 0.2 * row.section_completeness + 0.2 * row.formatting + 0.1 * row.action_verbs + 0.1 * row.readability
    assert row.total_score == int(want + 0.5)


def test_matched_and_missing_split_the_keywords(spark, sf_dir):
    from matchloom.plans import registry

    rows = registry.QUERIES["keyword_matches"](spark, sf_dir)
    scores = matching.match_scores(rows).collect()
    assert all(x.n_matched + (len(x.missing.split(",")) if x.missing else 0) == x.n_keywords and 0 <= x.percent <= 100 for x in scores)


def test_suggestions_are_bounded_and_idempotent(spark, sf_dir):
    from matchloom.plans.suggestions import _suggested
    from matchloom.sources.fixtures import Views

    v = Views(spark, sf_dir)
    rows = _suggested(v).cache()
    assert rows.groupBy("resume_id").count().agg(F.max("count")).first()[0] <= 6
    assert rows.where("pos IS NOT NULL").groupBy("resume_id", "pos").count().where("count > 1").count() == 0
    once = s.applied(v.bullets.select("resume_id", "pos", "text"), rows).cache()
    assert once.where("changed").count() == rows.where("pos IS NOT NULL").count()
    twice = s.applied(once.drop("changed"), rows)
    assert twice.where("changed").count() == 0
    skills = spark.createDataFrame([(1, "SQL")], "resume_id long, skill string")
    new = spark.createDataFrame([(1, "keyword", "sql"), (1, "keyword", "Go")], "resume_id long, type string, improved_text string")
    assert {x.skill for x in s.skills_applied(skills, new).collect()} == {"SQL", "Go"}


def test_violations_split_all_rows(spark):
    rows = spark.createDataFrame([(1, "a@b.co", 5), (2, "bad", None), (3, None, 500)], "id long, email string, n int")
    rules = {"email": q.not_like("email", q.EMAIL), "n": q.outside("n", 0, 100)}
    clean, bad = q.split(rows, rules)
    assert [x.id for x in clean.collect()] == [1]
    assert {x.id: x.violations for x in bad.collect()} == {2: "email", 3: "email,n"}
