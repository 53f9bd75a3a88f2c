"""The live suggestion list by path, against lists worked out by hand."""

from pyspark.sql import functions as F

from matchloom.operators import suggestion_lists as s

OPENINGS = (("responsible for", "Engineered"), ("worked on", "Developed"), ("helped", "Facilitated"))
TAILS = (("api|server", ", faster."),)
STATE = "resume_id long, bullets array<string>, missing array<struct<rnk:int,keyword:string,weight:int>>, summary string, k int, a int, c int, f int, fresher boolean, n_projects int, n_education int, n_certifications int"
LONG = "Ten years of work on large systems, with teams in three countries and a budget to answer for, every year."
WORDS = [(1, "go", 1), (2, "sql", 1), (3, "java", 1)]


def lists(spark, *rows):
    df = spark.createDataFrame([(k, *row) for k, row in enumerate(rows)], STATE)
    judged = s.judged(F.col("bullets"), OPENINGS, ["built", "led", "developed"], "[0-9]+%|[0-9]{2,}", TAILS, ", better.", (), gerund_after=("worked on",))
    out = s.exploded(s.live(df.withColumn("b", judged), TAILS, ", better.", ("contributed to",)))
    found = {k: [] for k in range(len(rows))}
    for r in out.orderBy("resume_id", "rank").collect():
        found[r.resume_id].append((r.type, r.pos, r.improved))
    return [found[k] for k in range(len(rows))]


def test_experience(spark):
    bullets = ["Worked on building the API.", "Helped the team", "responsible for it", "helped more", "Built a server."]
    full, calm, falls = lists(
        spark,
        (bullets, WORDS, "", 50, 50, 0, 50, False, 0, 0, 0),
        (bullets, WORDS, LONG, 70, 80, 0, 70, False, 0, 0, 0),
        ([], [], LONG, 90, 90, 0, 60, False, 0, 0, 0),
    )
    verbs = [("action_verb", 1, "Developed The API."), ("action_verb", 2, "Facilitated The team"), ("action_verb", 3, "Engineered It")]
    # two keywords, three verbs and a result for the first bullet that no verb has taken make six
    assert full == [("keyword", None, "go"), ("keyword", None, "sql"), *verbs, ("experience", 4, "helped more, better.")]
    # nothing is low: a result for the first bullet, and as the list is of one, what lacks
    assert calm == [("experience", 1, "Worked on building the API, faster."), ("projects", None, "Add a project."), ("certifications", None, "Add a certificate.")]
    assert falls == [("formatting", None, "Name your degree."), ("projects", None, "Add a project."), ("certifications", None, "Add a certificate.")]


def test_freshers(spark):
    short = "A student."
    strong, weak, other, none, null = lists(
        spark,
        (["Helped", "Wrote a parser of logs", "Built a server."], WORDS, short, 60, 0, 0, 60, True, 2, 0, 0),
        (["Built 40% of the thing", "Contributed to the API"], [], LONG, 90, 0, 0, 60, True, 2, 1, 0),
        (["worked on coding the server"], [], LONG, 90, 0, 0, 60, True, 1, 0, 0),
        (["Built a server."], [], LONG, 90, 0, 0, 90, True, 0, 0, 0),
        (None, None, None, None, None, None, None, None, None, None, None),
    )
    assert strong == [("keyword", None, "go"), ("keyword", None, "sql"), ("projects", 3, "Built a server, faster."), ("summary", None, "Say what you study and what you want to build."), ("formatting", None, "Write a summary of 50 words.")]
    assert weak == [("projects", 2, "Contributed to the API, faster.")]
    assert other == [("projects", 1, "Developed The server, faster."), ("formatting", None, "Name your degree.")]
    assert none == [] and null == []
