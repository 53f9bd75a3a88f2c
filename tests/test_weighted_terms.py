"""Keywords by the weighted dictionary, against scores worked out by hand."""

from matchloom.functions import dictionaries as d
from matchloom.operators.weighted_terms import weighted_terms


def found(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "jd_id long, t string")
    rows = weighted_terms(df, "jd_id", "t", d.weighted_terms(), d.RESPONSIBILITY_VERBS, d.NO_KEYWORDS, d.REQUIRED_CUES, d.PREFERRED_CUES).orderBy("jd_id", "rank").collect()
    out = [[] for _ in texts]
    for r in rows:
        out[r.jd_id].append((r.keyword, r.score, r.frequency, r.role))
    return out


def test_longest_first_and_cues(spark):
    long, cues, slash, none, null = found(
        spark,
        "Spring Boot and microservices architecture. We build spring services; build REST APIs in Node.js",
        "Required: Docker. " + "x" * 900 + " Preferred: Kafka, docker",
        "Go / Java / Python, CI/CD",
        "",
        None,
    )
    # spring and boot stand twice, but the longer term hides the shorter one; node stands inside node.js
    assert long == [("microservices architecture", 5.0, 1, "backend"), ("spring boot", 4.0, 1, "backend"), ("node.js", 4.0, 1, "backend"), ("build", 4.0, 2, "responsibility"), ("rest", 3.0, 1, "backend")]
    assert cues == [("docker", 3 * 2 * (1.5 * 0.8), 2, "devops"), ("kafka", 3 * 0.8, 1, "backend")]
    # between slashes: "go" is in go, django, golang, mongo, mongodb, algorithms, google cloud; "java" in java, javascript;
    # and each once more as a term of its own; "python ci" holds python alone; "cd" is in ci/cd and cicd
    slashed = dict((k, (s, n)) for k, s, n, _ in slash)
    assert slashed["go"] == (3.0 * 8, 8) and slashed["java"] == (3.0 * 3, 3)
    assert slashed["python ci"] == (1.0, 1) and slashed["cd"] == (2.0, 2) and slashed["ci/cd"] == (4.0, 1)
    assert "python" not in slashed and none == [] and null == []
