import hashlib
import random
import zlib

import duckdb
import numpy as np

from matchloom.llm import oracles, periodic_runs, queries
from matchloom.llm._common import documents

from ._fixtures import SCHEMA, odd_rows


def brute_runs(w):
    """Every period is tried at every word; the smallest period of a stretch stays."""
    found = {}
    for p in range(1, len(w) // 4 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(6, 4 * p) and j > i:
                found.setdefault((i, j + p - i), p)
            i = j + 1
    return sorted((start, length, p) for (start, length), p in found.items())


def collapsed(w, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def some_words(rng):
    if rng.random() < 0.4:
        return [rng.choice("abc") for _ in range(rng.randrange(70))]
    out = []
    for _ in range(rng.randrange(1, 5)):
        unit = [rng.choice("abcd") for _ in range(rng.randrange(1, 9))]
        out += (unit * rng.randrange(1, 9))[: rng.randrange(1, 60)]
    return out


def test_names_against_brute_force():
    rng = random.Random(5)
    for _ in range(3000):
        texts = [some_words(rng) for _ in range(rng.randrange(1, 5))]
        names, ends, want = [], [], []
        for t in texts:
            want += [(len(names) + s, n, p) for s, n, p in brute_runs(t)]
            names += [ord(x) for x in t] + [1000 + len(ends)]
            ends.append(len(names))
        start, length, period = periodic_runs.runs_of(np.array(names), max(map(len, texts)))
        assert list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True)) == want


def check(docs):
    rows = [(r.doc_id, (r.text or "").encode().split()) for r in docs.select("doc_id", "text").collect()]
    want = []
    for i, w in rows:
        runs = brute_runs(w) if len(w) < 2000 else None
        want.append((str(i), len(w), runs, collapsed([x.decode() for x in w], runs) if runs is not None else None))
    got = [(str(r.doc_id), r.n_words, [(x.start, x.length, x.period) for x in r.runs], r.collapsed_text) for r in periodic_runs.periodic_runs(docs).collect()]
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=str), sorted(want, key=str), strict=True):
        assert g[:2] == w[:2] and (w[2] is None or g == w)


def test_operator_against_brute_force(spark):
    rng = random.Random(6)
    check(spark.createDataFrame([(k, "\t ".join(some_words(rng))) for k in range(300)] + [(7, "a " * 40), (7, "a " * 40)], "doc_id long, text string"))
    check(spark.createDataFrame(odd_rows(), SCHEMA))
    assert periodic_runs.periodic_runs(documents(spark, "/root/testdata/sf0.001").limit(0)).count() == 0


def test_long_text(spark):
    text = "x y z " * 100_000 + "end"
    (row,) = periodic_runs.periodic_runs(spark.createDataFrame([("a", text)], "doc_id string, text string")).collect()
    assert [tuple(r) for r in row.runs] == [(0, 300_000, 3)] and row.collapsed_text == "x y z end" and row.n_words == 300_001


def planted(i, w):
    h = zlib.crc32(str(i).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return w[:a] + [w[a + (k - a) % p] for k in range(a, n)]


def test_query_against_brute_force_and_sql(spark, sf_dir):
    got = sorted(tuple(r) for r in queries.op11_periodic_runs(spark, sf_dir).collect())
    want = []
    for r in documents(spark, sf_dir).collect():
        w = planted(r.doc_id, (r.text or "").encode().split())
        runs = brute_runs(w)
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None, None, None))
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        text = collapsed([x.decode() for x in w], runs)
        want.append((r.doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    names = "doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256"
    assert sorted(con.sql(f"SELECT {names} FROM ({oracles.OP11})").fetchall()) == want
