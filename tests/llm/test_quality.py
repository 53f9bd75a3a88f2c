import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from matchloom.llm import kneser_ney, quality_rules
from matchloom.llm._common import documents

from ._fixtures import SCHEMA, odd_rows, prose

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def brute_stats(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))


def check(docs, labels):
    got = quality_rules.quality_rules(docs, labels)
    rows = got.collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        own = brute_stats(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == own
        assert r.base_failed == (own[0] < 20 or 100 * own[4] > 30 * own[0])
        assert r.kept == (not r.base_failed and r.rule == 0)
    return {r.doc_id: r for r in rows}


def test_statistics_and_verdicts(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = documents(spark, sf), documents(spark, sf, "labels")
    rows = check(docs, labels)
    known = [r for r in labels.collect() if r.doc_id in rows]
    right = sum(rows[r.doc_id].kept == (r.quality == 1) for r in known if not rows[r.doc_id].base_failed)
    assert right >= 0.97 * sum(not rows[r.doc_id].base_failed for r in known)


def test_odd_rows_and_no_labels(spark):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = check(docs, none)
    assert all(r.kept != r.base_failed for r in rows.values())
    assert quality_rules.quality_rules(docs.limit(0), none).count() == 0


def test_learned_list_matches_its_mask(spark):
    rng = np.random.default_rng(1)
    n = 600
    frame = {c.split()[0]: rng.integers(1, 50, n) for c in quality_rules.STATS.split(", ")}
    rows = spark.createDataFrame([tuple(int(v[k]) for v in frame.values()) for k in range(n)], quality_rules.STATS)
    x = rows.select(*[F.expr(e).alias(k) for k, e in quality_rules.FEATURES.items()]).toPandas()
    x = {k: x[k].to_numpy() for k in quality_rules.FEATURES}
    bad = (x["symbol_share"] > 1.5) | ((x["dup_line_share"] > 0.8) & (x["mean_word"] <= 1))
    rules = quality_rules.learn(x, bad, least_cover=3)
    assert rules
    got = quality_rules.apply_rules(rows, rules).select("rule").toPandas()["rule"].to_numpy()
    want, left = np.zeros(n, int), np.ones(n, bool)
    for k, r in enumerate(rules, 1):
        hit = r.mask(x, n) & left
        want[hit] = k
        left &= ~hit
    assert (got == want).all()
    assert (bad == (want > 0)).mean() > 0.97


def brute_kneser_ney(texts, order):
    """Probability function of the plain recursive definition."""
    pad = (kneser_ney.EDGE,) * (order - 1)
    signs = lambda t: tuple(b + 1 for b in t)
    texts = [signs(t) for t in texts]
    counts = {order: Counter((pad + t)[i : i + order] for t in texts for i in range(len(t)))}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    cut = {}
    for n, c in counts.items():
        k = Counter(c.values())
        n1, n2, n3, n4 = k[1], k[2], k[3], k[4]
        y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
        step = lambda i, a, b, y=y: min(float(i), max(0.05, i - (i + 1) * y * b / a)) if a else 0.5 * i
        cut[n] = (step(1, n1, n2), step(2, n2, n3), step(3, n3, n4))

    def prob(gram):
        n = len(gram)
        if not n:
            return 1 / kneser_ney.VOCABULARY
        own = {g: c for g, c in counts[n].items() if g[:-1] == gram[:-1]}
        if not own:
            return prob(gram[1:])
        take = lambda c: cut[n][min(c, 3) - 1]
        total = sum(own.values())
        c = own.get(gram, 0)
        return (c - take(c) if c else 0) / total + sum(map(take, own.values())) / total * prob(gram[1:])

    return lambda t: sum(math.log10(prob((pad + signs(t))[i : i + order])) for i in range(len(t)))


def test_kneser_ney_against_brute_force(spark):
    texts = ["the cat sat on the mat", "the dog ate the cat", "été à la mer", "a a a a b", "\x00the\x00\x00 end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = kneser_ney.fit(docs, order=3)
    table = kneser_ney.Table(pa.ipc.open_stream(model[0]).read_all(), model[1])
    want = brute_kneser_ney([t.encode() for t in texts], 3)
    for t in [*texts, "the mat", "zzz qq", "é", "\x00\x00the", "a\x00"]:
        assert math.isclose(table.log10(t.encode()), want(t.encode()), rel_tol=1e-4)


def test_model_sums_to_one(spark):
    docs = spark.createDataFrame([(1, "abracadabra abracadabra banana")], "doc_id long, text string")
    model = kneser_ney.fit(docs, order=3)
    table = kneser_ney.Table(pa.ipc.open_stream(model[0]).read_all(), model[1])
    for before in (b"ab", b"zz", b"an"):
        assert math.isclose(sum(10 ** (table.log10(before + bytes([b])) - table.log10(before)) for b in range(256)), 1, rel_tol=1e-4)


def test_classifier_keeps_trusted_and_finds_junk(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in kneser_ney.classify(documents(spark, sf), documents(spark, sf, "labels")).collect()}
    labels = documents(spark, sf, "labels").collect()
    good = [r for r in labels if r.quality == 1 and not r.toxic]
    assert sum(rows[r.doc_id].kept for r in good) >= 0.98 * len(good)


def test_thresholds_come_from_outside_the_sample(spark, monkeypatch):
    """Trusted documents that train the model do not move the thresholds."""
    docs = spark.createDataFrame([(k, prose(k, 80), "en") for k in range(60)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(50)], "doc_id long, quality int, toxic int")
    rows = kneser_ney.classify(docs, labels, max_trusted=25).collect()
    limit = kneser_ney.hash_limit(0.5)
    inside = {r.doc_id for r in docs.where(kneser_ney.drawn("kn", F.col("doc_id"), F.lit(limit))).collect()}
    held = sorted(r.entropy for r in rows if r.trusted and r.doc_id not in inside)
    assert 5 < len(held) < 45 and math.isclose(rows[0].threshold, kneser_ney.MARGIN * held[-1])


def test_every_trusted_document_is_used(spark, monkeypatch):
    """However many there are: four in five teach, all others tell the thresholds."""
    docs = spark.range(20_000).selectExpr("id as doc_id", "concat('text ', id) as text", "'en' as lang")
    labels = docs.selectExpr("doc_id", "1 as quality", "0 as toxic")
    taught, fit_parts = [], kneser_ney.fit_parts
    monkeypatch.setattr(kneser_ney, "fit_parts", lambda rows, *a: taught.append({r.doc_id for r in rows.collect()}) or fit_parts(rows, *a))
    rows = kneser_ney.classify(docs, labels).collect()
    held = sorted(r.entropy for r in rows if r.doc_id not in taught[0])
    assert 15_500 < len(taught[0]) < 16_500 and len(held) == 20_000 - len(taught[0])
    assert math.isclose(rows[0].threshold, kneser_ney.MARGIN * held[math.ceil(kneser_ney.QUANTILE * len(held)) - 1])


def test_counts_of_n_grams_are_added_up(monkeypatch):
    texts = [None, "", *(prose(k, 20) for k in range(30))]
    batches = [pa.record_batch({"text": pa.array(texts[at : at + 7])}) for at in range(0, len(texts), 7)]
    want = Counter(g for t in texts if t for g in kneser_ney.packed(t.encode(), 5)[4].tolist())
    for at_once, held in ((2_000_000, 2_000_000), (100, 2_000_000), (100, 50)):
        monkeypatch.setattr(kneser_ney, "COUNTED_AT_ONCE", at_once)
        monkeypatch.setattr(kneser_ney, "HELD_GRAMS", held)
        got = Counter()
        for batch in kneser_ney._grams(5)(iter(batches)):
            for gram, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                got[gram] += c
        assert got == want


def test_classifier_odd_rows(spark):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in kneser_ney.classify(docs, none).collect()}
    assert len(rows) == docs.count() and not rows[0].kept and rows[0].perplexity is None and rows[3].kept
    some = spark.createDataFrame([(3, 1, 0), (5, 1, None), (9, 0, 0)], "doc_id long, quality int, toxic int")
    assert kneser_ney.classify(docs, some).where("trusted").count() == 2
    assert kneser_ney.classify(docs.limit(0), some).count() == 0


def test_large_model_keeps_its_order(spark, monkeypatch):
    """A model over MODEL_ROWS goes in parts and gives the same scores as the whole table of 5-grams."""
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    whole, order = kneser_ney.fit(docs)
    table = kneser_ney.Table(pa.ipc.open_stream(whole).read_all(), order)
    monkeypatch.setattr(kneser_ney, "MODEL_ROWS", 1000)
    parts, order = kneser_ney.fit_parts(docs)
    assert order == kneser_ney.ORDER == 5 and len(parts) > 3
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    rows = kneser_ney.log_probabilities(docs, (parts, order)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.n_bytes == len(texts[r.doc_id]) and math.isclose(r.log10_prob, table.log10(texts[r.doc_id]), rel_tol=1e-9, abs_tol=1e-9)


def test_rules_with_text_ids_and_repeats(spark):
    """Ids of any type; the rules are the same whatever the order of the rows."""
    rows = [(f"doc-{k % 300}", prose(k, 25 + k % 90) + (" ###" * 5 if k % 3 == 0 else "")) for k in range(600)]
    labels = spark.createDataFrame([(f"doc-{k}", int(k % 3 != 0)) for k in range(300)], "doc_id string, quality int")
    found = []
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id string, text string")
        stats = quality_rules.text_statistics(docs).repartition(3)
        found.append(quality_rules.fit_rules(stats, labels))
        assert quality_rules.quality_rules(docs, labels).count() == 600
    assert found[0] == found[1] and found[0]
