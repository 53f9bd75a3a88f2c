import zlib

import numpy as np
from pyspark.sql import functions as F

from matchloom.llm import language_id
from matchloom.llm._common import documents, drawn, hash_limit
from matchloom.llm.queries import vocabulary

from ._fixtures import SCHEMA, odd_rows

PATH = vocabulary("piece_bpe_32k.model")


def brute_probability(word, ids, probs):
    """Sum over all segmentations, by recursion."""
    if not word:
        return 1.0
    total = 0.0
    for k in range(1, len(word) + 1):
        if word[:k] in ids:
            total += probs[ids[word[:k]]] * brute_probability(word[k:], ids, probs)
        elif k == 1:
            total += language_id.UNKNOWN * brute_probability(word[k:], ids, probs)
    return total


def test_forward_against_all_segmentations():
    vocabulary_ = language_id.Vocabulary(PATH)
    rng = np.random.default_rng(0)
    probs = rng.dirichlet(np.ones(vocabulary_.size) * 0.1, 2).T + 1e-9
    words = ["the", "nation", "élève", "x", "日本", "über", "thing"]
    got = language_id.word_scores(words, vocabulary_, probs)
    for k, w in enumerate(words):
        for g in range(2):
            assert np.isclose(got[k, g], np.log(brute_probability("▁" + w, vocabulary_.ids, probs[:, g])))
    short = language_id.word_scores(["antidisestablishment" * 2 + "a"], vocabulary_, probs)
    assert np.allclose(short[0], language_id._long_word("▁" + "antidisestablishment" * 2 + "a", vocabulary_, probs))


def test_expectations_add_up():
    """The expected pieces of a word cover its characters once."""
    vocabulary_ = language_id.Vocabulary(PATH)
    probs = np.full((vocabulary_.size, 2), 1 / vocabulary_.size)
    got = language_id.expected_counts([(0, "▁the", 3), (1, "▁tion", 2)], vocabulary_, probs)
    length = np.zeros(vocabulary_.size)
    for p, i in vocabulary_.ids.items():
        length[i] = len(p)
    assert np.allclose(length @ got, [12, 10])


def test_held_out_accuracy_and_odd_rows(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    lang = {r.doc_id: (r.lang, r.text) for r in docs.collect()}
    got = language_id.identify(docs, PATH).collect()
    assert len(got) == len(lang)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out and len(lang[r.doc_id][1]) > 40]
    assert sum(r.lang_pred == lang[r.doc_id][0] for r in held) >= 0.98 * len(held)


def test_odd_rows(spark):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    rows = {r.doc_id: r for r in language_id.identify(docs, PATH).collect()}
    assert {i for i, r in rows.items() if r.lang_pred == "und"} == {0, 1, 2, 11}
    assert rows[None].held_out is False
    kept = language_id.in_known_language(docs, PATH)
    assert kept.columns == docs.columns and kept.count() <= docs.count() - 4
    assert language_id.identify(docs.limit(0), PATH).count() == 0
    nothing = docs.withColumn("lang", docs.lang.substr(100, 1)).selectExpr("doc_id", "text", "nullif(lang, '') lang")
    assert {r.lang_pred for r in language_id.identify(nothing, PATH).collect()} == {"und"}


def test_long_words_teach(monkeypatch):
    """A word beyond SHORT has the expectations of all its segmentations; a very long one stays in range."""
    vocabulary_ = language_id.Vocabulary(PATH)
    rng = np.random.default_rng(1)
    probs = rng.dirichlet(np.ones(vocabulary_.size), 2).T + 1e-9
    length = np.zeros(vocabulary_.size)
    for p, i in vocabulary_.ids.items():
        length[i] = len(p)
    word = "▁" + "antidisestablishment" * 2 + "a日"
    got = language_id.expected_counts([(1, word, 3)], vocabulary_, probs)
    monkeypatch.setattr(language_id, "SHORT", 99)
    want = language_id.expected_counts([(1, word, 3)], vocabulary_, probs)
    monkeypatch.undo()
    assert got.sum() > 0 and np.allclose(got, want)
    got = language_id.expected_counts([(0, "▁" + "nation" * 3000, 2)], vocabulary_, probs)
    assert np.isclose(length @ got[:, 0], 2 * 18_001)


def test_samples_hold_at_any_size(spark):
    """A share far below a millionth draws ids still, about its number; a share of 1 or more draws all."""
    assert 0 < hash_limit(1500 / 1e12) < 2**63 * 2e-9
    ids = spark.range(200_000)
    assert 1000 < ids.where(drawn("lang", ids.id, F.lit(hash_limit(1500 / 200_000)))).count() < 2000
    tiny = spark.range(20_000_000)
    assert 2 <= tiny.where(drawn("lang", tiny.id, F.lit(hash_limit(5e-7)))).count() <= 30
    assert ids.where(drawn("lang", ids.id, F.lit(hash_limit(3.0)))).count() == 200_000
