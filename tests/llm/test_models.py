import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from matchloom.llm import hmm, token_counts
from matchloom.llm._common import documents
from matchloom.llm.queries import vocabulary

from ._fixtures import SCHEMA, odd_rows

RANKS = vocabulary("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def encoder():
    return token_counts.Encoder(RANKS, public_tokenizers.PATTERN)


BITS = ["word", " a", "  ", "\n", "\n\n ", "é", "123", "'s", "!?", " x", "tion", "\t", "don't", "", " " * 9]
SPACED = [" ", "  ", "\n", "\n\n", " \n", "\t", "x", "'", "re", "r", "e", "'l", "l", "a b", "\u00a0"]


@pytest.mark.parametrize("leaf,bits,n", [(64, BITS, 150), (64, SPACED, 400), (1, SPACED, 1500), (2, SPACED, 1500), (3, BITS, 800)])
def test_edits_against_counting_again(encoder, leaf, bits, n):
    """Trees with small leaves put boundaries everywhere; white space and apostrophes look ahead."""
    rng = random.Random(leaf)
    for _ in range(n):
        text = "".join(rng.choice(bits) for _ in range(rng.choice([0, 3, 60, 900 if leaf > 3 else 120])))
        tree = token_counts.CountTree(*encoder.leaves(text, leaf), leaf)
        for _ in range(4):
            a = rng.randint(-2, len(text) + 3)
            b = a + rng.choice([0, 0, 1, 5, 200])
            new = "".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 8, 100])))
            text, _n = tree.edit(text, a, b, new, encoder)
            assert tree.total == sum(encoder.counts(encoder.find(text)))
            assert sum(tree.chars) == len(text) == tree.char_sums[0]
            assert sum(tree.pretokens) == len(encoder.find(text))
        assert tree.total == len(encoder.encoding.encode_ordinary(text))


def test_edit_behind_white_space(encoder):
    text = "a" + " b" * 62 + "\n\nx y and more words here"
    tree = token_counts.CountTree(*encoder.leaves(text))
    at = text.index("x")
    after, _ = tree.edit(text, at, at + 1, "", encoder)
    assert tree.total == len(encoder.encoding.encode_ordinary(after))
    long = "a b" + " " * 9000 + "c" + " d" * 300
    tree = token_counts.CountTree(*encoder.leaves(long))
    after, _ = tree.edit(long, 1, 2, "", encoder)
    assert tree.total == len(encoder.encoding.encode_ordinary(after))


def test_edits_on_edited_rows(spark, encoder):
    """A row that was edited once is edited again from its stored tree."""
    rows = [(k, "a" + " b" * 62 + "\n\nx y and more words here" + " more" * k, [(127 + k, 128 + k, "")]) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:long,end:long,new:string>>")
    state = token_counts.count_tokens(docs, RANKS, public_tokenizers.PATTERN, keep_text=True)
    now = state.join(docs.select("doc_id", "edits"), "doc_id")
    for new in ("", " two words", "\n \n", "'re"):
        out = token_counts.recount(now, RANKS, public_tokenizers.PATTERN, stored=True)
        for r in out.collect():
            assert r.n_tokens_edited == len(encoder.encoding.encode_ordinary(r.edited_text)) == r.token_sums[0]
            assert r.n_pretokens_edited == len(encoder.find(r.edited_text)) == sum(r.leaf_pretokens)
        now = out.selectExpr("doc_id", "edited_text as text", "leaf_chars", "leaf_pretokens", "token_sums", f"array(struct(100L + doc_id as start, 103L + doc_id as end, \"{new}\" as new)) as edits")


def test_edit_touches_a_region_only(encoder):
    text = " ".join(f"word{k} and more" for k in range(5000))
    tree = token_counts.CountTree(*encoder.leaves(text))
    _, encoded = tree.edit(text, 30_000, 30_004, "new", encoder)
    assert encoded <= 4 * token_counts.LEAF


def test_edits_touch_paths_only(encoder, monkeypatch):
    """An edit that fits its leaves does not build the tree anew, and all sums are those of a new tree."""
    text = " ".join(f"word{k} and more" for k in range(3000))
    tree = token_counts.CountTree(*encoder.leaves(text))
    monkeypatch.setattr(token_counts.CountTree, "_sum", lambda self: pytest.fail("the whole tree was summed"))
    rng = random.Random(8)
    for _ in range(60):
        a = rng.randint(0, len(text))
        text, _n = tree.edit(text, a, a + rng.choice([0, 3, 40]), rng.choice(["", "x", " some new words here"]), encoder)
    assert tree.token_sums == token_counts.subtree_sums(tree.tokens) and tree.char_sums == token_counts.subtree_sums(tree.chars)
    assert tree.total == len(encoder.encoding.encode_ordinary(text))


def test_null_edits(spark, encoder):
    edits = [(None, 3, "x"), (2, None, "y"), None]
    docs = spark.createDataFrame([(1, "some words", edits)], "doc_id long, text string, edits array<struct<start:long,end:long,new:string>>")
    row = token_counts.recount(docs, RANKS, public_tokenizers.PATTERN).first()
    assert row.edited_text == "some words" and row.n_tokens_edited == row.n_tokens and row.n_reencoded == 0


def test_recount_rows(spark, encoder):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    edits = docs.selectExpr("*", "array(struct(2L as start, 5L as end, 'new text' as new), struct(0L as start, 0L as end, null as new)) as edits")
    rows = {r.doc_id: r for r in token_counts.recount(edits, RANKS, public_tokenizers.PATTERN).collect()}
    count = lambda t: len(encoder.encoding.encode_ordinary(t))
    for r in docs.collect():
        text = r.text or ""
        assert rows[r.doc_id].n_tokens == count(text)
        assert rows[r.doc_id].n_tokens_edited == count(text[:2] + "new text" + text[5:])
    state = token_counts.count_tokens(docs, RANKS, public_tokenizers.PATTERN).drop("n_tokens").where("doc_id is not null")
    stored = edits.where("doc_id is not null").join(state, "doc_id")
    again = {r.doc_id: r for r in token_counts.recount(stored, RANKS, public_tokenizers.PATTERN, stored=True).collect()}
    assert all(again[i].n_tokens_edited == rows[i].n_tokens_edited for i in again)
    assert token_counts.recount(edits.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_forward_and_baum_welch_against_plain_sums():
    rng = np.random.default_rng(4)
    model = hmm.Hmm(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(hmm.CLASSES), 3))
    seqs = [rng.integers(0, 50, n) for n in (6, 4, 1)]
    symbols, lengths = np.concatenate(seqs), np.array([6, 4, 1])
    starts = np.array([0, 6, 10])
    got = model.forward(symbols, starts, lengths)
    for k, s in enumerate(seqs):
        p = sum(model.start[path[0]] * model.emit[path[0], s[0]] * np.prod([model.move[path[t - 1], path[t]] * model.emit[path[t], s[t]] for t in range(1, len(s))]) for path in np.ndindex(*[3] * len(s)))
        assert math.isclose(got[k], math.log10(p), rel_tol=1e-9)
    start, move, emit, likelihood = model.expected(symbols, starts, lengths)
    assert math.isclose(start.sum(), 3) and math.isclose(move.sum(), 8) and math.isclose(emit.sum(), 11)
    assert math.isclose(likelihood, got.sum())
    better = hmm.Hmm.from_counts(start, move, emit)
    assert better.forward(symbols, starts, lengths).sum() > got.sum()


def test_values_scaled_at_every_eighth_step(monkeypatch):
    """Scaling at every eighth step changes no result, near its bounds and for the least probabilities."""
    rng = np.random.default_rng(8)
    emit = rng.dirichlet(np.ones(hmm.CLASSES), 3)
    emit[:, :50] *= 1e-11
    model = hmm.Hmm(rng.dirichlet(np.ones(3)), np.array([[1.0, 1e-15, 1e-15], [1e-15, 1.0, 1e-15], [1e-15, 1e-15, 1.0]]), emit)
    lengths = np.array([40, 17, 16, 15, 9, 9, 8, 7, 1])
    given = rng.integers(0, 50, lengths.sum()), np.cumsum(lengths) - lengths, lengths
    assert hmm.SCALED == 8
    eighth, scores = model.expected(*given), model.forward(*given)
    alone = [model.expected_long(given[0][a : a + n], 100) for a, n in zip(given[1], lengths, strict=True)]
    assert all(np.allclose(a, sum(b), rtol=1e-9) for a, b in zip(eighth, zip(*alone, strict=True), strict=True))
    monkeypatch.setattr(hmm, "SCALED", 1)
    assert all(np.allclose(a, b, rtol=1e-9) for a, b in zip(eighth, model.expected(*given), strict=True))
    assert np.allclose(scores, model.forward(*given), rtol=1e-9)


def test_long_sequences_teach_whole():
    """Stretches give the counts of the whole sequence, transitions between stretches included."""
    rng = np.random.default_rng(6)
    model = hmm.Hmm(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(hmm.CLASSES), 3))
    symbols = rng.integers(0, 50, 41)
    whole = model.expected(symbols, np.array([0]), np.array([41]))
    for stretch in (1, 7, 40, 41, 100):
        parts = model.expected_long(symbols, stretch)
        assert all(np.allclose(a, b) for a, b in zip(whole, parts, strict=True))


def test_long_documents_in_a_pass(spark, monkeypatch):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    want = {r.doc_id: r.score for r in hmm.score_documents(docs).collect()}
    monkeypatch.setattr(hmm, "STRETCH", 100)
    got = {r.doc_id: r.score for r in hmm.score_documents(docs).collect()}
    assert all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want)


def brute_base(rows):
    train = Counter()
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in rows}
    out = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    for i, t in tokens.items():
        if not out[i]:
            train.update(t)
    n, v = sum(train.values()), len(train)
    return {i: (out[i], len(t), sum(w in train for w in t), n, sum(math.log10((train[w] + 1) / (n + v + 1)) for w in t)) for i, t in tokens.items()}


def check(docs):
    rows = hmm.score_documents(docs).collect()
    want = brute_base([(r.doc_id, r.text) for r in docs.collect()])
    assert len(rows) == len(want)
    for r in rows:
        held, n, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        assert r.score < 0
    return rows


def test_every_pass_takes_all_bundles(spark, monkeypatch):
    """No step of Baum-Welch is of some bundles only."""
    monkeypatch.setattr(hmm, "BUNDLE_DOCS", 5)
    docs = spark.range(200).selectExpr("id as doc_id", "concat('some text of ', id % 7) as text")
    seen, plain = [], hmm._pass
    monkeypatch.setattr(hmm, "_pass", lambda bundles, *a: seen.append(sum(len(r.ids) for r in bundles.select("ids").collect())) or plain(bundles, *a))
    assert hmm.score_documents(docs).count() == 200
    assert len(seen) == hmm.PASSES and set(seen) == {200}


def test_scores(spark):
    rows = check(documents(spark, "/root/testdata/sf0.01"))
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_odd_rows_small_bundles(spark, monkeypatch):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    check(docs)
    check(spark.createDataFrame([(k, "held out text") for k in range(200) if zlib.crc32(str(k).encode()) % 7 == 2], "doc_id long, text string"))
    assert hmm.score_documents(docs.limit(0)).count() == 0
