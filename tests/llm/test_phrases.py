import random
import re
from collections import Counter
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from matchloom.llm import oracles, phrases, queries
from matchloom.llm._common import documents

from ._fixtures import SCHEMA, odd_rows

NAMES = "lang, rank, phrase, a, l, r, n, score"


def brute(rows, least, top=2000, percent=80):
    """Every phrase of every piece, with exact arithmetic."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    often = {x: c for x, c in f.items() if c >= least and len(x[1]) > 1}
    out = []
    for (lang, p), a in often.items():
        score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        inside = (c for (other, q), c in often.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))))
        if not any(100 * c >= percent * a for c in inside):
            out.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    ranks, found = Counter(), []
    for lang, score, a, p, left, right in sorted(out):
        ranks[lang] += 1
        if ranks[lang] <= top:
            found.append((lang, ranks[lang], p.decode(), -a, left, right, n[lang], -score))
    return sorted(found)


def some_texts(seed, n):
    rng = random.Random(seed)
    fixed = ["new york city hall", "at the end of", "in order to", "as well as the", "é ü ß"]
    for _ in range(n):
        words = []
        for _ in range(rng.randrange(30)):
            words.append(rng.choice(fixed) if rng.random() < 0.4 else rng.choice("abcdefgh"))
            if rng.random() < 0.2:
                words[-1] += rng.choice(".,;:!?\n")
        yield rng.choice(["en", "fr", None]), rng.choice([" ", "  ", "\t"]).join(words).replace("york", rng.choice(["York", "york"]))


@pytest.mark.parametrize("shard_words", [1 << 19, 200])
def test_against_brute_force(spark, shard_words):
    """In one shard for a language of a task, and in many."""
    rows = list(some_texts(1, 500))
    docs = spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string").repartition(3)
    got = sorted(tuple(r) for r in phrases.collocations(docs, least=5, shard_words=shard_words).select(*NAMES.split(", ")).collect())
    assert got == brute(rows, 5) and len(got) > 60
    got = sorted(tuple(r) for r in phrases.collocations(docs, least=9, top=7, shard_words=shard_words).select(*NAMES.split(", ")).collect())
    assert got == brute(rows, 9, 7)


def test_index_against_counting():
    """Every interval that the index grows has the place and the number of its phrase, on both sides."""
    rng = np.random.default_rng(2)
    ids = np.append(rng.integers(0, 6, 400), 0)
    counts = np.bincount(ids)
    starts = np.cumsum(counts) - counts
    forward, backward = (phrases.Index(x, starts) for x in phrases.transforms(ids))
    own = np.arange(1, len(counts))
    found = phrases.Grown([own], starts[own], starts[own], counts[own])
    for k in range(2, 5):
        longer = found.rightwards(backward)
        plain = Counter(tuple(ids[i : i + k].tolist()) for i in range(len(ids) - k + 1) if ids[i : i + k].all())
        assert dict(zip(zip(*(w.tolist() for w in longer.words), strict=True), longer.count.tolist(), strict=True)) == plain
        below = sorted(tuple(ids.tolist()[i : i + k]) + (0,) * (k - len(ids[i : i + k])) for i in range(len(ids)))
        assert [below.index(p) for p in zip(*(w.tolist() for w in longer.words), strict=True)] == longer.low.tolist()
        assert set(longer.low.tolist()) <= set(found.leftwards(forward).tolist())
        found = longer


def test_odd_rows_and_empty(spark):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    got = sorted(tuple(r) for r in phrases.collocations(docs, least=3).select(*NAMES.split(", ")).collect())
    assert got == brute([(r.lang, r.text) for r in docs.collect()], 3) and len(got) > 100
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_long_text_is_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(phrases, "TEXT_BYTES", 50)
    text = b"One two, three four. " * 40 + b"x" * 200 + b" last"
    parts = list(phrases._parts_of(text))
    assert len(parts) > 5 and all(p[-1] == b"\n" for p in parts)
    assert [w for p in parts for w in p if w != b"\n"] == text.lower().replace(b",", b"").replace(b".", b"").split()


def test_query_against_sql(spark, sf_dir):
    got = sorted(tuple(r) for r in queries.op12_phrase_collocations(spark, sf_dir).select(*NAMES.split(", ")).collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert got == sorted(con.sql(f"SELECT {NAMES} FROM ({oracles.OP12})").fetchall())
    assert got == brute([(r.lang, r.text) for r in documents(spark, sf_dir).collect()], 30)


@pytest.mark.parametrize("held", [1, 50, 1 << 21])
def test_phrases_travel_in_groups(monkeypatch, held):
    """A task sends a row for a language of a group, not one for each phrase of a shard, and no count is lost."""
    monkeypatch.setattr(phrases, "HELD_PHRASES", held)
    texts = pa.record_batch({"lang": ["en", "fr"] * 150, "text": [t for _, t in some_texts(3, 300)]})
    made = list(phrases._sharded(200)(iter([texts])))
    every_word = SimpleNamespace(value=np.full(1 << 17, 255, np.uint8)), 1 << 20
    want, entries = Counter(), 0
    for batch in made:
        shard = phrases.Opened(batch, every_word)
        words = shard.words.to_pylist()
        for pairs in shard.pairs():
            for first, second, a in zip(*pairs.words, pairs.count, strict=True):
                want[f"{shard.lang}\t{words[first]} {words[second]}"] += int(a)
                entries += 1
    rows = list(phrases._grouped(2, 4, phrases._opener(every_word), lambda shard, batch: shard.pairs())(iter(made)))
    assert held < 1000 or (len(rows) <= 8 and entries > 300)
    groups = [r["grp"][0].as_py() for r in rows]
    got = {}
    for group in set(groups):
        for out in phrases._totals(2, 5)(iter([r for r, g in zip(rows, groups, strict=True) if g == group])):
            for key, a in zip(*(c.to_pylist() for c in out.columns), strict=True):
                assert key not in got
                got[key] = a
    assert got == {key: a for key, a in want.items() if a >= 5} and len(got) > 30


@pytest.mark.parametrize("held", [1, 1 << 21])
def test_no_frequent_pair_is_in_a_rare_slot(monkeypatch, held):
    """With slots enough for few pairs each, and with so few that many share one."""
    monkeypatch.setattr(phrases, "SEGMENT_BITS", 16)
    monkeypatch.setattr(phrases, "HELD_SLOTS", held)
    texts = pa.record_batch({"lang": ["en"] * 300, "text": [t for _, t in some_texts(7, 300)]})
    made = list(phrases._sharded(200)(iter([texts])))
    assert len(made) > 3
    every_word = SimpleNamespace(value=np.full(1 << 17, 255, np.uint8)), 1 << 20
    for slots in (32, 1 << 16):
        tallied = list(phrases._tallied(every_word, slots, 5)(iter(made)))
        bits = np.zeros(slots, bool)
        for batch in phrases._reached(5)(iter(tallied)):
            for segment, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bits[segment * 16 :][:16] = np.unpackbits(np.frombuffer(part, np.uint8))
        totals, slot_of = Counter(), {}
        for batch in made:
            shard = phrases.Opened(batch, every_word)
            words = shard.words.to_pylist()
            for pairs in shard.pairs():
                at = phrases._slots_of(shard.hashes_of(pairs), slots)
                for first, second, a, slot in zip(*pairs.words, pairs.count, at, strict=True):
                    totals[words[first], words[second]] += int(a)
                    slot_of[words[first], words[second]] = slot
        in_slot = Counter()
        for pair, a in totals.items():
            in_slot[slot_of[pair]] += a
        assert set(np.flatnonzero(bits)) == {slot for slot, a in in_slot.items() if a >= 5}
        assert sum(a >= 5 for a in totals.values()) > 10
