import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from matchloom.llm import packing
from matchloom.llm._common import documents
from matchloom.llm.queries import vocabulary

from ._fixtures import SCHEMA, odd_rows

PATH = vocabulary("word_bpe_49k.json")


def check(docs, capacity):
    tok, want = Tokenizer.from_file(PATH), {}
    for r in docs.collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 1]
        for i in range(0, len(ids), capacity):
            part = ids[i : i + capacity]
            want[r.doc_id, i // capacity] = (i, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    got = packing.pack_documents(docs, PATH, capacity).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(n for _, n, _ in want.values())


def test_pieces_and_bins(spark, sf_dir):
    bins, total = check(documents(spark, sf_dir), 4096)
    assert bins <= -(-total // 4096) + 1
    check(spark.createDataFrame(odd_rows(), SCHEMA), 4096)


def test_special_strings_and_odd_white_space(spark):
    texts = ["a <|endoftext|> b", "x y z", "don't  stop\x1cnow", "é ́a", "\x85\x0b\x0c", "ß\tİ\nΣΑΣ"]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 8)


def brute_fullest(room, items):
    sums = {0}
    for x in items:
        sums |= {s + x for s in sums if s + x <= room}
    return max(sums)


def test_fullest_against_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        counts = {rng.randint(1, 60): rng.randint(1, 5) for _ in range(rng.randint(1, 8))}
        room = rng.randint(0, 100)
        found = packing.fullest(room, counts)
        assert all(found.count(x) <= counts[x] for x in found)
        assert sum(found) == brute_fullest(room, [x for x, n in counts.items() for _ in range(n)])


def test_plan_uses_every_piece_once():
    rng = random.Random(5)
    counts = {rng.randint(1, 4096): rng.randint(1, 1000) for _ in range(400)}
    used = defaultdict(int)
    for times, lengths in packing.minimum_bin_slack(counts):
        assert sum(lengths) <= 4096
        for x in lengths:
            used[x] += times
    assert used == counts


def test_buckets_and_ties(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_BUCKET", 7)
    pieces = spark.createDataFrame([(k % 50, 0, 0, 1 + k % 3, 0) for k in range(500)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(pieces, 10).collect()
    places = {(r.sequence_id, r.offset + i) for r in got for i in range(r.length)}
    assert len(got) == 500 and len(places) == sum(r.length for r in got)
    assert max(p for _, p in places) <= 9 and len({s for s, _ in places}) == -(-len(places) // 10)


def test_empty(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
