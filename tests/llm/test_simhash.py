import random

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from matchloom.llm import simhash_links
from matchloom.llm._common import documents

from ._fixtures import SCHEMA, odd_rows, prose


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = [xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << bit for bit in range(64) if 2 * sum(x >> bit & 1 for x in h) > len(h))


def brute_labels(values, budget=4):
    """Smallest place that links reach, all pairs compared in blocks."""
    values, label = np.asarray(values, np.uint64), list(range(len(values)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[:i] ^ values[i]) <= budget):
            a, b = sorted((find(i), find(int(j))))
            label[b] = a
    return [find(i) for i in range(len(values))]


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    prints = [plain_fingerprint(t) for _, t in rows]
    with_id = [k for k, (i, _) in enumerate(rows) if i is not None]
    label = brute_labels([prints[k] for k in with_id])
    least = {}
    for k, root in zip(with_id, label, strict=True):
        least[root] = min(least.get(root, rows[k][0]), rows[k][0])
    want = sorted((str(rows[k][0]), f"{prints[k]:016x}", least[root]) for k, root in zip(with_id, label, strict=True))
    want += [(str(None), f"{prints[k]:016x}", None) for k, (i, _) in enumerate(rows) if i is None]
    got = [(str(r.doc_id), r.fingerprint, r.component_id) for r in simhash_links.simhash_components(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_against_brute_force(spark, sf_dir):
    check(documents(spark, sf_dir))
    check(spark.createDataFrame(odd_rows(), SCHEMA))


def test_repeats_and_empty(spark):
    check(spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (1, "quite another text"), (2, "A b  c d e"), (3, None), (4, " ")], "doc_id long, text string"))
    assert simhash_links.simhash_components(documents(spark, "/root/testdata/sf0.001").limit(0)).count() == 0


def test_near_copies(spark):
    """A large group of near copies, and a chain over texts that are not near themselves."""
    hot, rows = prose(4, 400).split(), []
    rows += [(k, " ".join([*hot[: k % 390], f"w{k}", *hot[k % 390 :]])) for k in range(600)]
    rows += [(1000 + k, " ".join(hot[: 400 - 2 * k])) for k in range(60)]
    rows += [(2000 + k, prose(2000 + k, 30)) for k in range(300)]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def flipped(rng, value, n):
    for bit in rng.sample(range(64), n):
        value ^= 1 << bit
    return value


@pytest.mark.parametrize("bucket", [1 << 19, 250])
def test_links_of_planted_fingerprints(spark, bucket):
    """Planted pairs at 0 to 7 bits, chains, and many values around one centre, which fill one bucket."""
    rng = random.Random(bucket)
    values = [rng.getrandbits(64) for _ in range(1500)]
    values += [flipped(rng, v, rng.randrange(8)) for v in values[:700]]
    centre, at = rng.getrandbits(64), rng.getrandbits(64)
    values += [flipped(rng, centre, rng.randrange(7)) for _ in range(300)]
    for _ in range(100):
        at = flipped(rng, at, 4)
        values.append(at)
    values = sorted({*values, 0, 2**64 - 1, 2**63})
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    links = simhash_links.fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fp long"), bucket=bucket).collect()
    place = {v: k for k, v in enumerate(signed)}
    label = list(range(len(values)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for link in links:
        a, b = sorted((find(place[link.a]), find(place[link.b])))
        label[b] = a
    assert [find(i) for i in range(len(values))] == brute_labels(values)


def test_walk_of_one_bucket():
    """The walk alone, on dense buckets: every value within 18 low bits, and one near group."""
    rng = random.Random(3)
    dense = sorted({rng.getrandbits(18) << 20 for _ in range(800)})
    near = sorted({flipped(rng, 77, rng.randrange(9)) & ((1 << 50) - 1) for _ in range(800)})
    values = np.array(dense + near, np.uint64)
    ends = [len(dense), len(dense) + len(near)]
    label = simhash_links.linked(values, np.array([0, ends[0]]), np.array(ends), np.array([14, 14]))
    assert label[: ends[0]].tolist() == brute_labels(dense)
    assert (label[ends[0] :] - ends[0]).tolist() == brute_labels(near)


def test_fingerprint_bits():
    for text in ("", " \t", "one", "One two THREE", "Ünï É x y z w", prose(2, 500)):
        assert simhash_links.fingerprint(text.encode()) == plain_fingerprint(text)
