import math
from collections import Counter, defaultdict

import pytest

from matchloom.llm import mixing
from matchloom.llm._common import documents

from ._fixtures import SCHEMA, odd_rows, prose, words_of


def brute_targets(sizes):
    """Share, cap, and share the excess again until no source is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    fixed, total = {}, float(sum(sizes.values()))
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in over}


def check(docs):
    rows = mixing.mix_sources(docs).collect()
    texts = docs.select("doc_id", "text", "source").collect()
    assert sorted((str(r.doc_id), r.source or "", r.size) for r in rows) == sorted((str(t.doc_id), t.source or "", len(words_of(t.text))) for t in texts)
    sizes, taken, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r.size)
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
    want = brute_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for s, n in taken.items():
        assert abs(n - want[s]) <= longest[s]
    again = {r.doc_id: r.copies for r in mixing.mix_sources(docs.repartition(5)).collect()}
    assert again == {r.doc_id: r.copies for r in rows}
    assert sum(r.copies for r in rows) == mixing.mixed_documents(docs).count()
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_against_brute_force(spark, sf_dir):
    check(documents(spark, sf_dir))
    check(spark.createDataFrame(odd_rows(), SCHEMA))


def test_capped_sources_and_many_blocks(spark):
    rows = [(k, prose(k, 5 + k % 9), "a" if k < 3 else "b" if k < 10 else "hot" if k < 700 else f"s{k % 40:02}") for k in range(1500)]
    check(spark.createDataFrame(rows, "doc_id long, text string, source string"))


def test_plain_joins_beyond_the_broadcast_bound(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    check(documents(spark, sf_dir))


def test_empty_and_wordless(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, " ", "b")], "doc_id long, text string, source string")
    assert {(r.size, r.target, r.taken) for r in mixing.mix_sources(docs).collect()} == {(0, 0.0, 0)}
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def balls(spark, counts, passes=1):
    rows = [(e, s, r) for e in range(passes) for s, n in counts.items() for r in range(n)]
    return spark.createDataFrame(rows, "__e int, __s string, __r long")


def test_splitting_tree(spark):
    counts = {"a": 1000, "b": 10, None: 333}
    leaves = mixing.split_tree(balls(spark, counts), 7, 4).collect()
    assert sorted((str(r["__s"]), r["__r"]) for r in leaves) == sorted((str(s), r) for s, n in counts.items() for r in range(n))
    shards = Counter(r["__shard"] for r in leaves)
    assert set(shards) == set(range(7)) and max(shards.values()) - min(shards.values()) <= 3
    again = mixing.split_tree(balls(spark, counts).repartition(3), 7, 4).collect()
    assert sorted(map(str, again)) == sorted(map(str, leaves))


def test_split_is_hypergeometric(spark):
    """2,000 passes as independent draws: means, variances and the exact distribution of a child's count."""
    leaves = mixing.split_tree(balls(spark, {"a": 12, "b": 4}, 2000), 2, 1).where("__shard = 0 and __s = 'b'")
    of = Counter(r["count"] for r in leaves.groupBy("__e").count().collect())
    of[0] = 2000 - sum(of.values())
    for k in range(5):
        want = 2000 * math.comb(4, k) * math.comb(12, 8 - k) / math.comb(16, 8)
        assert abs(of[k] - want) < 5 * math.sqrt(want)


def test_deep_tree_keeps_marginals(spark):
    """Every ball is as likely in any of 8 leaves."""
    leaves = mixing.split_tree(balls(spark, {"a": 9, "b": 23}, 400), 8, 2)
    rows = leaves.where("__s = 'a'").groupBy("__shard").count().collect()
    assert len(rows) == 8 and all(abs(r["count"] - 450) < 5 * math.sqrt(450) for r in rows)
    assert {r["count"] for r in leaves.groupBy("__e", "__shard").count().collect()} == {4}


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(k, f"a b c {k}", "s", 1, 2, 3, 4) for k in range(90)], "doc_id long, text string, source string, target int, source_size int, __s int, __mix int")
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.count() == 90 and mixing.mix_sources(docs).count() == 90


def test_shards_are_disjoint(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    rows = mixing.mix_sources(docs, shards=4).collect()
    drawn, sizes = defaultdict(set), defaultdict(int)
    for r in rows:
        assert len(r.shards) == r.copies and set(r.shards) <= {0, 1, 2, 3}
        for epoch, shard in enumerate(r.shards):
            drawn[r.source, r.block, epoch].add(shard)
            sizes[epoch, shard] += 1
    assert all(len(s) == 1 for s in drawn.values())  # a pass draws a block once
    assert {shard for _, shard in sizes} == {0, 1, 2, 3}
    other = mixing.mix_sources(docs, shards=7).collect()
    assert {r.doc_id: r.taken for r in rows} == {r.doc_id: r.taken for r in other}
