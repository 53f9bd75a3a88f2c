"""SimHash fingerprints, and links between them by a self-join of their binary trie.

Fingerprints are 64 bits, and distinct ones are joined: documents with one fingerprint are
one class. Two fingerprints that differ in at most ``BUDGET`` bits agree in one of
``BUDGET + 1`` blocks of bits, so that the trie is walked once with each block on top: on
the levels of that block no bit may differ, and every node below it (a *bucket*) is walked
with itself. A bucket that holds more than ``BUCKET`` fingerprints is parted in the same
way, with the blocks of its remaining bits, so that no task holds more; every pair stays
together in some part, and no bucket of 19 free bits can be larger.

In a bucket pairs of nodes go down together, with the bits in which they differ so far, and
a pair of nodes goes no further once these exceed the budget. A pair of nodes whose
fingerprints are all linked already has nothing to tell and ends, too: a bucket of near
copies gives one link for each, not all their pairs, though every link is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import as_bytes, materialise, releasing, slices
from .near_dedup import components

SHINGLE, SEED, BITS = 4, 42, 64
BUDGET = 4
#: Distinct fingerprints of a bucket that a task walks; larger ones are parted.
BUCKET = 1 << 19
#: Fingerprints walked together, pairs of nodes that go down together, and pairs of fingerprints compared at once.
TOGETHER, NODES, LEAVES = 1 << 19, 1 << 16, 1 << 20
#: Pairs of fingerprints below two nodes that are compared one by one.
FEW = 48


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """Bits that are set in over half of the hashes of the shingles, as an unsigned number; 0 without words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: A-Z alone become lower case, and white space is ASCII
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - width + 1)
    starts = np.r_[0, ends[: n - 1] + 1].tolist()
    stops = ends[-n:].tolist()
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        h = np.fromiter((xxh64_intdigest(whole[a:b], SEED) for a, b in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)], strict=True)), np.uint64)
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = np.array([fingerprint(t) for t in as_bytes(batch.column(1))], np.uint64)
        yield pa.record_batch([batch.column(0), pa.array(found.view(np.int64), pa.int64())], names=["id", "fp"])


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the classes of a[k] and b[k]; ``label`` holds the smallest member of every class."""
    while True:
        x, y = label[a], label[b]
        if not (x != y).any():
            return
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (again := label[label]).tobytes() != label.tobytes():
            label[:] = again


def _middle(values: np.ndarray, low: np.ndarray, high: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """First place of each range whose bit at this depth is set (values of a range are sorted, equal above it)."""
    low, high, shift = low.copy(), high.copy(), (BITS - 1 - depth).astype(np.uint64)
    while (open_ := low < high).any():
        mid = (low + high) // 2
        one = ((values[np.minimum(mid, len(values) - 1)] >> shift) & np.uint64(1)).astype(bool)
        high = np.where(open_ & one, mid, high)
        low = np.where(open_ & ~one, mid + 1, low)
    return low


def _compared(values: np.ndarray, label: np.ndarray, pairs: np.ndarray, budget: int) -> None:
    """Merges what is near enough among the fingerprints below each pair of nodes."""
    a_low, a_high, b_low, b_high = pairs[:4]
    sizes = (a_high - a_low) * (b_high - b_low)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LEAVES, "right")))
        own = np.repeat(np.arange(at, stop), sizes[at:stop])
        k = np.arange(len(own)) - np.repeat(ends[at:stop] - sizes[at:stop], sizes[at:stop]) + (ends[at - 1] if at else 0)
        width = (b_high - b_low)[own]
        i, j = a_low[own] + k // width, b_low[own] + k % width
        near = (i < j) & (np.bitwise_count(values[i] ^ values[j]) <= budget)
        _merge(label, i[near], j[near])
        at = stop


def linked(values: np.ndarray, low: np.ndarray, high: np.ndarray, fixed: np.ndarray, budget: int = BUDGET) -> np.ndarray:
    """Per value the smallest place that links reach from it, within the ranges low..high.

    ``values``: unsigned, distinct and sorted within each range, equal in the range's first
    ``fixed`` bits.
    """
    label = np.arange(len(values))
    next_ = np.flatnonzero((np.bitwise_count(values[1:] ^ values[:-1]) <= budget) & (np.repeat(np.arange(len(low)), high - low)[1:] == np.repeat(np.arange(len(low)), high - low)[:-1])) if len(values) > 1 else np.zeros(0, np.int64)
    _merge(label, next_, next_ + 1)
    stack = [np.array([low, high, low, high, fixed, np.zeros(len(low), np.int64)])[:, high - low > 1]]
    while stack:
        pairs = stack.pop()
        if pairs.shape[1] > NODES:
            stack += [pairs[:, at : at + NODES] for at in range(0, pairs.shape[1], NODES)]
            continue
        # classes change between neighbours so often before each place
        changes = np.r_[0, np.cumsum(label[1:] != label[:-1])]
        one = (changes[pairs[0]] == changes[pairs[1] - 1]) & (changes[pairs[2]] == changes[pairs[3] - 1]) & (label[pairs[0]] == label[pairs[2]])
        pairs = pairs[:, ~one]
        few = (pairs[1] - pairs[0]) * (pairs[3] - pairs[2]) <= FEW
        _compared(values, label, pairs[:, few], budget)
        a_low, a_high, b_low, b_high, depth, bits = pairs[:, ~few]
        if not len(a_low):
            continue
        a_mid, b_mid = _middle(values, a_low, a_high, depth), _middle(values, b_low, b_high, depth)
        both = a_low != b_low  # a node with itself has its halves' pair once
        below = [
            np.array([a_low, a_mid, b_low, b_mid, depth + 1, bits]),
            np.array([a_mid, a_high, b_mid, b_high, depth + 1, bits]),
            np.array([a_low, a_mid, b_mid, b_high, depth + 1, bits + 1]),
            np.array([a_mid, a_high, b_low, b_mid, depth + 1, bits + 1])[:, both],
        ]
        below = np.concatenate(below, axis=1)
        below = below[:, (below[0] < below[1]) & (below[2] < below[3]) & (below[5] <= budget)]
        alone = (below[0] == below[2]) & (below[1] - below[0] == 1)
        if (~alone).any():
            stack.append(below[:, ~alone])
    return label


def _walked(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows (path, top, fixed, value, fp): a link from each fingerprint to the first that it reaches."""
        for path, top, fixed, value, fp in _buckets(batches):
            start = np.flatnonzero(np.r_[True, (path[1:] != path[:-1]) | (top[1:] != top[:-1])])
            label = linked(value.view(np.uint64), start, np.r_[start[1:], len(path)], fixed[start], budget)
            moved = np.flatnonzero(label != np.arange(len(label)))
            if len(moved):
                yield pa.record_batch({"a": pa.array(fp[label[moved]], pa.int64()), "b": pa.array(fp[moved], pa.int64())})

    return run


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of whole buckets, about TOGETHER rows at a time."""
    held, n = [], 0
    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
        n += batch.num_rows
        if n >= TOGETHER:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            cut = int(np.flatnonzero(np.r_[True, (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])])[-1])
            if cut:
                yield [c[:cut] for c in columns]
            held, n = [[c[cut:] for c in columns]], n - cut
    if n:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _parted(rows: DataFrame, free: int, parts: int) -> DataFrame:
    """``rows`` (path, value, fp) with each of ``parts`` blocks of the ``free`` last bits brought on top of them.

    A bucket is the path of blocks on top and their bits; bits are only moved, so that
    distances stay.
    """
    mask = (1 << free) - 1
    signed = mask - (1 << 64) if mask >= 1 << 63 else mask
    rest = F.col("value").bitwiseAND(F.lit(signed))
    kept = F.col("value").bitwiseAND(F.lit(~signed))
    edges = [free * k // parts for k in range(parts + 1)]

    def turned(by: int) -> Column:
        if not by:
            return F.col("value")
        low = F.shiftleft(rest, by).bitwiseAND(F.lit(signed))
        return kept.bitwiseOR(low).bitwiseOR(F.shiftrightunsigned(rest, free - by))

    ways = [F.struct(F.lit(k).alias("way"), F.lit(BITS - free + edges[k + 1] - edges[k]).alias("now"), turned(edges[k]).alias("value")) for k in range(parts)]
    out = rows.select("path", "fp", F.explode(F.array(*ways)).alias("w")).select("fp", (F.col("path") * parts + F.col("w.way") + 1).alias("path"), F.col("w.now").alias("fixed"), F.col("w.value").alias("value"))
    return out.withColumn("top", F.expr(f"shiftrightunsigned(value, {BITS} - fixed)"))


def fingerprint_links(distinct: DataFrame, budget: int = BUDGET, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) over which every two of the distinct fingerprints ``fp`` that differ in ``budget`` bits or fewer reach each other.

    No more links than rows come from each way to part a fingerprint's bits.
    """
    parts, free = budget + 1, BITS
    rows = _parted(distinct.select(F.col("fp").alias("value"), "fp", F.lit(0).cast("long").alias("path")), free, parts)
    done = None
    while True:
        rows = materialise(rows, "trie-buckets")
        free -= free // parts  # the narrowest block leaves so many bits
        large = materialise(rows.groupBy("path", "top").count().where(F.col("count") > bucket).select(F.col("path").alias("__p"), F.col("top").alias("__t")), "large-buckets")
        if free <= parts or large.isEmpty():
            done = rows if done is None else done.unionByName(rows)
            break
        hot = (F.col("path") == F.col("__p")) & (F.col("top") == F.col("__t"))
        small = rows.join(large, hot, "left_anti")
        done = small if done is None else done.unionByName(small)
        rows = _parted(rows.join(large, hot, "left_semi"), free, parts)
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = done.repartition(n, "path", "top").sortWithinPartitions("path", "top", "value")
    return dealt.select("path", "top", "fixed", "value", "fp").mapInArrow(releasing(_walked(budget)), "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """Per row: id, fingerprint (16 hex digits), component_id (smallest id reachable, itself included).

    Texts of fewer words than a shingle are one shingle; null, empty and blank texts have
    the fingerprint zero, which links like any other. Long texts are taken whole. Rows
    without an id have a fingerprint, but no component. Repeated rows stay, and each goes by
    its own text. Other columns are ignored, whatever their names. An empty table gives no
    rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    made = materialise(source.mapInArrow(releasing(_fingerprinted), f"id {kind}, fp long"), "fingerprints")
    classes = materialise(made.where("id is not null").groupBy("fp").agg(F.min("id").alias("least")), "fingerprint-classes")
    links = materialise(fingerprint_links(classes.select("fp"), budget).distinct(), "fingerprint-links")
    roots = components(links).select(F.col("id").alias("__i"), "root")
    classes = materialise(classes.join(roots, F.col("fp") == F.col("__i"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted-fingerprints")
    least = classes.groupBy("root").agg(F.min("least").alias("component")).select(F.col("root").alias("__r"), "component")
    of_class = classes.join(least, F.col("root") == F.col("__r")).select(F.col("fp").alias("__fp"), "component")
    out = made.join(of_class, F.col("fp") == F.col("__fp"), "left")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("id").isNotNull(), F.col("component")).alias("component_id"))
