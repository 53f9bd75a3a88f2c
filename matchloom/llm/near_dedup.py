"""Near-duplicate detection by min-max hashing.

1. Every document's distinct 5-word shingles are hashed once for each permutation, and
   both the minimum and the maximum are kept: ``PERMUTATIONS`` evaluations give twice
   as many signature values. Bands of ``BAND`` values are the candidate buckets.
2. Documents with equal shingle sets are one class; the smallest id stands for it.
3. In every bucket the smallest id is the centre; all others meet it alone. Pairs are
   confirmed on full shingle sets, and confirmed links give components.
4. Buckets that still hold several components are open: there, documents outside the
   centre's component meet the others in tasks of bounded size, on one-byte signatures.
   That tells which components may be similar (some estimate is ``MAYBE`` or more, 4.8
   standard errors below 0.75); their documents then meet on full sets in blocks, and a
   block returns one link for each document that has any.

A bucket of thousands of copies so costs one row for each, not all pairs. A pair at
exactly 0.75 shares no band with a probability of (1 - 0.75**5)**52 = 8e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import WordHashes, as_bytes, materialise, mix64, releasing, slices
from .id_filter import may_contain, without

SHINGLE = 5
PERMUTATIONS, BAND = 130, 5
BANDS = 2 * PERMUTATIONS // BAND
MAYBE = 0.62
#: Documents on each side of a task: of a bucket by signature, of components by full sets.
CHUNK, BLOCK = 1024, 256
#: Shingles on each side of a task on full sets, about.
BLOCK_SHINGLES = 500_000
#: Similarity as a fraction: 100 * intersection >= PERCENT * union.
PERCENT = 75

_FACTORS = mix64(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(text: bytes, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a shorter text is one shingle."""
    words = text.lower().split()  # bytes: A-Z alone become lower case, and white space is ASCII
    if not words:
        return np.zeros(0, np.uint64)
    h = hashes(words)
    width = min(SHINGLE, len(h))
    key = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(key)])
    return np.unique(key)


def signature(values: np.ndarray) -> np.ndarray:
    """Minima, then maxima, of the permuted values."""
    low, high = np.full(PERMUTATIONS, 2**64 - 1, np.uint64), np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(values), 512):
        permuted = values[at : at + 512, None] * _FACTORS
        np.minimum(low, permuted.min(axis=0), out=low)
        np.maximum(high, permuted.max(axis=0), out=high)
    return np.concatenate([low, high])


def bands(sign: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=np.uint64)
    for column in sign.reshape(BANDS, BAND).T:
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in slices(batches):
        sizes, first, second, keys, marks = [], [], [], [], []
        for text in as_bytes(batch.column(1)):
            own = shingles(text, hashes)
            sizes.append(len(own))
            first.append(int(mix64(own).sum(dtype=np.uint64).view(np.int64)) if len(own) else 0)
            second.append(int(mix64(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)) if len(own) else 0)
            sign = signature(own) if len(own) else None
            keys.append(bands(sign).view(np.int64) if len(own) else None)
            marks.append((mix64(sign) & np.uint64(255)).astype(np.uint8).tobytes() if len(own) else None)
        yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(marks, pa.binary())], names=["id", "n", "k1", "k2", "bands", "marks"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows a, b, text of a, text of b -> confirmed pairs. Neighbouring rows share the text of a."""
    hashes, last, own = WordHashes(), None, None
    for batch in slices(batches, 128):
        ids = batch.column(0).to_pylist()
        left, right = as_bytes(batch.column(2)), as_bytes(batch.column(3))
        keep = []
        for k, a in enumerate(ids):
            if a != last or own is None:
                own, last = shingles(left[k], hashes), a
            other = shingles(right[k], hashes)
            both = len(np.intersect1d(own, other, assume_unique=True))
            keep.append(100 * both >= PERCENT * (len(own) + len(other) - both))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    left = texts.select(F.col("id").alias("__a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("__b"), F.col("text").alias("text_b"))
    rows = pairs.join(right, F.col("b") == F.col("__b")).join(left, F.col("a") == F.col("__a")).select("a", "b", "text_a", "text_b")
    kind = pairs.schema["a"].dataType.simpleString()
    return rows.mapInArrow(releasing(_linked), f"a {kind}, b {kind}")


def components(links: DataFrame) -> DataFrame:
    """(id, root) of every id in ``links`` (a, b): large-star and small-star in turn until nothing moves.

    Edges point from the larger to the smaller id. The minimum of each id is written and
    then joined back, so that both sides of the join are dealt by plain exchanges and
    Spark can split the partition of a hub.
    """

    def starred(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y"))
        if large:
            both = both.unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
        lowest = materialise(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("k"), F.least("x", "m").alias("m")), "lowest")
        met = both.join(lowest, F.col("x") == F.col("k"))
        if large:
            out = met.where(F.col("y") > F.col("x")).select(F.col("y").alias("u"), F.col("m").alias("v"))
        else:
            out = met.select(F.col("y").alias("u"), F.col("m").alias("v")).unionByName(lowest.select(F.col("k").alias("u"), F.col("m").alias("v")))
        return out.where(F.col("u") != F.col("v")).distinct()

    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(F.col("u") != F.col("v")).distinct()
    state = None
    while True:
        edges = materialise(starred(materialise(starred(edges, True), "large-stars"), False), "stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state or not now[0]:
            break
        state = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Runs of rows that agree in the first ``n_keys`` columns, by which the rows are sorted."""
    held, task = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [np.asarray(batch.column(k).to_pylist(), object) for k in range(n_keys)]
        ends = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        for start, end in zip([0, *ends], [*ends, batch.num_rows], strict=True):
            own = tuple(k[start] for k in keys)
            if held and own != task:
                yield pa.Table.from_batches(held)
                held = []
            task = own
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def _estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (key, mc, oc, outside, id, root, centre, n, marks): components that may be similar."""
    told: set[tuple] = set()
    for rows in _groups(batches, 3):
        outside, central = rows["outside"].to_numpy(), rows["centre"].to_numpy()
        roots, sizes = rows["root"].to_numpy(), rows["n"].to_numpy()
        marks = np.frombuffer(b"".join(rows["marks"].to_pylist()), np.uint8).reshape(len(roots), -1)
        inner = np.flatnonzero(~outside & ~central)  # the centre has met everyone here
        new = set()
        for k in np.flatnonzero(outside):
            near = inner[(roots[inner] != roots[k]) & (100 * np.minimum(sizes[inner], sizes[k]) >= PERCENT * np.maximum(sizes[inner], sizes[k]))]
            near = near[(marks[near] == marks[k]).sum(axis=1) >= MAYBE * marks.shape[1]]
            new.update((min(r, roots[k]), max(r, roots[k])) for r in np.unique(roots[near]))
        new -= told
        told |= new
        if len(told) > 500_000:
            told.clear()
        if new:
            kind = rows.schema.field("root").type
            yield pa.record_batch({"a": pa.array([x for x, _ in new], kind), "b": pa.array([x for _, x in new], kind)})


def _open_components(shared: DataFrame, roots: DataFrame, signed: DataFrame) -> DataFrame:
    """Pairs (a, b) of components with similar-looking documents that share a bucket and have not met."""
    kind = shared.schema["id"].dataType.simpleString()
    rows = shared.join(roots.select(F.col("id").alias("__i"), "root"), F.col("id") == F.col("__i"), "left").select("key", "id", "centre", F.coalesce("root", "id").alias("root"))
    of_centre = rows.where(F.col("id") == F.col("centre")).select(F.col("key").alias("__k"), F.col("root").alias("__r"))
    rows = materialise(rows.join(of_centre, F.col("key") == F.col("__k")).select("key", "id", (F.col("id") == F.col("centre")).alias("centre"), "root", (F.col("root") != F.col("__r")).alias("outside")), "open-rows")
    # all have met the centre; with one more document in the bucket, nothing is left
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum(F.col("outside").cast("int")).alias("o")).where("o > 0 and m > 2")
    sizes = sizes.select(F.col("key").alias("__k"), F.ceil(F.col("m") / CHUNK).cast("int").alias("__mc"), F.ceil(F.col("o") / CHUNK).cast("int").alias("__oc"))
    rows = rows.join(sizes, F.col("key") == F.col("__k"))
    inner = rows.select("key", _chunk("id", "__mc").alias("mc"), F.explode(F.sequence(F.lit(0), F.col("__oc") - 1)).alias("oc"), F.lit(False).alias("outside"), "id", "root", "centre")
    outer = rows.where("outside").select("key", F.explode(F.sequence(F.lit(0), F.col("__mc") - 1)).alias("mc"), _chunk("id", "__oc").alias("oc"), F.lit(True).alias("outside"), "id", "root", "centre")
    marks = signed.select(F.col("id").alias("__i"), "n", "marks")
    rows = inner.unionByName(outer).join(marks, F.col("id") == F.col("__i")).select("key", "mc", "oc", "outside", "id", "root", "centre", "n", "marks")
    rows = _dealt(rows, "key", "mc", "oc")
    return rows.mapInArrow(releasing(_estimated), f"a {kind}, b {kind}").distinct()


def _chunk(column: str, of: str):
    return F.pmod(F.xxhash64(column), F.col(of)).cast("int")


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *keys).sortWithinPartitions(*keys)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (host, mc, pc, partner, id, text): for each partner a host's document that it links with.

    Exact intersections of a partner with all documents of the block, by one look-up in
    their merged shingles.
    """
    hashes = WordHashes()
    for rows in _groups(batches, 3):
        partner, ids = rows["partner"].to_numpy(), rows["id"]
        texts = rows["text"].combine_chunks()
        own = np.flatnonzero(~partner)
        sets = [shingles(texts[int(k)].as_py().encode(), hashes) for k in own]
        if not sets:
            continue
        sizes, merged = np.array([len(x) for x in sets]), np.concatenate(sets)
        order = np.argsort(merged, kind="stable")
        merged, owner = merged[order], np.repeat(np.arange(len(sets)), sizes)[order]
        a, b = [], []
        for k in np.flatnonzero(partner):
            mine = shingles(texts[int(k)].as_py().encode(), hashes)
            low, high = np.searchsorted(merged, mine, "left"), np.searchsorted(merged, mine, "right")
            spans = high - low
            at = np.repeat(high - np.cumsum(spans), spans) + np.arange(spans.sum())
            both = np.bincount(owner[at], minlength=len(sets))
            linked = np.flatnonzero(100 * both >= PERCENT * (sizes + len(mine) - both))
            if len(linked):  # one link joins the components
                a.append(ids[int(own[linked[0]])].as_py())
                b.append(ids[int(k)].as_py())
        if a:
            kind = rows.schema.field("id").type
            yield pa.record_batch({"a": pa.array(a, kind), "b": pa.array(b, kind)})


def _joined(pairs: DataFrame, roots: DataFrame, texts: DataFrame, reps: DataFrame) -> DataFrame:
    """Links between the components of ``pairs``: the smaller one's documents meet the larger one's in blocks.

    A block is bounded in documents and in shingles, about.
    """
    kind = pairs.schema["a"].dataType.simpleString()
    sizes = reps.select("id", "n").join(roots.select(F.col("id").alias("__i"), "root"), F.col("id") == F.col("__i"), "left")
    sizes = sizes.groupBy(F.coalesce("root", "id").alias("root")).agg(F.struct(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("shingles")).alias("size"))
    size = lambda name: sizes.select(F.col("root").alias(f"__{name}"), F.col("size").alias(f"size_{name}"))
    sized = pairs.join(size("a"), F.col("a") == F.col("__a")).join(size("b"), F.col("b") == F.col("__b"))
    first = F.col("size_a.docs") >= F.col("size_b.docs")
    pick = lambda x, y, name: F.when(first, F.col(x)).otherwise(F.col(y)).alias(name)
    sized = materialise(sized.select(pick("a", "b", "host"), pick("b", "a", "guest"), pick("size_a", "size_b", "mine"), pick("size_b", "size_a", "other")), "open-pairs")
    parts = lambda docs, shingles: F.greatest(F.ceil(docs / BLOCK), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")
    blocks = sized.groupBy("host").agg(parts(F.max("mine.docs"), F.max("mine.shingles")).alias("__mc"), parts(F.sum("other.docs"), F.sum("other.shingles")).alias("__pc"))

    def members(of: DataFrame, column: str) -> DataFrame:
        """``of`` with the ids of the component in ``column``; one without links is its own only document."""
        known = roots.select(F.col("root").alias("__root"), F.col("id").alias("__id"))
        return of.join(known, F.col(column) == F.col("__root"), "left").withColumn("id", F.coalesce("__id", column)).drop("__root", "__id")

    hosts = members(blocks, "host").select("host", _chunk("id", "__mc").alias("mc"), F.explode(F.sequence(F.lit(0), F.col("__pc") - 1)).alias("pc"), F.lit(False).alias("partner"), "id")
    guests = members(sized.select("host", "guest"), "guest").join(blocks.withColumnRenamed("host", "__h"), F.col("host") == F.col("__h"))
    guests = guests.select("host", F.explode(F.sequence(F.lit(0), F.col("__mc") - 1)).alias("mc"), _chunk("id", "__pc").alias("pc"), F.lit(True).alias("partner"), "id")
    rows = hosts.unionByName(guests).join(texts.select(F.col("id").alias("__i"), F.coalesce("text", F.lit("")).alias("text")), F.col("id") == F.col("__i"))
    rows = _dealt(rows.select("host", "mc", "pc", "partner", "id", "text"), "host", "mc", "pc")
    return rows.mapInArrow(releasing(_met), f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id, kept (id = component_id).

    Null and blank texts have no shingles and link with nothing. Rows with a null id link
    with nothing, their component is null and they stay. An id stands for one text: rows
    that repeat it carry the same decision. Other columns are ignored, whatever their
    names. An empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = materialise(source.mapInArrow(releasing(_signed), f"id {kind}, n long, k1 long, k2 long, bands array<long>, marks binary"), "signatures")
    usable = signed.where("n > 0 and id is not null")
    classes = usable.groupBy("k1", "k2").agg(F.min("id").alias("rep")).select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), "rep")
    members = signed.select("id", "n", "k1", "k2").join(classes, (F.col("k1") == F.col("__k1")) & (F.col("k2") == F.col("__k2")) & (F.col("n") > 0) & F.col("id").isNotNull(), "left")
    members = materialise(members.select("id", "n", F.coalesce("rep", "id").alias("rep")), "classes")
    reps = usable.join(classes.select(F.col("rep").alias("__r")), F.col("id") == F.col("__r"), "left_semi").dropDuplicates(["id"])
    reps = materialise(reps.select("id", "n", "bands", "marks"), "representatives")
    rows = reps.select("id", F.explode("bands").alias("key"))
    centres = rows.groupBy("key").agg(F.min("id").alias("centre"), F.count(F.lit(1)).alias("m")).where("m > 1").select(F.col("key").alias("__k"), "centre")
    shared = materialise(rows.join(centres, F.col("key") == F.col("__k")).select("key", "id", "centre"), "buckets")
    needed = shared.select("id").distinct()
    texts = materialise(source.where(may_contain(needed)("id")), "candidates")
    stars = shared.where(F.col("id") != F.col("centre")).select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    stars = materialise(stars, "star-pairs")
    links = materialise(_confirmed(stars, texts), "star-links")
    roots = components(links)
    more = materialise(_joined(_open_components(shared, roots, reps), roots, texts, reps), "open-links")
    if not more.isEmpty():
        roots = components(links.unionByName(more))
    roots = roots.select(F.col("id").alias("__i"), "root")
    out = members.join(roots, F.col("rep") == F.col("__i"), "left")
    component = F.coalesce("root", "rep")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id").isNull() | (F.col("id") == component)).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with its columns, whatever their names: one document of each component.

    Null, empty and blank texts have no near copies and stay, as do rows without an id.
    Rows that repeat an id stand for one document, and stay or go together. Of a
    component the smallest id stays. An empty table gives no rows.
    """
    decisions = materialise(near_duplicates(docs, id_col, text_col), "near-decisions")
    return without(docs, decisions.where(~F.col("kept")).select(id_col).distinct(), id_col)
