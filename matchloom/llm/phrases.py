"""Phrases that hold together, counted by an FM-index over word ids for every shard.

A shard is some words of one language from one task's documents, cut between pieces only.
Its two indexes are Burrows-Wheeler transforms of the word ids, one over what follows a
place and one over what comes before it, both sorted to ``DEPTH`` words. A phrase is an
interval in each. The symbols of an interval of one index are the words by which the
phrase grows on one side, with their counts: the interval of the grown phrase follows by
the last-to-first mapping in that index, and in the other from the counts of the smaller
symbols. Shards are written once; counts of their phrases are summed in Spark.

A phrase is as frequent as its parts at most. So words that are frequent in all shards
together are told to the shards before they count pairs, and so on from length to
length: by a Bloom filter of at most ``FILTER_MB``, whose wrong passes cost rows but
change no count. A longer phrase must grow from a pair (or triple) on its left as well
as on its right, which is the same interval reached from both sides.

Most pairs of frequent words are rare. So pairs are first counted together in slots, by
their hash; a slot has its pairs' counts added up, so a pair in a slot below ``least`` is
rare for certain. Only the others shuffle, and are counted one by one.

Phrases that shuffle go by groups, told by the hash of all their words but the last. A
task adds up what its shards count and sends a row for each language of a group: the
words of its phrases once, the phrases as numbers of these words, and their counts.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import as_bytes, materialise, mix64, releasing, slices
from .exact_dedup import SEGMENT_BITS, _positions
from .id_filter import _bits

DEPTH, LEAST, LONGER_PERCENT, TOP = 4, 30, 80, 2000
#: Words of a shard, bytes of a text that are cut into words at once (at a piece's end), and rows of a batch of counts.
SHARD_WORDS, TEXT_BYTES, OUT_ROWS = 1 << 19, 1 << 19, 1 << 15
#: Rows of an index that are grown together, but for an interval with more.
ROWS = 1 << 17
FILTER_MB = 64
#: Slots with counts that a task holds before it sends them.
HELD_SLOTS = 1 << 21
#: Phrases with counts that a task holds before it sends or adds them up; groups of phrases, at least; words of all shards for a group.
HELD_PHRASES, GROUPS, GROUP_WORDS = 1 << 21, 64, 1 << 25

#: Byte translation: A-Z to lower case, what ends a piece to a line feed, a tab to a space.
_PLAIN = bytes(10 if c in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_TOKENS = re.compile(rb"[^ \n]+|\n")


def _parts_of(text: bytes) -> Iterator[list[bytes]]:
    """Words of the text, with a line feed at the end of each piece, in lists of bounded size that end with a piece."""
    plain, at = text.translate(_PLAIN) + b"\n", 0
    while at < len(plain):
        stop = plain.find(b"\n", at + TEXT_BYTES) + 1 or len(plain)
        yield _TOKENS.findall(plain[at:stop])
        at = stop


class Index:
    """One direction of the FM-index: symbols beside the rows, first rows of the words, last-to-first mapping."""

    def __init__(self, beside: np.ndarray, starts: np.ndarray):
        self.beside, self.starts = beside, starts
        order = np.argsort(beside, kind="stable")
        self.mapped = np.empty(len(beside), np.int32)
        self.mapped[order] = np.arange(len(beside), dtype=np.int32)

    def grown(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of all intervals and the symbols in them: interval, symbol, count, count of smaller symbols, first row mapped."""
        size = high - low
        owner = np.repeat(np.arange(len(low)), size)
        row = np.arange(len(owner)) + np.repeat(low - np.cumsum(size) + size, size)
        key = owner * np.int64(len(self.starts)) + self.beside[row]
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.r_[first, len(key)])
        interval, symbol = np.divmod(key[first], len(self.starts))
        return interval, symbol, count, first - (np.cumsum(size) - size)[interval], self.mapped[row[order[first]]].astype(np.int64)


def _sorted_rows(ids: np.ndarray) -> np.ndarray:
    """Places in the order of the ``DEPTH`` = 4 symbols from them on, around the end."""
    pair = ids * np.int64(ids.max() + 1) + np.roll(ids, -1)
    _, pair = np.unique(pair, return_inverse=True)
    return np.argsort(pair * np.int64(pair.max() + 1) + np.roll(pair, -2))


def transforms(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols before the sorted places, and behind the places sorted by what comes before them."""
    ids = ids.astype(np.int64)
    backward = ids[::-1]
    return tuple(x[_sorted_rows(x) - 1].astype(np.int32) for x in (ids, backward))


def _packed(symbols: np.ndarray, level: int = 9) -> pa.Array:
    """Bytes of one significance stand together, which packs them better."""
    planes = symbols.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return pa.array([pa.Codec("zstd", compression_level=level).compress(planes, asbytes=True)], pa.binary())


def _unpacked(cell: pa.Scalar, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(cell.as_buffer(), decompressed_size=4 * n, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<i4").ravel()


def _sharded(shard_words: int):
    """(lang, text) -> shards: words, their counts, both transforms. Symbol 0 ends a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, defaultdict] = {}
        held: dict[str, list[np.ndarray]] = {}
        sizes: dict[str, int] = defaultdict(int)

        def shard(lang: str) -> pa.RecordBatch:
            own, ids = numbers.pop(lang), np.concatenate(held.pop(lang))
            del sizes[lang]
            counts = np.bincount(ids, minlength=len(own))
            before, behind = transforms(ids)
            words = pa.array(list(own), pa.binary()).cast(pa.string())
            lists = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            return pa.record_batch([pa.array([lang]), pa.array([len(ids) - int(counts[0])], pa.int64()), lists(words), lists(pa.array(counts, pa.int64())), _packed(before), _packed(behind)], names=["lang", "n", "words", "counts", "before", "behind"])

        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                for tokens in _parts_of(text):
                    if lang not in numbers:
                        own = numbers[lang] = defaultdict()
                        own.default_factory = own.__len__
                        own[b"\n"], held[lang] = 0, []
                    ids = np.fromiter(map(numbers[lang].__getitem__, tokens), np.int32, len(tokens))
                    held[lang].append(ids)
                    sizes[lang] += len(ids)
                    if sizes[lang] >= shard_words:
                        yield shard(lang)
        for lang in list(held):
            yield shard(lang)

    return run


SHARD = "lang string, n bigint, words array<string>, counts array<bigint>, before binary, behind binary"


def shards(docs: DataFrame, lang_col: str, text_col: str, shard_words: int = SHARD_WORDS) -> DataFrame:
    source = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")), F.coalesce(text_col, F.lit("")))
    return materialise(source.mapInArrow(releasing(_sharded(shard_words)), SHARD), "phrase-shards", compression="zstd")


def _word_hashes(words: list[bytes], langs: list[str]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    seeds = {lang: xxh64_intdigest(lang.encode()) for lang in set(langs)}
    return np.fromiter((xxh64_intdigest(w, seeds[x]) for w, x in zip(words, langs, strict=True)), np.uint64, len(words))


def _folded_keys(hashes: list[np.ndarray]) -> np.ndarray:
    """A phrase's key in a filter, from those of its words in order."""
    key = hashes[0]
    for h in hashes[1:]:
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + h)
    return key


def _phrase_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, phrase) of one number of words -> key."""
    for batch in slices(batches, OUT_ROWS):
        langs, words = batch.column(0).to_pylist(), [p.split(b" ") for p in as_bytes(batch.column(1))]
        columns = [_word_hashes(list(w), langs) for w in zip(*words, strict=True)]
        yield pa.record_batch({"key": pa.array(_folded_keys(columns).view(np.int64) if columns else [], pa.int64())})


def _passing(hashes: list[np.ndarray], sent: tuple) -> np.ndarray:
    """Which phrases the filter has, from the hashes of their words."""
    bits, has = sent[1], sent[0].value
    hit = [(has[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 for p in _positions(_folded_keys(hashes), bits)]
    return (hit[0] & hit[1]).astype(bool)


def _joined(words: pa.Array, lang: str, columns: list[np.ndarray]) -> pa.Array:
    """Language and phrase as one text, with a tab between them: no word holds one."""
    first = pc.binary_join_element_wise(pa.scalar(lang), words.take(pa.array(columns[0])), "\t")
    return pc.binary_join_element_wise(first, *(words.take(pa.array(c)) for c in columns[1:]), " ")


class Grown:
    """Phrases of a shard: their words, and their intervals in both indexes."""

    def __init__(self, words: list[np.ndarray], low: np.ndarray, back_low: np.ndarray, count: np.ndarray):
        self.words, self.low, self.back_low, self.count = words, low, back_low, count

    def where(self, keep: np.ndarray) -> Grown:
        return Grown([w[keep] for w in self.words], self.low[keep], self.back_low[keep], self.count[keep])

    def parts(self) -> Iterator[Grown]:
        """Some phrases at a time, with about ROWS rows of an index."""
        ends = np.cumsum(self.count)
        cuts = np.unique(np.searchsorted(ends, np.arange(ROWS, (ends[-1] if len(ends) else 0) + ROWS, ROWS), "right"))
        for a, b in zip([0, *cuts], [*cuts, len(ends)], strict=True):
            if a < b:
                yield self.where(np.s_[a:b])

    @classmethod
    def together(cls, parts: list[Grown], size: int) -> Grown:
        one = lambda xs: np.concatenate([np.zeros(0, np.int64), *xs])
        return cls([one(p.words[k] for p in parts) for k in range(size)], *(one(getattr(p, name) for p in parts) for name in ("low", "back_low", "count")))

    def rightwards(self, backward: Index) -> Grown:
        """Phrases with each word that follows them; pieces end them."""
        of, symbol, count, smaller, mapped = backward.grown(self.back_low, self.back_low + self.count)
        return Grown([*(w[of] for w in self.words), symbol], self.low[of] + smaller, mapped, count).where(symbol > 0)

    def leftwards(self, forward: Index) -> np.ndarray:
        """First rows, in the forward index, of the phrases with each word before them."""
        _, symbol, _, _, mapped = forward.grown(self.low, self.low + self.count)
        return mapped[symbol > 0]


def _added(columns: list[np.ndarray], count: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows of the columns in order, each once, and the sums of their counts."""
    if not len(count):
        return columns, count
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    first = np.flatnonzero(np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns])])
    return [c[first] for c in columns], np.add.reduceat(count[order], first)


class Tally:
    """Phrases of one language with their counts; words have numbers in the order in which they come."""

    def __init__(self, size: int):
        self.number: defaultdict = defaultdict()
        self.number.default_factory = self.number.__len__
        self.columns, self.counts, self.held, self.summed = [[] for _ in range(size)], [], 0, 0

    def add(self, words: list[bytes], columns: list[np.ndarray], counts: np.ndarray) -> None:
        """Counts of phrases whose columns are places in ``words``."""
        own = np.fromiter(map(self.number.__getitem__, words), np.int32, len(words))
        for held, column in zip(self.columns, columns, strict=True):
            held.append(own[column])
        self.counts.append(counts.astype(np.int64))
        self.held += len(counts)

    def sums(self) -> tuple[list[np.ndarray], np.ndarray]:
        one = lambda xs, kind: np.concatenate([np.zeros(0, kind), *xs])
        columns, counts = _added([one(c, np.int32) for c in self.columns], one(self.counts, np.int64))
        self.columns, self.counts, self.held = [[c] for c in columns], [counts], len(counts)
        self.summed = len(counts)
        return columns, counts


GROUP = "grp bigint, lang string, n bigint, texts binary, ids array<binary>, times binary"


def _sent_groups(tallies: dict[str, Tally], groups: int) -> Iterator[pa.RecordBatch]:
    """What a task holds as a row for each group and language."""
    for lang, tally in tallies.items():
        columns, counts = tally.sums()
        words = list(tally.number)
        hashes = _word_hashes(words, [lang] * len(words))
        group = (_folded_keys([hashes[c] for c in columns[:-1]]) % np.uint64(groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        cuts = np.flatnonzero(np.diff(group[order])) + 1
        for some in np.split(order, cuts) if len(order) else []:
            used, ids = np.unique(np.stack([c[some] for c in columns]), return_inverse=True)
            ids = [_packed(x, 1)[0].as_py() for x in ids.reshape(len(columns), -1)]
            texts = pa.Codec("zstd", compression_level=1).compress(b" ".join(words[k] for k in used), asbytes=True)
            size = sum(len(words[k]) + 1 for k in used) - 1
            row = [[int(group[some[0]])], [lang], [len(some)], [size.to_bytes(8, "little") + texts], [ids], [_packed(counts[some], 1)[0].as_py()]]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.binary()]
            yield pa.record_batch([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=["grp", "lang", "n", "texts", "ids", "times"])


def _grouped(size: int, groups: int, opened, phrases_of):
    """Shards -> their phrases of ``size`` words with counts, added up, in rows for groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies: dict[str, Tally] = {}
        words = 0
        for batch in slices(batches, 1):
            shard = opened(batch)
            words += shard.n
            for found in phrases_of(shard, batch):
                if len(found.count):
                    used, places = np.unique(np.stack(found.words), return_inverse=True)
                    tallies.setdefault(shard.lang, Tally(size)).add(as_bytes(shard.words.take(pa.array(used))), list(places.reshape(size, -1)), found.count)
            # counts are sent in 32 bits
            if sum(t.held for t in tallies.values()) >= HELD_PHRASES or words >= 1 << 30:
                yield from _sent_groups(tallies, groups)
                tallies, words = {}, 0
        yield from _sent_groups(tallies, groups)

    return run


def _totals(size: int, least: int):
    """All rows of a group stand in one task: phrases that come ``least`` times or more, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies: dict[str, Tally] = {}
        for batch in batches:
            for row in slices(iter([batch]), 1):
                lang, n, cell = row["lang"][0].as_py(), row["n"][0].as_py(), row["texts"][0].as_py()
                words = bytes(pa.decompress(cell[8:], decompressed_size=int.from_bytes(cell[:8], "little"), codec="zstd", asbytes=True)).split(b" ")
                tally = tallies.setdefault(lang, Tally(size))
                tally.add(words, [_unpacked(x, n) for x in row["ids"][0].values], _unpacked(row["times"][0], n))
                if tally.held - tally.summed >= HELD_PHRASES:
                    tally.sums()
        for lang, tally in tallies.items():
            columns, counts = tally.sums()
            words, often = pa.array(list(tally.number), pa.binary()).cast(pa.string()), np.flatnonzero(counts >= least)
            for at in range(0, len(often), OUT_ROWS):
                some = often[at : at + OUT_ROWS]
                yield pa.record_batch({"key": _joined(words, lang, [c[some] for c in columns]), "a": pa.array(counts[some], pa.int64())})

    return run


class Opened:
    """A shard with the hashes of its words, and which of them are frequent."""

    def __init__(self, batch: pa.RecordBatch, sent: tuple):
        self.lang, self.words = batch["lang"][0].as_py(), batch["words"][0].values
        self.counts = batch["counts"][0].values.to_numpy()
        self.starts, self.n = np.cumsum(self.counts) - self.counts, int(self.counts.sum())
        self.backward = Index(_unpacked(batch["behind"][0], self.n), self.starts)
        some = (as_bytes(self.words.slice(at, OUT_ROWS)) for at in range(0, len(self.words), OUT_ROWS))
        self.hashes = np.concatenate([np.zeros(0, np.uint64), *(_word_hashes(words, [self.lang] * len(words)) for words in some)])
        self.known = _passing([self.hashes], sent)
        self.known[0] = False

    def hashes_of(self, found: Grown) -> list[np.ndarray]:
        return [self.hashes[w] for w in found.words]

    def pairs(self) -> Iterator[Grown]:
        """Pairs of frequent words, some at a time; no pair comes twice."""
        own = np.flatnonzero(self.known)
        for part in Grown([own], self.starts[own], self.starts[own], self.counts[own]).parts():
            pairs = part.rightwards(self.backward)
            yield pairs.where(self.known[pairs.words[1]])


def _slots_of(hashes: list[np.ndarray], slots: int) -> np.ndarray:
    return (_folded_keys(hashes) & np.uint64(slots - 1)).astype(np.int64)


def _tallied(sent: tuple, slots: int, least: int):
    """Shards -> counts of their pairs, added up in slots to ``least`` at most: segment, slots that count, gaps, counts."""

    def added(at: list[np.ndarray], times: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        slot, times = np.concatenate(at), np.concatenate(times)
        order = np.argsort(slot)
        slot, times = slot[order], times[order]
        first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        times, slot = np.minimum(np.add.reduceat(times, first), least), slot[first]
        segment = slot // SEGMENT_BITS
        starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        for a, b in zip(starts, [*starts[1:], len(slot)], strict=True):
            gaps = np.diff(slot[a:b] % SEGMENT_BITS, prepend=0)
            yield pa.record_batch([pa.array([segment[a]], pa.int64()), pa.array([b - a], pa.int64()), _packed(gaps, 1), _packed(times[a:b], 1)], names=["segment", "n", "gaps", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, times, held = [], [], 0
        for batch in slices(batches, 1):
            shard = Opened(batch, sent)
            for pairs in shard.pairs():
                if len(pairs.count):
                    at.append(_slots_of(shard.hashes_of(pairs), slots).astype(np.int32))
                    times.append(np.minimum(pairs.count, least).astype(np.int64))
                    held += len(pairs.count)
            if held >= HELD_SLOTS:
                yield from added(at, times)
                at, times, held = [], [], 0
        if held:
            yield from added(at, times)

    return run


def _reached(least: int):
    """All of a segment's rows stand in one task: bits of the slots whose counts reach ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                segment, n = batch["segment"][row].as_py(), batch["n"][row].as_py()
                seen = counters.setdefault(segment, np.zeros(SEGMENT_BITS, np.int32))
                at = np.cumsum(_unpacked(batch["gaps"][row], n))
                seen[at] = np.minimum(seen[at] + _unpacked(batch["times"][row], n), least)
        for segment, seen in counters.items():
            yield pa.record_batch({"segment": pa.array([segment], pa.int64()), "bits": pa.array([np.packbits(seen >= least).tobytes()], pa.binary())})

    return run


def _frequent_slots(shards: DataFrame, sent: tuple, least: int, filter_mb: int) -> tuple:
    """A broadcast bit for each slot, set where the pairs of the slot come ``least`` times or more, and the number of slots.

    There is about a slot for each word of all shards, up to ``filter_mb``; beyond, more
    rare pairs share a frequent slot and shuffle, and the counts stay exact.
    """
    words = shards.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    slots = max(SEGMENT_BITS, min(1 << int(words).bit_length(), 1 << ((filter_mb << 23).bit_length() - 1)))
    tallied = shards.drop("before").mapInArrow(releasing(_tallied(sent, slots, least)), "segment bigint, n bigint, gaps binary, times binary")
    merged = tallied.repartition(slots // SEGMENT_BITS, "segment").mapInArrow(_reached(least), "segment bigint, bits binary")
    whole = np.zeros(slots // 8, np.uint8)
    for segment, part in merged.collect():  # the filter's own bytes, filter_mb at most
        whole[segment * SEGMENT_BITS // 8 :][: SEGMENT_BITS // 8] = np.frombuffer(part, np.uint8)
    return shards.sparkSession.sparkContext.broadcast(whole), slots


def _pairs_in(often: tuple):
    """Pairs of frequent words in frequent slots."""

    def phrases_of(shard: Opened, batch: pa.RecordBatch) -> Iterator[Grown]:
        bits, slots = often[0].value, often[1]
        for pairs in shard.pairs():
            at = _slots_of(shard.hashes_of(pairs), slots)
            yield pairs.where(((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool))

    return phrases_of


def _longer_in(filters: list[tuple]):
    """Phrases of one word more than the filters tell of (words; pairs; ...)."""

    def phrases_of(shard: Opened, batch: pa.RecordBatch) -> Iterator[Grown]:
        found = Grown.together([pairs.where(_passing(shard.hashes_of(pairs), filters[1])) for pairs in shard.pairs()], 2)
        forward = Index(_unpacked(batch["before"][0], shard.n), shard.starts)
        for size in range(3, len(filters) + 2):
            ended = np.concatenate([np.zeros(0, np.int64), *(part.leftwards(forward) for part in found.parts())])
            longer = Grown.together([part.rightwards(shard.backward) for part in found.parts()], size)
            found = longer.where(np.isin(longer.low, ended))
            if size <= len(filters):
                found = found.where(_passing(shard.hashes_of(found), filters[size - 1]))
        yield found

    return phrases_of


def _opener(sent: tuple):
    return lambda batch: Opened(batch, sent)


def _sent(frequent: DataFrame, filter_mb: int) -> tuple:
    """A broadcast filter of phrases of one number of words, bounded in bytes, and its number of bits."""
    keys = frequent.select("lang", "phrase").mapInArrow(releasing(_phrase_keys), "key bigint")
    whole, bits = _bits(keys, frequent.count(), filter_mb)
    return frequent.sparkSession.sparkContext.broadcast(whole), bits


def frequent_phrases(shards: DataFrame, least: int = LEAST, filter_mb: int = FILTER_MB) -> DataFrame:
    """(lang, phrase, a, size) of all phrases of 1 to ``DEPTH`` words that come ``least`` times or more."""

    def enough(total: DataFrame, size: int) -> DataFrame:
        total = total.withColumn("phrase", F.substring_index("key", "\t", -1))
        lang = F.expr("substring(key, 1, char_length(key) - char_length(phrase) - 1)")
        return materialise(total.select(lang.alias("lang"), "phrase", "a", F.lit(size).alias("size")), f"phrases-of-{size}")

    each = shards.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).where(F.col("w.words") != "\n")
    words = each.select(F.concat("lang", F.lit("\t"), "w.words").alias("key"), F.col("w.counts").alias("a"))
    found = [enough(words.groupBy("key").agg(F.sum("a").alias("a")).where(F.col("a") >= least), 1)]
    groups = max(GROUPS, shards.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // GROUP_WORDS)
    filters = []
    for size in range(2, DEPTH + 1):
        filters.append(_sent(found[-1], filter_mb))
        if size == 2:
            often = _frequent_slots(shards, filters[0], least, filter_mb)
            source, phrases_of = shards.drop("before"), _pairs_in(often)
        else:
            source, phrases_of = shards, _longer_in(list(filters))
        rows = source.mapInArrow(releasing(_grouped(size, groups, _opener(filters[0]), phrases_of)), GROUP)
        found.append(enough(rows.repartition(groups, "grp").mapInArrow(releasing(_totals(size, least)), "key string, a bigint"), size))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, longer_percent: int = LONGER_PERCENT, top: int = TOP, filter_mb: int = FILTER_MB, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Per language the ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    ``a``: times that the phrase comes, overlaps included, never over the end of a piece;
    ``l``, ``r``: those of its parts at the cut that scores lowest, 2,000,000 * a / (l + r),
    rounded down (ties: fewest words on the left); ``n``: all words of the language. A phrase
    inside a longer candidate that comes ``longer_percent`` % as often or more is dropped.
    Higher scores come first, then a, then the phrase's bytes.

    A null language is ``und``. Null, empty and blank texts have no words. Repeated rows
    count again. Very long texts are taken whole, in parts that end with a piece. Other
    columns are ignored, whatever their names. An empty table gives no rows.
    """
    made = shards(docs, lang_col, text_col, shard_words)
    counts = materialise(frequent_phrases(made, least, filter_mb), "phrase-counts")
    candidates = counts.where("size > 1")
    cuts = candidates.withColumn("w", F.split("phrase", " ")).select("lang", "phrase", "a", "w", F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.expr("slice(w, 1, k)"), " ").alias("first"), F.array_join(F.expr("slice(w, k + 1, size(w))"), " ").alias("rest"))
    side = lambda key, value: counts.select(F.col("lang").alias(f"__{key}"), F.col("phrase").alias(f"_{key}"), F.col("a").alias(value))
    for key, value in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(side(key, value), (F.col("lang") == F.col(f"__{key}")) & (F.col(key) == F.col(f"_{key}"))).drop(f"__{key}", f"_{key}")
    score = F.expr("(cast(a as decimal(19, 0)) * 2000000BD) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))")
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "l", "r", "a")).alias("cut")).select("lang", "phrase", "cut.*")
    # a phrase inside a longer one is inside one of a word more, which comes as often or more
    ends = counts.where("size > 2").withColumn("w", F.split("phrase", " "))
    ends = ends.select("lang", "a", F.explode(F.array(F.array_join(F.expr("slice(w, 1, size - 1)"), " "), F.array_join(F.expr("slice(w, 2, size - 1)"), " "))).alias("part"))
    longest = ends.groupBy("lang", "part").agg(F.max("a").alias("most")).select(F.col("lang").alias("__l"), "part", "most")
    kept = best.join(longest, (F.col("lang") == F.col("__l")) & (F.col("phrase") == F.col("part")), "left")
    kept = kept.where(F.expr(f"most is null or cast(most as decimal(19, 0)) * 100 < cast(a as decimal(19, 0)) * {longer_percent}"))
    totals = made.groupBy("lang").agg(F.sum("n").alias("n")).select(F.col("lang").alias("__t"), "n")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.select("lang", "phrase", "a", "l", "r", "score", F.row_number().over(order).cast("long").alias("rank")).where(F.col("rank") <= top)
    return ranked.join(totals, F.col("lang") == F.col("__t")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
