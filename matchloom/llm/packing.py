"""Best-fit packing by minimum bin slack.

The fill of a bin depends on lengths alone, and there are at most ``capacity`` of
them. So Spark counts the pieces of each length, and minimum bin slack runs on that
table: the largest length left opens a bin, a bitset subset-sum over the lengths left
finds the fullest feasible combination, and as many bins as the counts allow take it.
Each combination uses up a length (almost), so there are a few thousand combinations
for any corpus. Pieces then get their rank among the pieces of their length, from a
rank inside (length, bucket) and the counts of the buckets before, and a rank tells
the bin and the place in it.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import BoundedWords, materialise, of_stage, releasing, slices

CAPACITY = 4096
END_ID = 1
ROWS_PER_BUCKET = 50_000
#: Bytes of words, and of words without the signs behind them, whose ids a worker keeps for a stage, about.
WORDS_ROOM, CORES_ROOM, TAILS_ROOM = 75_000_000, 60_000_000, 2_000_000


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordIds:
    """Token ids of texts, word by word.

    The tokenizer drops white space and never joins across it, so a text's ids are
    those of its parts between spaces, tabs and line ends, which are looked up once. A
    part of plain letters with signs behind has two pre-tokens, which are known apart.
    What is kept is bounded in bytes; long parts, such as lines without spaces, are
    encoded where they stand.
    """

    #: Signs that form one pre-token; the apostrophe starts contractions and is not here.
    SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.known, self.cores, self.tails = BoundedWords(WORDS_ROOM), BoundedWords(CORES_ROOM), BoundedWords(TAILS_ROOM)

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        parts = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        for cache in (self.known, self.cores, self.tails):
            cache.make_room()
        new = set()
        for p in parts:
            new.update(p)
        self._learn([w for w in new.difference(self.known) if len(w) <= BoundedWords.LONG])
        out = []
        for p in parts:
            try:
                out.append(b"".join(map(self.known.__getitem__, p)))
            except KeyError:
                out.append(b"".join(self._ids(w) if len(w) > BoundedWords.LONG else self.known[w] for w in p))
        return out

    def _learn(self, words: list[str]) -> None:
        cores, tails, signs = self.cores, self.tails, self.SIGNS
        parts = [(w, w.rstrip(signs)) for w in words]
        # letters below U+0130 keep their number in lower case and are in normal form
        self._encode([c for c in {c for _, c in parts if c not in cores} if c.isalpha() and max(c) < "\u0130"])
        found = {}
        for w, core in parts:
            ids = cores.get(core)
            if ids is None:
                found[w] = self._ids(w)
            elif len(core) == len(w):
                found[w] = ids
            else:
                end = w[len(core) :]
                found[w] = ids + (tails[end] if end in tails else self._tail(end))
        self.known.keep_all(found)

    def _encode(self, new: list[str]) -> None:
        """Ids of many words of letters at once; each is one pre-token of the joined text."""
        for at in range(0, len(new), 1000):
            part = new[at : at + 1000]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ends = np.searchsorted(np.array(found.word_ids), np.arange(len(part)), side="right") * 4
            ids, start, own = np.array(found.ids, "<u4").tobytes(), 0, {}
            for c, end in zip(part, ends.tolist(), strict=True):
                own[c] = ids[start:end]
                start = end
            self.cores.keep_all(own)

    def _tail(self, signs: str) -> bytes:
        ids = self._ids(signs)
        self.tails.keep(signs, ids)
        return ids

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = of_stage(path, lambda: WordIds(path))
        last = np.array([END_ID], "<u4").tobytes()
        for batch in slices(batches):
            keys, rows = batch.column(0), []
            for k, own in enumerate(ids([x or "" for x in batch.column(1).to_pylist()])):
                own += last
                rows += [(k, i, i * capacity, min(capacity, len(own) // 4 - i * capacity), zlib.crc32(own[4 * i * capacity : 4 * (i + 1) * capacity])) for i in range(-(-len(own) // (4 * capacity)))]
            k, *rest = (pa.array(c, pa.int64()) for c in zip(*rows, strict=True)) if rows else (pa.array([], pa.int64()),) * 5
            piece, start, length, crc = rest
            yield pa.record_batch([keys.take(k), piece.cast(pa.int32()), start, length, crc], names=[batch.schema.names[0], "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32. Only longer documents are cut."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(releasing(_pieces(tokenizer_path, capacity)), f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


def fullest(room: int, counts: dict[int, int]) -> list[int]:
    """Lengths, with repeats within ``counts``, whose sum is the largest that ``room`` holds.

    Bit s of the set is on when some combination has the sum s; a length's copies are
    added in powers of two, and the sets before each step give the combination back.
    """
    mask, sums, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room and counts[x] > 0), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left > 0:
            take = min(take, left)
            steps.append((length, take, sums))
            sums |= (sums << (length * take)) & mask
            left, take = left - take, take * 2
        if sums >> room & 1:
            break
    best, out = sums.bit_length() - 1, []
    for length, take, before in reversed(steps):
        if not before >> best & 1:
            out += [length] * take
            best -= length * take
    return out


def minimum_bin_slack(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """Combinations in order: (how many bins take it, lengths in the bin)."""
    counts, plan = {k: v for k, v in counts.items() if v > 0}, []
    while counts:
        top = max(counts)
        counts[top] -= 1
        bin_ = [top, *fullest(capacity - top, counts)]
        counts[top] += 1
        uses = {x: bin_.count(x) for x in bin_}
        times = min(counts[x] // n for x, n in uses.items())
        for x, n in uses.items():
            counts[x] -= times * n
            if not counts[x]:
                del counts[x]
        plan.append((times, bin_))
    return plan


def _intervals(plan: list[tuple[int, list[int]]]) -> tuple[np.ndarray, ...]:
    """Rank intervals of each length: key (length, first rank), first bin, uses a bin, place of the first use."""
    used: dict[int, int] = {}
    rows, bins = [], 0
    for times, lengths in plan:
        place = 0
        for length in dict.fromkeys(lengths):
            n = lengths.count(length)
            rows.append(((length << 48) + used.get(length, 0), bins, n, place))
            used[length] = used.get(length, 0) + times * n
            place += n * length
        bins += times
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 4


def _placed(sent, at_length: int, at_rank: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first, uses, place = sent.value
        for batch in batches:
            length = batch.column(at_length).to_numpy(zero_copy_only=False)
            rank = batch.column(at_rank).to_numpy(zero_copy_only=False)
            k = np.searchsorted(keys, (length << 48) + rank, side="right") - 1
            own = rank - (keys[k] & ((1 << 48) - 1))
            columns = [c for i, c in enumerate(batch.columns) if i != at_rank]
            names = [c for i, c in enumerate(batch.schema.names) if i != at_rank]
            yield pa.record_batch([*columns, pa.array(first[k] + own // uses[k]), pa.array(place[k] + own % uses[k] * length)], names=[*names, "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` with sequence_id and offset; its ``length`` is 1 to ``capacity``.

    Sequences are gapless from 0 and hold at most ``capacity``. ``order`` breaks ties
    between equal lengths; rows equal in it too may swap places. An empty table gives
    no rows.
    """
    spark, rows = pieces.sparkSession, pieces.count()
    buckets = max(1, -(-rows // ROWS_PER_BUCKET))
    bucketed = pieces.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sizes = materialise(bucketed.groupBy("length", "__bucket").agg(F.count(F.lit(1)).alias("__n")), "pack-counts")
    counts = {r.length: r.n for r in sizes.groupBy("length").agg(F.sum("__n").alias("n")).collect()}  # at most ``capacity`` rows
    sent = spark.sparkContext.broadcast(_intervals(minimum_bin_slack(counts, capacity)))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col("length").alias("__l"), F.col("__bucket").alias("__b"), before.alias("__before"))
    rank = F.row_number().over(Window.partitionBy("length", "__bucket").orderBy(*order)) - 1
    ranked = bucketed.withColumn("__rank", rank.cast("long")).join(starts, (F.col("length") == F.col("__l")) & (F.col("__bucket") == F.col("__b")))
    ranked = ranked.select(*pieces.columns, (F.col("__rank") + F.col("__before")).alias("__rank"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, `offset` long"
    return ranked.mapInArrow(_placed(sent, ranked.columns.index("length"), ranked.columns.index("__rank")), schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece: the end id alone. Rows that repeat an id are
    packed as often. Other columns are ignored, whatever their names.
    """
    pieces = materialise(token_pieces(docs, tokenizer_path, capacity, id_col, text_col), "pack-pieces")
    return pack(pieces, capacity, (id_col, "piece"))
