"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python task holds as objects at once.
SLICE_ROWS = 256

_own_folder: dict[str, str] = {}


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary folder only in plain local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = tempfile.mkdtemp(prefix="matchloom-")
    return _own_folder[app]


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder (with Parquet ``options``) and read it back, which cuts its lineage.

    The files go when the application ends (``deleteOnExit`` of Hadoop's file system).
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/matchloom/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Smaller record batches, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def give_back() -> None:
    """Hands memory that Python and Arrow have freed back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


_kept: dict[tuple[str, int], object] = {}


def of_stage(name: str, make: Callable[[], object]) -> object:
    """What ``make`` gives, made once in a worker for all tasks of a stage; what other stages have left there goes."""
    key = (name, TaskContext.get().stageId())
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, after which a worker holds none of its memory: tasks of other stages use the same workers."""

    def whole(batches: Iterator) -> Iterator:
        now = TaskContext.get().stageId()
        old = [k for k in _kept if k[1] != now]
        for key in old:
            del _kept[key]
        if old:
            give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


class BoundedWords(dict):
    """What is known of words, in bounded bytes; long words stay out.

    When it is full, the half that came first stays: words that come early are the frequent ones.
    """

    #: Bytes of an entry besides its word, about; words over ``LONG`` are not kept.
    ENTRY, LONG = 220, 64

    def __init__(self, room: int):
        super().__init__()
        self.room, self.used = room, 0

    def make_room(self) -> None:
        if self.used > self.room:
            early = dict(islice(self.items(), len(self) // 2))
            self.clear()
            self.update(early)
            self.used = sum(map(len, early)) + self.ENTRY * len(early)

    def keep_all(self, found: dict) -> None:
        """Keeps the values of words none of which is too long."""
        self.update(found)
        self.used += sum(map(len, found)) + self.ENTRY * len(found)

    def keep(self, word, value) -> None:
        """Keeps the value of a word that is not too long."""
        if len(word) <= self.LONG:
            self[word] = value
            self.used += self.ENTRY + len(word)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def crc_bucket(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id has no bucket (null)."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def hash_limit(share: float) -> int:
    """The 63-bit limit that ``drawn`` takes for this share of the ids, at any size of the table."""
    return min(2**63 - 1, int(share * 2.0**63))


def drawn(seed: str, column: Column, limit: Column) -> Column:
    """Whether the 63-bit hash of an id is within ``limit`` (see ``hash_limit``)."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), column), 1) <= limit


def hash64(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values (the public splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """64-bit hashes of words, looked up in a dictionary of bounded bytes."""

    def __init__(self, room: int = 40_000_000):
        self.known = BoundedWords(room)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            known.make_room()
        longest = 0
        for w in {w for w in words if w not in known}:
            longest = max(longest, len(w))
            known.keep(w, hash64(w))
        if longest > known.LONG:
            return np.fromiter((known[w] if w in known else hash64(w) for w in words), np.uint64, len(words))
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
