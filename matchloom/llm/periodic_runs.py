"""Periodic runs of words, by a dictionary of basic factors.

A basic factor is a stretch of 2**k words; its name says which stretch it is, and names of
one length come from pairs of names of half that length. A factor that comes once only can
not grow into one that comes again, so that only repeated factors are named further.

At each length the successor of an occurrence is the next occurrence of its factor. Within
a window of twice that length, starts whose successors are all one period away form an
arithmetic progression, and neighbouring progressions of one period propose a run. With a
factor at least as long as the period (and less than twice as long, so that every period is
proposed at one length alone), the stretch of such starts is exact: it begins where the run
begins, and the run ends one period and one factor behind its last start. A shorter period
of the run would be a nearer successor, so the period is the smallest one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from ._common import as_bytes, releasing, slices

#: A run holds this many words, and this many periods, at least.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words that a task names together; a document is never cut.
BATCH_WORDS = 200_000

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def runs_of(names: np.ndarray, longest: int, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, ordered by start, then period.

    ``names``: numbers of words, each text followed by a number that comes nowhere else;
    ``longest``: words of the longest text.
    """
    found, pos, key, width = [], np.arange(len(names)), np.asarray(names, np.int64), 1
    while len(pos):
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        gap = np.zeros(len(pos), np.int64)
        gap[order[:-1]] = np.where(same, pos[order[1:]] - pos[order[:-1]], 0)
        near = np.flatnonzero((gap > width // 2) & (gap <= width))
        if len(near):
            start, period = pos[near], gap[near]
            cut = np.flatnonzero((np.diff(start) != 1) | (np.diff(period) != 0)) + 1
            first, last = np.r_[0, cut], np.r_[cut, len(near)] - 1
            start, length, period = start[first], start[last] - start[first] + width + period[first], period[first]
            whole = (length >= least_words) & (length >= least_periods * period)
            found.append((start[whole], length[whole], period[whole]))
        if width * least_periods > longest:  # longer periods have no room
            break
        repeated = np.zeros(len(pos), bool)
        repeated[order[1:]] |= same
        repeated[order[:-1]] |= same
        number = np.zeros(len(pos), np.int64)
        number[order] = np.cumsum(np.r_[True, ~same]) - 1
        pos, number = pos[repeated], number[repeated]
        named = np.full(len(names) + width, -1, np.int64)
        named[pos] = number
        behind = named[pos + width]
        pos, key = pos[behind >= 0], (number * (len(names) + 1) + behind)[behind >= 0]
        width *= 2
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, length, period = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _batched(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[list[bytes]]]]:
    """(ids, words of each text) of about BATCH_WORDS words."""
    ids, texts, n = [], [], 0
    for batch in slices(batches):
        for i, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
            ids.append(i)
            texts.append(text.split())  # bytes: white space is ASCII
            n += len(texts[-1]) + 1
            if n >= BATCH_WORDS:
                yield ids, texts
                ids, texts, n = [], [], 0
    if ids:
        yield ids, texts


def _detected(kind: pa.DataType, id_col: str, least_words: int, least_periods: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _batched(batches):
            known: dict[bytes, int] = {}
            sizes = np.array([len(t) for t in texts])
            ends = np.cumsum(sizes + 1) - 1
            starts = ends - sizes
            names = np.empty(ends[-1] + 1, np.int64)
            for t, a, b in zip(texts, starts.tolist(), ends.tolist(), strict=True):
                names[a:b] = [known.setdefault(w, len(known)) for w in t]
            names[ends] = len(known) + np.arange(len(ends))
            start, length, period = runs_of(names, int(sizes.max()), least_words, least_periods)
            owner = np.searchsorted(ends, start)
            # words that some run repeats
            steps = np.zeros(len(names) + 1, np.int64)
            np.add.at(steps, start + period, 1)
            np.add.at(steps, start + length, -1)
            dropped = np.cumsum(steps[:-1]) > 0
            touched = np.zeros(len(texts), bool)
            touched[owner] = True
            kept = [b" ".join(t if not touched[k] else [w for w, gone in zip(t, dropped[starts[k] : ends[k]].tolist(), strict=True) if not gone]) for k, t in enumerate(texts)]
            of_run = pa.StructArray.from_arrays([pa.array(start - starts[owner], pa.int64()), pa.array(length, pa.int64()), pa.array(period, pa.int64())], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(texts) + 1)), pa.int32()), of_run)
            yield pa.record_batch([pa.array(ids, kind), pa.array(sizes, pa.int64()), lists, pa.array(kept, pa.binary()).cast(pa.string())], names=[id_col, "n_words", "runs", "collapsed_text"])

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """Per row: id, n_words, runs (start, length, period; by start, then period), collapsed_text.

    A run is a stretch of words with smallest period q of at least ``least_words`` words and
    ``least_periods`` (3 at least) times q, that no neighbouring word extends. The collapsed text leaves
    out what a run holds behind its first q words, and has single spaces between words.
    Null, empty and blank texts have no words, no runs and an empty collapsed text. Very
    long texts are taken whole, some 100 bytes of a task's memory a word. Rows without an
    id and repeated rows are rows like any others, and each is told by its own text. Other
    columns are ignored, whatever their names. An empty table gives no rows.
    """
    if least_periods < 3:
        raise ValueError("a run of fewer than three periods may have no factor as long as its period that comes again")
    source = docs.select(id_col, text_col)
    kind = to_arrow_type(source.schema[0].dataType)
    return source.mapInArrow(releasing(_detected(kind, id_col, least_words, least_periods)), f"`{id_col}` {source.schema[0].dataType.simpleString()}, n_words bigint, runs {RUNS}, collapsed_text string")
