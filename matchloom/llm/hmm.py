"""A hidden Markov language model: Baum-Welch over the corpus, scaled forward scoring.

Words are emitted in two steps: a state emits a class, and the class emits the word by
its smoothed share of the class. The ``TOP`` most frequent words and the end are classes
of their own, other words share classes by a hash of their last letters, so the number
of parameters is fixed while word counts cover the whole training corpus:

    P(word | state) = P(class | state) * (c + 1) / (N_class + V_class + 1)

(1 for a class of one word). Documents are encoded once, in bundles of about
``BUNDLE_TOKENS`` tokens with the bundle's own word list. Word counts are joined back
to the bundles' lists, not to every token. Baum-Welch passes over
all training documents ``PASSES`` times; expected counts are added up across partitions,
a fixed number of values each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import as_bytes, crc_bucket, hash64, materialise, releasing, slices

STATES = 8
TOP = 2048
SHARED = 2048
END = TOP + SHARED
CLASSES = END + 1
BUNDLE_TOKENS, BUNDLE_DOCS = 2_000_000, 8192
PASSES = 8
#: Tokens whose forward values are held for the backward pass.
HELD_TOKENS = 200_000
#: Longer sequences keep their forward values at every so many symbols, and make the others again.
STRETCH = 50_000
#: Forward values are scaled at every so many steps: 8 emissions and transitions stay far above the least double.
SCALED = 8
SMOOTH = 0.01


def suffix_class(word: bytes) -> int:
    """Class of a word that is not frequent: by its last three bytes and whether it is long."""
    return TOP + zlib.crc32(word[-3:] + (b"+" if len(word) > 6 else b"-")) % SHARED


def _bundled(batches: Iterator[pa.RecordBatch], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    place: dict[bytes, int] = {}
    ids, held, lengths, tokens, size, count = [], [], [], [], 0, 0
    task = TaskContext.get().partitionId()

    def flush() -> pa.RecordBatch:
        words, n = list(place), len(place)
        own = [t for t, h in zip(tokens, held, strict=True) if not h]
        taught = np.bincount(np.frombuffer(b"".join(own), np.uint32), minlength=n).astype(np.int64)
        row = {
            "bundle": pa.array([(task << 24) + count], pa.int64()),
            "words": _one(np.fromiter(map(hash64, words), np.uint64, n).view(np.int64)),
            "classes": _one(np.fromiter(map(suffix_class, words), np.int16, n)),
            "taught": _one(taught),
            "ids": pa.array([ids], pa.list_(id_type)),
            "held": pa.array([held], pa.list_(pa.bool_())),
            "lengths": pa.array([lengths], pa.list_(pa.int64())),
            "tokens": pa.array([zlib.compress(b"".join(tokens), 1)], pa.binary()),
        }
        return pa.record_batch(row)

    for batch in slices(batches):
        for key, out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), strict=True):
            words = text.lower().split()
            for w in set(words).difference(place):
                place[w] = len(place)
            ids.append(key)
            held.append(bool(out))
            lengths.append(len(words))
            tokens.append(np.fromiter(map(place.__getitem__, words), np.uint32, len(words)).tobytes())
            size += len(words)
            if size >= BUNDLE_TOKENS or len(ids) >= BUNDLE_DOCS:
                yield flush()
                place, ids, held, lengths, tokens, size, count = {}, [], [], [], [], 0, count + 1
    if ids:
        yield flush()


def _one(values: np.ndarray) -> pa.Array:
    """A list column with the one row ``values``."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))


class Bundle:
    """Documents of a bundle as one sequence of word numbers."""

    def __init__(self, batch: pa.RecordBatch):
        get = lambda name: batch.column(batch.schema.get_field_index(name))[0].values
        self.ids, self.held = get("ids"), get("held").to_numpy(zero_copy_only=False).astype(bool)
        self.lengths, self.own = get("lengths").to_numpy(), get("classes").to_numpy().astype(np.int32)
        self.tokens = np.frombuffer(zlib.decompress(batch.column(batch.schema.get_field_index("tokens"))[0].as_py()), np.uint32)
        self.starts = np.r_[0, np.cumsum(self.lengths)[:-1]].astype(np.int64)

    def with_own_classes(self, words: np.ndarray, top: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The class of each word number; frequent words (sorted hashes, classes) have their own."""
        keys, value = top
        if not len(keys):
            return self.own
        k = np.minimum(np.searchsorted(keys, words), len(keys) - 1)
        return np.where(keys[k] == words, value[k], self.own)

    def sequences(self, classes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbols, starts, lengths) of documents with their ends, in the given order."""
        lengths = self.lengths[docs] + 1
        starts = np.r_[0, np.cumsum(lengths)[:-1]].astype(np.int64)
        symbols = np.full(int(lengths.sum()), END, np.int32)
        mapped = classes[self.tokens] if len(self.tokens) else np.zeros(0, np.int32)
        for at, n, d in zip(starts.tolist(), lengths.tolist(), self.starts[docs].tolist(), strict=True):
            symbols[at : at + n - 1] = mapped[d : d + n - 1]
        return symbols, starts, lengths


class Steps:
    """Sequences, longest first, laid out by step: the symbols at step t stand side by side."""

    def __init__(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        longest = int(lengths[0]) if len(lengths) else 0
        self.alive = np.searchsorted(-lengths, -np.arange(1, longest + 1), side="right")
        self.offsets = np.r_[0, np.cumsum(self.alive)].astype(np.int64)
        step = np.repeat(np.arange(longest), self.alive)
        who = np.arange(len(step)) - self.offsets[step]
        self.symbols = symbols[starts[who] + step].astype(np.intp)
        #: place of each sequence's last symbol
        self.ends = self.offsets[lengths - 1] + np.arange(len(lengths))

    def before(self) -> np.ndarray:
        """Place of the symbol before each one that is behind the first step."""
        return np.arange(len(self.ends), len(self.symbols)) - np.repeat(self.alive[:-1], self.alive[1:])


class Hmm:
    """start: S, move: S x S, emit: S x CLASSES; rows add up to 1."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def from_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Hmm:
        norm = lambda x, a: (x + a) / (x + a).sum(axis=-1, keepdims=True)
        return cls(norm(start, SMOOTH), norm(move, SMOOTH), norm(emit, SMOOTH))

    @classmethod
    def first(cls, totals: np.ndarray, states: int = STATES, seed: int = 1) -> Hmm:
        """Class shares, moved a little for each state; states like to stay."""
        rng = np.random.Generator(np.random.PCG64(seed))
        emit = (totals + 1.0) * rng.uniform(0.5, 1.5, (states, len(totals)))
        return cls.from_counts(np.ones(states), np.ones((states, states)) + 2 * np.eye(states), emit)

    def forward(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log10 likelihood of each sequence; sequences stand longest first. Exact for any length."""
        return self._alphas(Steps(symbols, starts, lengths))[0]

    def _alphas(self, steps: Steps) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(log10 likelihoods, forward values, their sums at the ends, emissions); scaled values have scaled emissions."""
        weight = np.ascontiguousarray(self.emit.T)[steps.symbols]
        values, out, at = np.empty_like(weight), np.zeros(len(steps.ends)), steps.offsets.tolist()
        moved, ones = np.empty((len(steps.ends), len(self.start))), np.ones(len(self.start))
        for t, (a, b) in enumerate(zip(at, at[1:], strict=False)):
            own, n = values[a:b], b - a
            np.multiply(weight[a:b], np.matmul(last[:n], self.move, out=moved[:n]) if t else self.start, out=own)
            if t % SCALED == SCALED - 1:
                total = own @ ones
                own /= total[:, None]
                weight[a:b] /= total[:, None]
                out[:n] += np.log10(total)
            last = own
        ends = values[steps.ends] @ ones
        return out + np.log10(ends), values, ends, weight

    def expected(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Baum-Welch counts (start, move, emit) and log10 likelihood of the sequences."""
        steps = Steps(symbols, starts, lengths)
        likelihood, alpha, ends, weight = self._alphas(steps)
        beta, at, back = np.empty_like(alpha), steps.offsets.tolist(), self.move.T.copy()
        beta[steps.ends] = 1 / ends[:, None]  # so that a symbol's states add up to 1
        for p, a, b in zip(at[-3::-1], at[-2::-1], at[::-1], strict=False):
            own = weight[a:b]
            own *= beta[a:b]  # emission times what follows
            np.matmul(own, back, out=beta[p : p + b - a])
        first = len(starts)
        move = alpha[steps.before()].T @ weight[first:]
        alpha *= beta
        out = np.stack([np.bincount(steps.symbols, weights=row, minlength=CLASSES) for row in alpha.T.copy()])
        return alpha[:first].sum(axis=0), move * self.move, out, float(likelihood.sum())

    def expected_long(self, symbols: np.ndarray, stretch: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """``expected`` of one sequence of any length: forward values are kept at the ends of stretches only."""
        emit, back, states = np.ascontiguousarray(self.emit.T), self.move.T.copy(), len(self.start)
        entry, likelihood = [], 0.0  # what each stretch begins with: the forward values of the symbol before
        alpha = None
        for at in range(0, len(symbols), stretch):
            entry.append(alpha)
            values, scales = self._stretch(emit, symbols[at : at + stretch], alpha)
            alpha, likelihood = values[-1], likelihood + float(np.log10(scales).sum())
        move, out, beta = np.zeros((states, states)), np.zeros((states, CLASSES)), np.ones(states)
        for k in range(len(entry) - 1, -1, -1):
            own = symbols[k * stretch : (k + 1) * stretch]
            values, scales = self._stretch(emit, own, entry[k])
            weight, betas = emit[own] / scales[:, None], np.empty_like(values)
            for t in range(len(own) - 1, -1, -1):
                betas[t] = beta
                weight[t] *= beta
                beta = weight[t] @ back
            move += values[:-1].T @ weight[1:]
            if entry[k] is not None:
                move += np.outer(entry[k], weight[0])
            gamma = values * betas
            gamma /= gamma.sum(axis=1, keepdims=True)
            out += np.stack([np.bincount(own, weights=gamma[:, s], minlength=CLASSES) for s in range(states)])
        return gamma[0], move * self.move, out, likelihood

    def _stretch(self, emit: np.ndarray, symbols: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Scaled forward values and scales of symbols that follow the values ``before``."""
        values, scales = emit[symbols], np.empty(len(symbols))
        prior = self.start if before is None else before @ self.move
        for t in range(len(symbols)):
            own = values[t]
            own *= prior
            scales[t] = own.sum()
            own /= scales[t]
            prior = own @ self.move
        return values, scales


def _parts(lengths: np.ndarray, most: int) -> Iterator[slice]:
    """Runs of sequences with about ``most`` symbols."""
    at = 0
    while at < len(lengths):
        end = at + max(1, int(np.searchsorted(np.cumsum(lengths[at:]), most, side="right")))
        yield slice(at, end)
        at = end


def _taught(sent):
    """Expected counts of all bundles of a task, as one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, top = sent.value
        total, likelihood = None, 0.0
        for batch in slices(batches, 1):
            bundle = Bundle(batch)
            docs = np.flatnonzero(~bundle.held)
            docs = docs[np.argsort(-bundle.lengths[docs], kind="stable")]
            if not len(docs):
                continue
            symbols, starts, lengths = bundle.sequences(bundle.with_own_classes(batch.column(0)[0].values.to_numpy(), top), docs)
            long = int(np.searchsorted(-lengths, -STRETCH))  # longest first
            found = [model.expected_long(symbols[at : at + n], STRETCH) for at, n in zip(starts[:long].tolist(), lengths[:long].tolist(), strict=True)]
            starts, lengths = starts[long:], lengths[long:]
            for part in _parts(lengths, HELD_TOKENS):
                found.append(model.expected(*_gathered(symbols, starts[part], lengths[part])))
            for *counts, more in found:
                total = counts if total is None else [a + b for a, b in zip(total, counts, strict=True)]
                likelihood += more
        if total is not None:
            start, move, emit = total
            yield pa.record_batch({"likelihood": pa.array([likelihood]), "counts": pa.array([np.concatenate([start, move.ravel(), emit.ravel()]).tolist()], pa.list_(pa.float64()))})

    return run


def _gathered(symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sequences side by side in an array of their own."""
    at = np.r_[0, np.cumsum(lengths)[:-1]].astype(np.int64)
    out = np.empty(int(lengths.sum()), symbols.dtype)
    for a, s, n in zip(at.tolist(), starts.tolist(), lengths.tolist(), strict=True):
        out[a : a + n] = symbols[s : s + n]
    return out, at, lengths


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of the count rows of a task."""
    total, likelihood = None, 0.0
    for batch in batches:
        for row in range(batch.num_rows):
            own = batch.column(1)[row].values.to_numpy(zero_copy_only=False)
            total = own if total is None else total + own
            likelihood += batch.column(0)[row].as_py()
    if total is not None:
        yield pa.record_batch({"likelihood": pa.array([likelihood]), "counts": pa.array([total.tolist()], pa.list_(pa.float64()))})


def _pass(bundles: DataFrame, model: Hmm, top: tuple[np.ndarray, np.ndarray]) -> tuple[Hmm, float]:
    """One expectation and maximisation step; the driver gets one row of fixed width a group of tasks."""
    sent = bundles.sparkSession.sparkContext.broadcast((model, top))
    schema = "likelihood double, counts array<double>"
    parts = bundles.select("words", "classes", "ids", "held", "lengths", "tokens").mapInArrow(releasing(_taught(sent)), schema)
    n = parts.rdd.getNumPartitions()
    while n > 16:  # adds up in a tree, so that no task takes all
        n = -(-n // 8)
        parts = parts.repartition(n).mapInArrow(_added, schema)
    rows = parts.collect()
    sent.unpersist()
    if not rows:
        return model, 0.0
    total = np.sum([r.counts for r in rows], axis=0)
    s = len(model.start)
    return Hmm.from_counts(total[:s], total[s : s + s * s].reshape(s, s), total[s + s * s :].reshape(s, -1)), sum(r.likelihood for r in rows)


def _final(sent, id_type: pa.DataType, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, n_class, v_class, n_all, v_all, (keys, own_class, own_count) = sent.value
        for batch in slices(batches, 1):
            bundle = Bundle(batch)
            classes, counts = bundle.own.copy(), np.zeros(len(bundle.own), np.int64)
            seen = batch.column(batch.schema.get_field_index("seen"))[0].as_py() or b""
            seen = np.frombuffer(seen, np.int64).reshape(2, -1)
            counts[seen[0]] = seen[1]
            words = batch.column(batch.schema.get_field_index("words"))[0].values.to_numpy()
            if len(keys):
                k = np.minimum(np.searchsorted(keys, words), len(keys) - 1)
                top = np.flatnonzero(keys[k] == words)
                counts[top], classes[top] = own_count[k[top]], own_class[k[top]]
            base = np.log10((counts + 1) / (n_all + v_all + 1))
            inner = np.where(classes < TOP, 0.0, np.log10((counts + 1) / (n_class[classes] + v_class[classes] + 1)))
            order = np.argsort(-bundle.lengths, kind="stable")
            symbols, starts, lengths = bundle.sequences(classes, order)
            score = np.zeros(len(order))
            for part in _parts(lengths, HELD_TOKENS):
                score[order[part]] = model.forward(symbols, starts[part], lengths[part])
            add = lambda values: np.add.reduceat(np.r_[values[bundle.tokens], 0.0], np.minimum(bundle.starts, len(bundle.tokens))) * (bundle.lengths > 0)
            end = np.log10((n_class[END] + 1) / (n_all + v_all + 1))
            known = add((counts > 0).astype(np.float64)).astype(np.int64) + int(n_class[END] > 0)
            yield pa.record_batch([bundle.ids.cast(id_type), pa.array(bundle.held), pa.array(bundle.lengths + 1), pa.array(known), pa.array(add(base) + end), pa.array(score + add(inner))], names=[name, "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out=None, states: int = STATES) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from rows that are not held out (default: crc32 of the id as text, modulo 7, is
    2; a null id teaches). Null and empty texts are the end token alone. With no training
    rows, N and V are 0 and scores are those of the even first model. Rows that repeat an
    id carry one row each; other columns are ignored. An empty table gives no rows.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType
    name = kind.simpleString()
    out = F.coalesce(crc_bucket(id_col, 7) == 2, F.lit(False)) if held_out is None else held_out
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)
    source = docs.select(F.col(id_col), out.alias("held"), F.col(text_col))
    schema = f"bundle long, words array<long>, classes array<smallint>, taught array<long>, ids array<{name}>, held array<boolean>, lengths array<long>, tokens binary"
    bundles = materialise(source.mapInArrow(releasing(lambda b: _bundled(b, arrow)), schema), "hmm-bundles")

    entries = bundles.select("bundle", F.posexplode(F.arrays_zip("words", "classes", "taught")).alias("pos", "e"))
    entries = entries.select("bundle", "pos", F.col("e.words").alias("word"), F.col("e.classes").alias("cls"), F.col("e.taught").alias("n"))
    counts = materialise(entries.where("n > 0").groupBy("word").agg(F.sum("n").alias("c"), F.first("cls").alias("cls")), "hmm-counts")
    frequent = [(r.word, r.c) for r in counts.orderBy(F.desc("c"), "word").limit(TOP).collect()]
    best = [w for w, _ in frequent]
    tops = spark.createDataFrame([(w, k) for k, w in enumerate(best)], "word long, own int")
    counts = materialise(counts.join(F.broadcast(tops), "word", "left").select("word", "c", F.coalesce("own", F.col("cls").cast("int")).alias("cls")), "hmm-classes")
    taught = bundles.select(F.explode("held").alias("h")).where("NOT h").count()

    n_class, v_class = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counts.groupBy("cls").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():  # at most CLASSES rows
        n_class[r.cls], v_class[r.cls] = r.n, r.v
    n_class[END], v_class[END] = taught, float(taught > 0)
    n_all, v_all = int(n_class.sum()), int(v_class.sum())

    model = Hmm.first(n_class, states)
    order = np.argsort(np.array(best, np.int64))
    top = (np.array(best, np.int64)[order], order.astype(np.int32))
    top_counts = np.array([c for _, c in frequent], np.int64)[order]
    for _ in range(PASSES):
        model, _likelihood = _pass(bundles, model, top)

    # counts of the frequent words are sent; a bundle's other words meet theirs
    rest = counts.where(F.col("cls") >= TOP).select(F.col("word").alias("__w"), "c")
    own = entries.select("bundle", "pos", "word").join(F.broadcast(tops.select(F.col("word").alias("__top"))), F.col("word") == F.col("__top"), "left_anti")
    seen = own.join(rest, F.col("word") == F.col("__w")).select("bundle", "pos", "c")
    seen = seen.groupBy("bundle").agg(F.collect_list(F.struct("pos", "c")).alias("own")).mapInArrow(_seen_bytes, "bundle long, seen binary")
    rows = bundles.join(seen.select(F.col("bundle").alias("__b"), "seen"), F.col("bundle") == F.col("__b"), "left").select("words", "classes", "ids", "held", "lengths", "tokens", "seen")
    sent = spark.sparkContext.broadcast((model, n_class, v_class, n_all, v_all, (*top, top_counts)))
    scored = rows.mapInArrow(releasing(_final(sent, arrow, id_col)), f"`{id_col}` {name}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(n_all).cast("long")).select(id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def _seen_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word numbers and counts of each bundle as bytes."""
    for batch in slices(batches, 1):
        own = batch.column(1)[0].values
        pair = np.stack([own.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("pos", "c")])
        yield pa.record_batch([batch.column(0), pa.array([pair.tobytes()], pa.binary())], names=["bundle", "seen"])
