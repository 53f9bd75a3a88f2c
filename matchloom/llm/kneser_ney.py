"""Quality by an interpolated modified Kneser-Ney n-gram model of trusted text.

N-grams are of UTF-8 bytes, up to ``ORDER``, packed into one long each. Counts of the
trusted texts, continuation counts, discounts and context sums are Spark aggregates
and joins, sharded by n-gram and by context. The finished table is counted and goes to
the tasks, which score whole texts. A table over ``MODEL_ROWS`` goes in parts: each holds
all that the bytes behind some pairs of bytes need, and a text's score is the sum of its
parts, so the order and the result are the same at any size.

A document's cross-entropy is drawn towards its language's mean by ``SHRINK`` bytes'
weight, so that a few words are not condemned by chance, and is held against the
quantile of its language's trusted documents that have not trained the model.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import as_bytes, drawn, hash_limit, materialise, releasing, slices

ORDER = 5
#: Share of the trusted documents that train the model, by hash of the id; all others tell the thresholds.
LARGEST_SHARE = 0.8
#: N-grams of texts that are counted at once, and different ones that a task holds before it sends their counts.
COUNTED_AT_ONCE, HELD_GRAMS = 2_000_000, 2_000_000
#: Ids of trusted documents that may be sent to all tasks.
SENT_IDS = 200_000
#: Rows of the model that a task holds at once, about, and bytes of texts that wait for its parts.
MODEL_ROWS = 4_000_000
HELD_BYTES = 32_000_000
SHRINK = 200
QUANTILE, MARGIN = 0.995, 1.02
#: Signs of a text are its bytes plus 1, and EDGE stands before the first; n-grams are packed in BITS a sign.
EDGE, BITS = 0, 9
VOCABULARY = 256
PAIR = (1 << 2 * BITS) - 1


def packed(text: bytes, order: int) -> list[np.ndarray]:
    """For n = 1..order: the n-gram that ends at each byte of the text, edges before it."""
    out, n = [], len(text)
    x = np.full(order - 1 + n, EDGE, np.int64)
    x[order - 1 :] = np.frombuffer(text, np.uint8)
    x[order - 1 :] += 1
    gram = np.zeros(n, np.int64)
    for k in range(order):
        gram = gram + (x[order - 1 - k : order - 1 - k + n] << (BITS * k))
        out.append(gram.copy())
    return out


def _grams(order: int):
    """Texts -> n-grams with their counts, added up in a task as far as they fit."""

    def added(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        key, time = np.concatenate(keys), np.concatenate(times)
        place = np.argsort(key, kind="stable")
        key = key[place]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        return key[first], np.add.reduceat(time[place], first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, times, grams, size = [], [], [], 0
        for batch in slices(batches):
            for text in as_bytes(batch.column(0)):
                if text:
                    grams.append(packed(text, order)[order - 1])
                    size += len(text)
                if size >= COUNTED_AT_ONCE:
                    yield from count(grams, keys, times)
                    grams, size = [], 0
        if grams:
            yield from count(grams, keys, times)
        if keys:
            yield pa.record_batch({"gram": pa.array(keys[0]), "c": pa.array(times[0])})

    def count(grams: list[np.ndarray], keys: list[np.ndarray], times: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        found, n = np.unique(np.concatenate(grams), return_counts=True)
        keys[:], times[:] = ([x] for x in added([*keys, found], [*times, n.astype(np.int64)]))
        if len(keys[0]) >= HELD_GRAMS:
            yield pa.record_batch({"gram": pa.array(keys.pop()), "c": pa.array(times.pop())})

    return run


def _levels(top: DataFrame, order: int) -> dict[int, DataFrame]:
    """Counts at the top order; below, the number of different bytes before the n-gram."""
    levels = {order: top}
    for n in range(order - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << (BITS * n)) - 1))
        levels[n] = materialise(levels[n + 1].select(suffix.alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("c")), f"kn-{n}")
    return levels


def discounts(level: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of 1, 2, and 3 or more."""
    n = {r.c: r.n for r in level.where("c <= 4").groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n2, n3, n4 = (float(n.get(k, 0)) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    step = lambda k, a, b: min(float(k), max(0.05, k - (k + 1) * y * b / a)) if a else 0.5 * k
    return step(1, n1, n2), step(2, n2, n3), step(3, n3, n4)


def train(texts: DataFrame, text_col: str = "text", order: int = ORDER) -> tuple[DataFrame, int]:
    """(model rows n, gram, prob, back; order). prob: interpolated probability of the last byte.

    back: the weight that the context ``gram`` leaves to lower orders (1 if it was never
    a context). Tables meet on (context) and on (suffix).
    """
    top = materialise(texts.select(F.col(text_col)).mapInArrow(releasing(_grams(order)), "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c")), "kn-top")
    levels, probs, backs, lower = _levels(top, order), [], [], None
    for n in range(1, order + 1):
        level = levels[n]
        d1, d2, d3 = discounts(level)
        taken = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        rows = level.select("gram", "c", F.shiftright("gram", BITS).alias("context"))
        sums = rows.groupBy("context").agg(F.sum("c").alias("total"), F.sum(taken).alias("left"))
        sums = sums.select(F.col("context").alias("__context"), "total", (F.col("left") / F.col("total")).alias("back"))
        rows = rows.join(sums, F.col("context") == F.col("__context")).withColumn("own", (F.col("c") - taken) / F.col("total"))
        if lower is None:
            made = rows.select("gram", (F.col("own") + F.col("back") / VOCABULARY).alias("prob"))
        else:
            suffix = F.col("gram").bitwiseAND(F.lit((1 << (BITS * (n - 1))) - 1))
            made = rows.join(lower.select(F.col("gram").alias("__suffix"), F.col("prob").alias("__lower")), suffix == F.col("__suffix")).select("gram", (F.col("own") + F.col("back") * F.col("__lower")).alias("prob"))
        lower = materialise(made, f"kn-p{n}")
        probs.append(lower.select(F.lit(n).alias("n"), "gram", "prob"))
        backs.append(sums.select(F.lit(n - 1).alias("__n"), F.col("__context").alias("__gram"), "back"))
    table, back = probs[0], backs[0]
    for p, b in zip(probs[1:], backs[1:], strict=True):
        table, back = table.unionByName(p), back.unionByName(b)
    # a context of the text's start has no probability of its own, and still leaves weight
    both = table.join(back, (F.col("n") == F.col("__n")) & (F.col("gram") == F.col("__gram")), "full_outer")
    return both.select(F.coalesce("n", "__n").alias("n"), F.coalesce("gram", "__gram").alias("gram"), F.coalesce("prob", F.lit(0.0)).alias("prob"), F.coalesce("back", F.lit(1.0)).alias("back")), order


class Table:
    """The model as sorted arrays for each order; scores texts."""

    def __init__(self, rows: pa.Table, order: int):
        self.order, self.parts = order, {}
        n = rows["n"].to_numpy()
        for k in range(order + 1):
            hit = n == k
            gram, prob, back = (rows[c].to_numpy()[hit] for c in ("gram", "prob", "back"))
            place = np.argsort(gram)
            slots = 1 << max(4, int(2 * len(gram)).bit_length())
            self.parts[k] = (gram[place], prob[place].astype(np.float32), back[place].astype(np.float32), slots)
        self.index = None

    def _find(self, n: int, grams: np.ndarray) -> np.ndarray:
        """Row of each n-gram, -1 where there is none, by open addressing."""
        if self.index is None:
            self.index = {}
        if n not in self.index:
            gram, _, _, slots = self.parts[n]
            table = np.full(slots, -1, np.int64)
            slot = self._slot(gram, slots)
            rest = np.arange(len(gram))
            while len(rest):
                free = table[slot[rest]] < 0
                table[slot[rest[free]]] = rest[free]
                rest = rest[table[slot[rest]] != rest]
                slot[rest] = (slot[rest] + 1) % slots
            self.index[n] = table
        gram, table = self.parts[n][0], self.index[n]
        if not len(gram):
            return np.full(len(grams), -1, np.int64)
        slot = self._slot(grams, len(table))
        row = table[slot]
        other = np.flatnonzero((row >= 0) & (gram[row] != grams))
        while len(other):
            slot[other] = (slot[other] + 1) % len(table)
            row[other] = table[slot[other]]
            other = other[(row[other] >= 0) & (gram[row[other]] != grams[other])]
        return row

    @staticmethod
    def _slot(grams: np.ndarray, slots: int) -> np.ndarray:
        return ((grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (slots.bit_length() - 1))).astype(np.int64)

    def log10(self, text: bytes, part: int = 0, parts: int = 1) -> float:
        """log10 probability of the bytes of the text, interpolated down to even bytes; of one part, its bytes alone."""
        if not text:
            return 0.0
        grams = packed(text, self.order)
        prob, weight = np.ones(len(text)), np.ones(len(text))
        todo = np.arange(len(text))
        if parts > 1:
            todo = np.flatnonzero(part_of((grams[2] >> BITS) & PAIR, parts) == part)
        for n in range(self.order, 0, -1):
            row = self._find(n, grams[n - 1][todo])
            seen = row >= 0
            known = self.parts[n][1][row[seen]]
            done = known > 0
            where = todo[seen][done]
            prob[where] = known[done] * weight[where]
            left = np.ones(len(todo), bool)
            left[np.flatnonzero(seen)[done]] = False
            todo = todo[left]
            if not len(todo):
                break
            context = self._find(n - 1, grams[n - 1][todo] >> BITS)
            was = context >= 0  # a context that was never seen leaves all its weight
            weight[todo[was]] *= self.parts[n - 1][2][context[was]]
        prob[todo] = weight[todo] / VOCABULARY
        return float(np.log10(prob).sum())


def part_of(pair, parts: int):
    """Part of the model, by the two bytes before the one that is scored (array or column)."""
    return pair * 40_503 % 65_521 % parts


def _scored(sent: list, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = _table(sent[0], order) if len(sent) == 1 else None
        held, size = [], 0
        for batch in slices(batches):
            if whole is not None:
                yield _row_scores(batch, [whole.log10(t) for t in as_bytes(batch.column(1))])
                continue
            held.append(batch)
            size += batch.column(1).nbytes
            if size >= HELD_BYTES:
                yield from _by_parts(held, sent, order)
                held, size = [], 0
        if held:
            yield from _by_parts(held, sent, order)

    return run


def _table(sent, order: int) -> Table:
    return Table(pa.ipc.open_stream(sent.value).read_all(), order)


def _by_parts(held: list[pa.RecordBatch], sent: list, order: int) -> Iterator[pa.RecordBatch]:
    """The held batches scored by one part after the other; a task has one part in memory."""
    sums = [np.zeros(b.num_rows) for b in held]
    for part, rows in enumerate(sent):
        table = _table(rows, order)
        vars(rows).pop("_value", None)  # else the worker keeps every part that it has read
        for batch, total in zip(held, sums, strict=True):
            total += [table.log10(t, part, len(sent)) for t in as_bytes(batch.column(1))]
    for batch, total in zip(held, sums, strict=True):
        yield _row_scores(batch, total)


def _row_scores(batch: pa.RecordBatch, scores) -> pa.RecordBatch:
    return pa.record_batch([batch.column(0), pa.array([len(t) for t in as_bytes(batch.column(1))], pa.int64()), pa.array(scores, pa.float64())], names=[batch.schema.names[0], "n_bytes", "log10_prob"])


def _arrow(model: DataFrame) -> bytes:
    rows = model.toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def fit(trusted: DataFrame, text_col: str = "text", order: int = ORDER) -> tuple[bytes, int]:
    """The whole model as Arrow bytes, and its order."""
    return _arrow(train(trusted, text_col, order)[0]), order


def fit_parts(trusted: DataFrame, text_col: str = "text", order: int = ORDER) -> tuple[list, int]:
    """The model as broadcasts of about MODEL_ROWS rows, sent one by one, and its order (3 at least).

    A part has the n-grams whose last byte follows one of its pairs, the contexts that end
    in such a pair, and all n-grams of up to two bytes.
    """
    model = materialise(train(trusted, text_col, order)[0], "kn-model")
    rows, context = model.count(), model.sparkSession.sparkContext
    if rows <= MODEL_ROWS:
        return [context.broadcast(_arrow(model))], order
    parts = -(-2 * rows // MODEL_ROWS)  # a row may stand in two parts
    pair = lambda gram: gram.bitwiseAND(F.lit(PAIR))
    scored, ends = part_of(pair(F.shiftright("gram", BITS)), parts), part_of(pair(F.col("gram")), parts)
    return [context.broadcast(_arrow(model.where((F.col("n") <= 2) | (scored == k) | ((ends == k) & (F.col("n") < order))))) for k in range(parts)], order


def log_probabilities(docs: DataFrame, model: tuple[list, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, log10_prob of the whole text."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(releasing(_scored(*model)), f"`{id_col}` {kind}, n_bytes long, log10_prob double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_trusted: int | None = None, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """Per row: id, lang, trusted, n_bytes, log10_prob, perplexity (a byte), entropy, threshold, kept.

    Trusted: labelled with quality 1 and not toxic. Every trusted document is used: four in
    five, by hash of the id, train the model, and means and thresholds come from all others
    (from all trusted ones if none is outside). A caller may have about ``max_trusted`` train.
    Null and empty texts have perplexity null and are not kept. A language (null included)
    without such documents takes the threshold over those of all languages; without any,
    every text with a byte is kept. Of equal texts all have the same verdict. Rows
    that repeat an id carry one row each. Other columns are ignored.
    """
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select(F.col(id_col).alias("__good")).distinct()
    n_good = good.count()
    limit = hash_limit(LARGEST_SHARE if max_trusted is None else min(LARGEST_SHARE, max_trusted / max(1, n_good)))
    sent = F.broadcast(good) if n_good <= SENT_IDS else good
    taught = docs.where(drawn("kn", F.col(id_col), F.lit(limit))).select(id_col, text_col).join(sent, F.col(id_col) == F.col("__good"), "left_semi")
    model = fit_parts(taught, text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    packed_id = rows.select(F.struct("id", "lang").alias("k"), "text")
    scored = log_probabilities(packed_id, model, "k", "text").select("k.id", "k.lang", "n_bytes", "log10_prob")
    scored = materialise(scored.join(good, F.col("id") == F.col("__good"), "left").withColumn("trusted", F.col("__good").isNotNull()).drop("__good"), "kn-scores")
    tells = F.col("trusted") & (F.col("n_bytes") > 0)
    outside = tells & ~drawn("kn", F.col("id"), F.lit(limit))
    if not scored.where(outside).isEmpty():
        tells = outside
    means = scored.where(tells).groupBy("lang").agg((-F.sum("log10_prob") / F.sum("n_bytes")).alias("__mean")).withColumnRenamed("lang", "__l")
    overall = scored.where(tells).agg((-F.sum("log10_prob") / F.sum("n_bytes"))).first()[0] or 0.0
    pulled = scored.join(means, F.col("lang").eqNullSafe(F.col("__l")), "left").withColumn("__mean", F.coalesce("__mean", F.lit(overall)))
    pulled = pulled.withColumn("entropy", (-F.col("log10_prob") + SHRINK * F.col("__mean")) / (F.col("n_bytes") + SHRINK)).drop("__l", "__mean")
    cut = F.percentile_approx("entropy", quantile, 10_000)
    trusted = pulled.where(tells)
    limits = trusted.groupBy("lang").agg((cut * margin).alias("__limit")).withColumnRenamed("lang", "__l")
    all_limit = trusted.agg(cut * margin).first()[0]
    out = pulled.join(limits, F.col("lang").eqNullSafe(F.col("__l")), "left").withColumn("threshold", F.coalesce("__limit", F.lit(all_limit).cast("double")))
    perplexity = F.when(F.col("n_bytes") > 0, F.pow(F.lit(10.0), -F.col("log10_prob") / F.col("n_bytes")))
    kept = (F.col("n_bytes") > 0) & (F.col("threshold").isNull() | (F.col("entropy") <= F.col("threshold")))
    return out.select(F.col("id").alias(id_col), F.col("lang").alias(lang_col), "trusted", "n_bytes", "log10_prob", perplexity.alias("perplexity"), "entropy", "threshold", kept.alias("kept"))
