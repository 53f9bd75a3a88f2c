"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word
(with the vocabulary's word-start mark) has the probability of all its segmentations
into pieces, summed by a forward algorithm; a text has the product over its words.
Piece probabilities come from expectation-maximisation over the same segmentations.

The model is fitted on a bounded sample of labelled documents (``MAX_DOCS`` a
language, by hash of the id); every word of every text is scored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from math import exp, inf, log, log1p

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SLICE_ROWS, BoundedWords, crc_bucket, drawn, hash_limit, mix64, releasing, slices

#: Labelled documents that the fit takes for each language, about.
MAX_DOCS = 1500
ROUNDS = 3
#: Words up to this long go through the forward algorithm together.
SHORT = 40
#: Bytes of words whose scores a task keeps, about.
WORDS_ROOM = 40_000_000
#: Probability of a character that no piece covers, and the weight of unseen pieces.
UNKNOWN, PRIOR = 1e-7, 0.05
#: Per-character factor that keeps forward sums of short words in range.
SCALE = 8.0
START = "▁"
LETTER = regex.compile(r"\p{L}")


class Vocabulary:
    """Pieces of a SentencePiece model and their prefixes, in a hash table by characters."""

    SLOTS = 1 << 20

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.ids = {p: i for i, p in enumerate(pieces) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
        self.size, self.longest = len(pieces), max(map(len, self.ids))
        starts: dict[str, int] = {}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                starts.setdefault(p[:k], -1)
            starts[p] = i
        self.keys, self.at = np.zeros(self.SLOTS, np.uint64), np.full(self.SLOTS, -1, np.int32)
        for n in sorted({len(p) for p in starts}):
            same = [p for p in starts if len(p) == n]
            h = np.zeros(len(same), np.uint64)
            for column in _codes(same).T:
                h = self._step(h, column)
            for key, p in zip(h.tolist(), same, strict=True):
                slot = key % self.SLOTS
                while self.keys[slot]:
                    slot = (slot + 1) % self.SLOTS
                self.keys[slot], self.at[slot] = key, starts[p]

    @staticmethod
    def _step(h: np.ndarray, code: np.ndarray) -> np.ndarray:
        return mix64(h * np.uint64(0x100000001B3) + code.astype(np.uint64) + np.uint64(1))

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts some piece, piece id or -1) of each hash."""
        slot = (h % np.uint64(self.SLOTS)).astype(np.int64)
        key = self.keys[slot]
        other = np.flatnonzero((key != h) & (key != 0))
        while len(other):
            slot[other] = (slot[other] + 1) % self.SLOTS
            key[other] = self.keys[slot[other]]
            other = other[(key[other] != h[other]) & (key[other] != 0)]
        found = key == h
        return found, np.where(found, self.at[slot], -1)


def _codes(words: list[str]) -> np.ndarray:
    """Words of one length as a matrix of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def _piece_spans(codes: np.ndarray, vocabulary: Vocabulary) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """spans[i][l-1] = (words, pieces): words with a piece of length l at i. Piece -1: an uncovered character."""
    n, out = codes.shape[1], []
    for i in range(n):
        who, h, row = np.arange(len(codes)), np.zeros(len(codes), np.uint64), []
        for j in range(i, n):
            h = Vocabulary._step(h, codes[who, j])
            starts, piece = vocabulary.look_up(h)
            hit = piece >= 0
            if j == i:
                row.append((who, piece))
            else:
                row.append((who[hit], piece[hit]))
            who, h = who[starts], h[starts]
            if not len(who):
                break
        out.append(row)
    return out


def _weights(pieces: np.ndarray, probs: np.ndarray, length: int) -> np.ndarray:
    """Piece probabilities times SCALE ** length."""
    out = probs[pieces]
    if length == 1:
        out[pieces < 0] = UNKNOWN
    return out * SCALE**length


def _forward(spans: list, words: int, probs: np.ndarray) -> list[np.ndarray]:
    """alpha[i]: sums over segmentations of the first i characters, times SCALE ** i, words x languages."""
    n = len(spans)
    alpha = [np.zeros((words, probs.shape[1])) for _ in range(n + 1)]
    alpha[0] += 1.0
    for i, row in enumerate(spans):
        for k, (who, piece) in enumerate(row, 1):
            alpha[i + k][who] += alpha[i][who] * _weights(piece, probs, k)
    return alpha


def _backward(spans: list, words: int, probs: np.ndarray) -> list[np.ndarray]:
    n = len(spans)
    beta = [np.zeros((words, probs.shape[1])) for _ in range(n + 1)]
    beta[n] += 1.0
    for i in range(n - 1, -1, -1):
        for k, (who, piece) in enumerate(spans[i], 1):
            beta[i][who] += beta[i + k][who] * _weights(piece, probs, k)
    return beta


def _long_word(word: str, vocabulary: Vocabulary, probs: np.ndarray) -> np.ndarray:
    """The forward algorithm on one word of any length, rescaled at every character."""
    n, longest = len(word), vocabulary.longest
    window, scale = [np.ones(probs.shape[1])], np.zeros(probs.shape[1])
    for j in range(1, n + 1):
        now = np.zeros(probs.shape[1])
        for k in range(1, min(j, longest) + 1):
            piece = vocabulary.ids.get(word[j - k : j])
            if piece is not None:
                now += window[-k] * probs[piece]
            elif k == 1:
                now += window[-1] * UNKNOWN
        scale += np.log(now)
        window = [w / now for w in window[1 - longest :]] + [np.ones(probs.shape[1])]
    return scale


def _long_expected(lang: int, word: str, times: int, vocabulary: Vocabulary, probs: np.ndarray, out: np.ndarray) -> None:
    """Adds the expected piece uses of one word of any length; sums over segmentations are kept as logarithms."""
    n, ids, own = len(word), vocabulary.ids, probs[:, lang]

    def spans(i: int) -> list[tuple[int, int, float]]:
        """(end, piece, log probability) of the pieces that start at i; piece -1: an uncovered character."""
        found = [(j, p, log(own[p])) for j in range(i + 1, min(n, i + vocabulary.longest) + 1) if (p := ids.get(word[i:j])) is not None and own[p] > 0]
        return found if word[i] in ids else [(i + 1, -1, log(UNKNOWN)), *found]

    before, after = array("d", [-inf]) * (n + 1), array("d", [-inf]) * (n + 1)
    before[0] = after[n] = 0.0
    for i in range(n):
        for j, _, p in spans(i):
            before[j] = _log_sum(before[j], before[i] + p)
    for i in range(n - 1, -1, -1):
        for j, piece, p in spans(i):
            after[i] = _log_sum(after[i], after[j] + p)
            if piece >= 0:
                out[piece, lang] += times * exp(before[i] + p + after[j] - before[n])


def _log_sum(a: float, b: float) -> float:
    """Logarithm of the sum of two numbers given as logarithms."""
    if a < b:
        a, b = b, a
    return a if b == -inf else a + log1p(exp(b - a))


def word_scores(words: list[str], vocabulary: Vocabulary, probs: np.ndarray) -> np.ndarray:
    """Natural log probability of each word, with the start mark before it, under each language."""
    words = [START + w for w in words]
    out = np.zeros((len(words), probs.shape[1]))
    by_length: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        by_length.setdefault(len(w), []).append(k)
    for n, where in by_length.items():
        if n > SHORT:
            for k in where:
                out[k] = _long_word(words[k], vocabulary, probs)
            continue
        for at in range(0, len(where), 20_000):
            part = where[at : at + 20_000]
            alpha = _forward(_piece_spans(_codes([words[k] for k in part]), vocabulary), len(part), probs)
            out[part] = np.log(np.maximum(alpha[n], 1e-300)) - n * np.log(SCALE)
    return out


def _words(text: str) -> list[str]:
    return text.lower().split()


def expected_counts(counts: list[tuple[int, str, int]], vocabulary: Vocabulary, probs: np.ndarray) -> np.ndarray:
    """Expectation step: for each language, expected piece uses over its (language, word, times)."""
    out = np.zeros_like(probs)
    by_length: dict[int, list] = {}
    for row in counts:
        if len(row[1]) > SHORT:
            _long_expected(*row, vocabulary, probs, out)
        else:
            by_length.setdefault(len(row[1]), []).append(row)
    for rows in by_length.values():
        for at in range(0, len(rows), 10_000):
            part = rows[at : at + 10_000]
            lang, times = np.array([r[0] for r in part]), np.array([r[2] for r in part], float)
            spans = _piece_spans(_codes([r[1] for r in part]), vocabulary)
            alpha, beta = _forward(spans, len(part), probs), _backward(spans, len(part), probs)
            weight = times / np.maximum(alpha[-1][np.arange(len(part)), lang], 1e-300)
            for i, row in enumerate(spans):
                for k, (who, piece) in enumerate(row, 1):
                    hit = piece >= 0
                    w, p, g = who[hit], piece[hit], lang[who[hit]]
                    np.add.at(out, (p, g), alpha[i][w, g] * probs[p, g] * SCALE**k * beta[i + k][w, g] * weight[w])
    return out


def normalised(expected: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    probs = np.zeros_like(expected)
    use = np.array(sorted(vocabulary.ids.values()))
    probs[use] = expected[use] + PRIOR
    return probs / probs.sum(axis=0)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from collections import Counter

    counts: Counter = Counter()
    for batch in slices(batches):
        for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts.update((lang, START + w) for w in _words(text or ""))
    rows = list(counts.items())
    yield pa.record_batch({"lang": pa.array([k[0] for k, _ in rows], pa.string()), "word": pa.array([k[1] for k, _ in rows], pa.string()), "times": pa.array([n for _, n in rows], pa.int64())})


def _expectations(sent, langs: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, probs = sent.value
        vocabulary, place = Vocabulary(path), {x: k for k, x in enumerate(langs)}
        total = np.zeros_like(probs)
        for batch in slices(batches, 50_000):
            rows = [(place[lang], w, n) for lang, w, n in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            total += expected_counts(rows, vocabulary, probs)
        piece, lang = np.nonzero(total)
        yield pa.record_batch({"piece": pa.array(piece.astype(np.int64)), "lang": pa.array(lang.astype(np.int64)), "uses": pa.array(total[piece, lang])})

    return run


class Model:
    """langs, piece probabilities (pieces x languages) and log priors."""

    def __init__(self, path: str, langs: list[str], probs: np.ndarray):
        self.path, self.langs, self.probs = path, langs, probs


def fit(labelled: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_DOCS, rounds: int = ROUNDS) -> Model:
    """Expectation-maximisation of the piece probabilities on the bounded sample.

    Word counts and expectations are made in Spark; the driver gets one number per piece
    and language in a round, which vocabulary and languages bound.
    """
    labelled = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().collect()}
    langs = sorted(sizes)
    vocabulary = Vocabulary(vocabulary_path)
    if not langs:
        return Model(vocabulary_path, [], np.zeros((vocabulary.size, 0)))
    limit = F.coalesce(*[F.when(F.col(lang_col) == x, F.lit(hash_limit(max_docs / n))) for x, n in sizes.items()])
    sample = labelled.where(drawn("lang", F.col(id_col), limit))
    counts = sample.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(releasing(_word_counts), "lang string, word string, times long")
    counts = counts.groupBy("lang", "word").agg(F.sum("times").alias("times")).repartition("word").persist()
    probs = np.repeat(normalised(np.ones((vocabulary.size, 1)), vocabulary), len(langs), axis=1)
    for _ in range(rounds):
        sent = labelled.sparkSession.sparkContext.broadcast((vocabulary_path, probs))
        uses = counts.mapInArrow(releasing(_expectations(sent, langs)), "piece long, lang long, uses double").groupBy("piece", "lang").agg(F.sum("uses").alias("uses")).collect()
        expected = np.zeros_like(probs)
        for piece, lang, n in uses:
            expected[piece, lang] = n
        probs = normalised(expected, vocabulary)
        sent.unpersist()
    counts.unpersist()
    return Model(vocabulary_path, langs, probs)


class Scorer:
    """Scores texts; keeps the scores of words, in bounded bytes."""

    def __init__(self, model: Model):
        self.model, self.vocabulary = model, Vocabulary(model.path)
        self.place = BoundedWords(WORDS_ROOM)
        self.scores = np.zeros((0, len(model.langs)), np.float32)

    def _learn(self, words: set[str]) -> None:
        self.place.make_room()
        self.scores = self.scores[: len(self.place)]  # the words that stay came first
        new = sorted(w for w in words if len(w) <= BoundedWords.LONG and w not in self.place)
        if new:
            for row, w in enumerate(new, len(self.scores)):
                self.place.keep(w, row)
            self.scores = np.vstack([self.scores, word_scores(new, self.vocabulary, self.model.probs).astype(np.float32)])

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        words = [_words(t) if t and LETTER.search(t) and self.model.langs else [] for t in texts]
        every = {w for own in words for w in own}
        self._learn(every)
        long = [w for w in every if len(w) > BoundedWords.LONG]
        beside = dict(zip(long, word_scores(long, self.vocabulary, self.model.probs), strict=True)) if long else {}
        out = []
        for own in words:
            if not own:
                out.append(("und", 0.0))
                continue
            kept = [w for w in own if w not in beside] if beside else own
            total = self.scores[np.fromiter(map(self.place.__getitem__, kept), np.int64, len(kept))].sum(axis=0, dtype=np.float64)
            if len(kept) < len(own):
                total = total + sum(beside[w] for w in own if w in beside)
            best = int(np.argmax(total))
            out.append((self.model.langs[best], float(1 / np.exp(total - total[best]).sum())))
        return out


def _predictions(sent, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in slices(batches):
            found = scorer(batch.column(1).to_pylist())
            yield pa.record_batch([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[name, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, lang_pred, score (posterior under even priors).

    ``und`` with score 0 where the text is null, has no letter, or the model has no
    language. Of equal scores the first language in order wins. Repeated rows stay.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double"
    return docs.select(id_col, text_col).mapInArrow(releasing(_predictions(sent, id_col)), schema)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(crc_bucket(id_col, 4) == 2, F.lit(False))


def identify(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fit on the rows that are not held out, predict all: id, held_out, lang_pred, score."""
    model = fit(docs.where(~held_out(id_col)), vocabulary_path, id_col, text_col, lang_col)
    return predict(docs, model, id_col, text_col).withColumn("held_out", held_out(id_col)).select(id_col, "held_out", "lang_pred", "score")


def clear(text: Column, model: Model, least_score: float, spark) -> Column:
    """Whether the text has a predicted language whose score is ``least_score`` or more."""
    sent = spark.sparkContext.broadcast(model)

    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(sent.value)
        for column in texts:
            kept = []
            for at in range(0, len(column), SLICE_ROWS):
                kept += [lang != "und" and score >= least_score for lang, score in scorer(column.slice(at, SLICE_ROWS).to_pylist())]
            yield pa.array(kept, pa.bool_())

    released = releasing(scored)

    def tested(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from released(texts)

    return F.arrow_udf(tested, "boolean")(text)


def in_known_language(docs: DataFrame, vocabulary_path: str, least_score: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` with a predicted language whose score is ``least_score`` or more.

    Null, empty and letterless texts go, and all rows go if no row has a language to learn
    from. Every row is decided by its own text: repeats and rows without an id are kept or
    go like any other. All columns stay as they are, whatever their names; only the text
    reaches Python. An empty table gives no rows.
    """
    model = fit(docs.where(~held_out(id_col)), vocabulary_path, id_col, text_col, lang_col)
    return docs.where(clear(F.col(text_col), model, least_score, docs.sparkSession))
