"""Quality rules: a learned decision list over text statistics.

Sequential covering on labelled statistics: a rule is a conjunction of thresholds,
grown by FOIL gain on one part of the labelled rows and pruned on the other; rows that
it covers are taken out, and the next rule follows until none is precise enough. The
list is emitted as one ordered Spark conditional expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import WordHashes, as_bytes, drawn, hash_limit, mix64, releasing, slices

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
#: Labelled rows that the learner takes at most (a hash sample beyond that).
MAX_LABELLED = 20_000
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_marks long, n_digits long, n_alpha_words long, n_lines long, n_distinct_words long"

UPPER = bytes(range(65, 91))
MARKS = b"!?"
DIGITS = b"0123456789"


def repeat_words(hashes: np.ndarray, window: int = 8) -> int:
    """Words that stand in windows found twice or more, the first finds included."""
    n = len(hashes) - window + 1
    if n < 2:
        return 0
    key = np.zeros(n, np.uint64)
    for k in range(window):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n])
    _, where, times = np.unique(key, return_inverse=True, return_counts=True)
    hit = np.flatnonzero(times[where] > 1)
    if not len(hit):
        return 0
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics(text: bytes, hashes: WordHashes) -> tuple[int, ...]:
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.translate(None, SPACE)]
    bare = text.translate(None, SPACE)
    n_chars = len(bare) if bare.isascii() else len(bare.decode("utf-8", "replace"))
    values = hashes(words) if words else np.zeros(0, np.uint64)
    without = lambda chars: len(text) - len(text.translate(None, chars))
    alpha = sum(map(bytes.isalpha, words)) if text.isascii() else sum(w.decode("utf-8", "replace").isalpha() for w in words)
    return (len(words), n_chars, without(SYMBOLS), len(lines) - len(set(lines)), repeat_words(values), without(UPPER), without(MARKS), without(DIGITS), alpha, len(lines), len(np.unique(values)))


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in slices(batches):
        rows = [statistics(x, hashes) for x in as_bytes(batch.column(1))]
        columns = list(zip(*rows, strict=True)) if rows else []
        yield pa.record_batch([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=[batch.schema.names[0], *(x.split()[0] for x in STATS.split(", "))])


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id and STATS of the whole text. Null text has none of anything."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(releasing(_stats), f"`{id_col}` {kind}, {STATS}")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


#: Features of the rules as SQL over STATS; shares are of at least one.
FEATURES = {
    "n_words": "double(n_words)",
    "mean_word": "word_chars / greatest(n_words, 1D)",
    "symbol_share": "n_symbols / greatest(word_chars, 1D)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1D)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1D)",
    "upper_share": "n_upper / greatest(word_chars, 1D)",
    "mark_share": "n_marks / greatest(n_words, 1D)",
    "digit_share": "n_digits / greatest(word_chars, 1D)",
    "alpha_share": "n_alpha_words / greatest(n_words, 1D)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1D)",
}


@dataclass(frozen=True)
class Rule:
    """All conditions (feature, "<=" or ">", threshold) hold -> low quality."""

    conditions: tuple[tuple[str, str, float], ...]
    precision: float

    def column(self) -> Column:
        out = F.lit(True)
        for name, sign, at in self.conditions:
            value = F.expr(FEATURES[name])
            out = out & (value <= at if sign == "<=" else value > at)
        return out

    def mask(self, x: dict[str, np.ndarray], n: int) -> np.ndarray:
        out = np.ones(n, bool)
        for name, sign, at in self.conditions:
            out &= x[name] <= at if sign == "<=" else x[name] > at
        return out


def _cuts(values: np.ndarray) -> np.ndarray:
    """Thresholds half way between neighbours among the distinct quantiles."""
    q = np.unique(np.quantile(values, np.linspace(0, 1, 65)))
    return (q[1:] + q[:-1]) / 2


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int) -> list[tuple[str, str, float]]:
    rows, out = np.ones(len(bad), bool), []
    while len(out) < most and bad[rows].any() and not bad[rows].all():
        base, best = np.log2(bad[rows].mean()), (0.0, None)
        for name in sorted(x):
            values = x[name][rows]
            for at in _cuts(values):
                low = values <= at
                for sign, side in (("<=", low), (">", ~low)):
                    hit = bad[rows][side]
                    if hit.sum() and (gain := hit.sum() * (np.log2(hit.mean()) - base)) > best[0] + 1e-9:
                        best = (gain, (name, sign, float(at)))
        if best[1] is None:
            break
        out.append(best[1])
        name, sign, at = best[1]
        rows &= x[name] <= at if sign == "<=" else x[name] > at
    return out


def _prune(conditions: list, x: dict[str, np.ndarray], bad: np.ndarray) -> list:
    """The shortest prefix with the best (bad - good) / covered on rows that did not grow it."""
    best, worth = conditions, -1.0
    for k in range(1, len(conditions) + 1):
        hit = bad[Rule(tuple(conditions[:k]), 0).mask(x, len(bad))]
        now = (2 * hit.sum() - len(hit)) / len(hit) if len(hit) else -1.0
        if now > worth + 1e-9:
            best, worth = conditions[:k], now
    return best


def learn(x: dict[str, np.ndarray], bad: np.ndarray, max_rules: int = 12, max_conditions: int = 3, least_precision: float = 0.9, least_cover: int = 5) -> list[Rule]:
    """Ordered rules for ``bad`` rows; deterministic."""
    rules, left = [], np.ones(len(bad), bool)
    fold = np.arange(len(bad)) % 3 == 2
    while len(rules) < max_rules and bad[left].any():
        part = lambda who: ({k: v[who] for k, v in x.items()}, bad[who])
        grown = _grow(*part(left & ~fold), max_conditions)
        if not grown:
            break
        kept = _prune(grown, *part(left & fold))
        mask = Rule(tuple(kept), 0).mask(x, len(bad)) & left
        if mask.sum() < least_cover or bad[mask].mean() < least_precision:
            break
        rules.append(Rule(tuple(kept), float(bad[mask].mean())))
        left &= ~mask
    return rules


def fit_rules(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """Learn from rows with quality 0 or 1 that pass the base rules.

    At most about ``max_labelled`` rows, taken by hash of the id, reach the learner.
    No labelled rows give no rules.
    """
    labels = labels.where(F.col("quality").isin(0, 1)).select(F.col(id_col).alias("__id"), F.col("quality").alias("__quality"))
    labels = labels.where(drawn("rules", F.col("__id"), F.lit(hash_limit(max_labelled / max(1, labels.count())))))
    rows = stats.join(labels, F.col(id_col) == F.col("__id")).where(~base_failed())
    # ids of any type are put in order, and rows that repeat one are told apart by what is learnt from them
    rows = rows.select(F.xxhash64(F.lit("folds"), F.col("__id").cast("string")).alias("h"), "__quality", *[F.expr(e).alias(k) for k, e in FEATURES.items()]).toPandas()
    rows = rows.sort_values(["h", "__quality", *FEATURES])
    return learn({k: rows[k].to_numpy(np.float64) for k in FEATURES}, rows["__quality"].to_numpy() == 0)


def verdict(rules: list[Rule]) -> tuple[Column, Column]:
    """(rule number or 0, kept) as ordered conditional expressions."""
    which = F.lit(0)
    for k in range(len(rules), 0, -1):
        which = F.when(rules[k - 1].column(), F.lit(k)).otherwise(which)
    return which, which == 0


def apply_rules(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """STATS with base_failed, rule (number of the first rule that rejects, or 0) and kept."""
    which, good = verdict(rules)
    return stats.withColumns({"base_failed": base_failed(), "rule": which}).withColumn("kept", ~F.col("base_failed") & good)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Per row: id, statistics, base_failed, rule, kept.

    Null, empty and blank texts have 0 words and fail the base. Long texts are taken whole.
    Ids may be of any type. Rows that repeat stay; labelled ones teach as often as they
    stand. Other columns are ignored. An empty table gives no rows; without labels only the
    base rules decide.
    """
    labelled = docs.join(labels.where(F.col("quality").isin(0, 1)).select(F.col(id_col).alias("__lid")).distinct(), F.col(id_col) == F.col("__lid"), "left_semi")
    limit = hash_limit(max_labelled / max(1, labels.where(F.col("quality").isin(0, 1)).count()))
    labelled = labelled.where(drawn("rules", F.col(id_col), F.lit(limit)))
    rules = fit_rules(text_statistics(labelled, id_col, text_col), labels, id_col, max_labelled)
    return apply_rules(text_statistics(docs, id_col, text_col), rules)
