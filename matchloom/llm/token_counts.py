"""Edit-aware token counts: a segment tree over pre-tokens for every document.

A pre-token never looks back, but white space looks ahead (how it is parted depends on
what stands behind all of it), as an apostrophe does. So text before an edit keeps its
pre-tokens up to the last boundary that stands before the edit, and neither behind white
space nor behind an apostrophe; text behind an edit keeps them from the first place where
the new pre-tokens meet an old boundary. Leaves of the tree hold up to
``LEAF`` pre-tokens (characters, tokens); an edit re-encodes from the leaf boundary
before it to the leaf boundary at which the two line up again. The touched leaves share
the new pre-tokens, and only the sums on the paths above them are made anew, unless they
would hold more than ``2 * LEAF`` each: then the document's tree is built anew from its
leaves, without encoding more.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import BoundedWords, releasing, slices

LEAF = 64
#: Bytes of pre-tokens whose counts a task keeps, about.
WORDS_ROOM = 40_000_000


class Encoder:
    """Token counts of pre-tokens of a public byte-level vocabulary, looked up once each."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.find = regex.compile(pattern).findall
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known = BoundedWords(WORDS_ROOM)

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known
        try:
            return [known[p] for p in pieces]
        except KeyError:
            known.make_room()
        beside = {}
        for p in {p for p in pieces if p not in known}:
            n = len(self.encoding.encode_ordinary(p))
            known.keep(p, n)
            if len(p) > known.LONG:
                beside[p] = n
        return [beside[p] if p in beside else known[p] for p in pieces] if beside else [known[p] for p in pieces]

    def leaves(self, text: str, leaf: int = LEAF) -> tuple[list[int], list[int], list[int]]:
        """Characters, tokens and pre-tokens of each leaf of ``text``."""
        pieces = self.find(text)
        if not pieces:
            return [], [], []
        at = np.arange(0, len(pieces), leaf)
        chars = np.add.reduceat(np.fromiter(map(len, pieces), np.int64, len(pieces)), at)
        tokens = np.add.reduceat(np.array(self.counts(pieces), np.int64), at)
        return chars.tolist(), tokens.tolist(), np.diff([*at, len(pieces)]).tolist()


def subtree_sums(leaves: list[int]) -> list[int]:
    """Heap-ordered sums over a power of two of leaves; the root is first, leaves are last."""
    width = 1
    while width < len(leaves):
        width *= 2
    level = np.zeros(width, np.int64)
    level[: len(leaves)] = leaves
    levels = [level]
    while len(levels[0]) > 1:
        levels.insert(0, levels[0].reshape(-1, 2).sum(axis=1))
    return np.concatenate(levels).tolist()


class CountTree:
    """A document's leaves and their subtree sums of characters and tokens; ``token_sums`` are taken as they were stored."""

    def __init__(self, chars: list[int], tokens: list[int], pretokens: list[int], leaf: int = LEAF, token_sums: list[int] | None = None):
        self.chars, self.tokens, self.pretokens, self.leaf = list(chars), list(tokens), list(pretokens), leaf
        if token_sums is None:
            self._sum()
        else:
            self.char_sums, self.token_sums = subtree_sums(self.chars), list(token_sums)

    @classmethod
    def stored(cls, chars: list[int], pretokens: list[int], token_sums: list[int]) -> CountTree:
        """From STATE: the tokens of the leaves are the last level of their sums."""
        first = (len(token_sums) - 1) // 2
        return cls(chars, token_sums[first : first + len(chars)], pretokens, token_sums=token_sums)

    def _sum(self) -> None:
        self.char_sums, self.token_sums = subtree_sums(self.chars), subtree_sums(self.tokens)

    def _raise(self, first: int, last: int) -> None:
        """Makes the sums above the leaves first..last anew."""
        width = (len(self.char_sums) + 1) // 2
        for sums, leaves in ((self.char_sums, self.chars), (self.token_sums, self.tokens)):
            a, b = first + width - 1, last + width - 1
            sums[a : b + 1] = leaves[first : last + 1]
            while a > 0:
                a, b = (a - 1) // 2, (b - 1) // 2
                for node in range(a, b + 1):
                    sums[node] = sums[2 * node + 1] + sums[2 * node + 2]

    @property
    def total(self) -> int:
        return self.token_sums[0]

    def leaf_at(self, position: int) -> tuple[int, int]:
        """(leaf that holds the character, characters before the leaf), down the tree."""
        node, before, width = 0, 0, (len(self.char_sums) + 1) // 2
        while node < width - 1:
            node = 2 * node + 1
            if position >= before + self.char_sums[node]:
                before += self.char_sums[node]
                node += 1
        return node - (width - 1), before

    def edit(self, text: str, start: int, end: int, new: str, encoder: Encoder) -> tuple[str, int]:
        """Replace text[start:end]; returns the new text and how many pre-tokens were encoded again.

        Positions outside the text are moved to its ends, and an end before its start to
        the start.
        """
        start = min(max(start, 0), len(text))
        end = min(max(end, start), len(text))
        after = text[:start] + new + text[end:]
        first, before = self.leaf_at(max(start - 1, 0)) if self.char_sums[0] else (0, 0)
        while first > 0 and (not self.chars[first] or (before > 0 and (text[before - 1].isspace() or text[before - 1] == "'"))):
            first -= 1
            before -= self.chars[first]
        shift = len(after) - len(text)
        # old leaf boundaries behind the edit, as places in the new text
        last, upto = first, before
        while last < len(self.chars) and upto < end:
            upto += self.chars[last]
            last += 1
        step = 1
        while True:
            stop = min(len(self.chars), last + step)
            limit = upto + sum(self.chars[last:stop]) + shift
            # text behind the limit decides how the last pre-token before it ends
            pieces = encoder.find(after, before, min(len(after), limit + 4096))
            places = before + np.cumsum([len(p) for p in pieces]) if pieces else np.zeros(0, int)
            whole = limit + 4096 >= len(after)
            seen = min(len(after), limit + 4096)
            while not whole and seen > before and after[seen - 1].isspace():
                seen -= 1  # how this white space is parted is told behind it
            meets, place, k = {}, upto + shift, last
            while k <= stop:
                meets[place] = k
                if k < len(self.chars):
                    place += self.chars[k]
                k += 1
            join = next((i for i, p in enumerate(places.tolist()) if p in meets and p >= start + len(new) and (whole or p < seen)), None)
            if join is not None:
                pieces, resume = pieces[: join + 1], meets[int(places[join])]
                break
            if stop == len(self.chars):
                pieces, resume = encoder.find(after, before), len(self.chars)
                break
            step *= 2
        counts = encoder.counts(pieces)
        leaves = resume - first
        fits = leaves and len(pieces) <= 2 * self.leaf * leaves
        size = max(1, -(-len(pieces) // leaves)) if fits else self.leaf
        groups = range(0, len(pieces), size)
        padding = [0] * (leaves - len(groups)) if fits else []
        self.chars[first:resume] = [sum(map(len, pieces[g : g + size])) for g in groups] + padding
        self.tokens[first:resume] = [sum(counts[g : g + size]) for g in groups] + padding
        self.pretokens[first:resume] = [len(pieces[g : g + size]) for g in groups] + padding
        if fits:
            self._raise(first, resume - 1)
        else:
            self._sum()
        return after, len(pieces)


STATE = "n_tokens long, n_pretokens long, leaf_chars array<int>, leaf_pretokens array<int>, token_sums array<long>"


def _built(ranks_path: str, pattern: str, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks_path, pattern)
        for batch in slices(batches):
            rows = [encoder.leaves(t or "") for t in batch.column(1).to_pylist()]
            totals = [pa.array([sum(r[k]) for r in rows], pa.int64()) for k in (1, 2)]
            lists = [pa.array([r[k] for r in rows], pa.list_(pa.int32())) for k in (0, 2)]
            sums = pa.array([subtree_sums(r[1]) for r in rows], pa.list_(pa.int64()))
            yield pa.record_batch([batch.column(0), *totals, *lists, sums, *([batch.column(1)] if keep_text else [])], names=[batch.schema.names[0], *(x.split()[0] for x in STATE.split(", ")), *(["text"] if keep_text else [])])

    return run


def count_tokens(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Per row: the id and the STATE of the whole text, to be stored for ``recount``; with ``keep_text`` its text, too.

    Null counts as empty: no leaves, 0 tokens. Repeated rows stay. Long texts are taken
    whole. Other columns are ignored. An empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(releasing(_built(ranks_path, pattern, keep_text)), f"`{id_col}` {kind}, {STATE}" + ", text string" * keep_text)


EDITED = "n_tokens long, n_pretokens long, n_tokens_edited long, n_pretokens_edited long, n_reencoded long, n_leaves long, edited_text string, leaf_chars array<int>, leaf_pretokens array<int>, token_sums array<long>"


def _edited(ranks_path: str, pattern: str, stored: bool, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks_path, pattern)
        for batch in slices(batches):
            rows, texts, edits = [], batch.column(1).to_pylist(), batch.column(2).to_pylist()
            trees = (CountTree.stored(*state) for state in zip(*(c.to_pylist() for c in batch.columns[3:]), strict=True)) if stored else (CountTree(*encoder.leaves(t or "")) for t in texts)
            for text, own, tree in zip(texts, edits, trees, strict=True):
                text, again = text or "", 0
                before = tree.total, sum(tree.pretokens)
                for e in own or ():
                    if e is None or e["start"] is None or e["end"] is None:
                        continue
                    text, encoded = tree.edit(text, e["start"], e["end"], e["new"] or "", encoder)
                    again += encoded
                rows.append((*before, tree.total, sum(tree.pretokens), again, len(tree.chars), *((text, tree.chars, tree.pretokens, tree.token_sums) if keep_text else (None,) * 4)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 10
            kinds = [pa.int64()] * 6 + [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
            yield pa.record_batch([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[batch.schema.names[0], *(x.split()[0] for x in EDITED.split(", "))])

    return run


def recount(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits", stored: bool = False, keep_text: bool = True) -> DataFrame:
    """Per row: the id and EDITED after the row's edits, in their order.

    ``edits_col``: array of struct(start, end, new), characters of the text as the edits
    before have left it; null or empty: no edit. A null edit, and one with a null start or
    end, changes nothing; a null ``new`` is empty. With ``stored`` the rows carry
    leaf_chars, leaf_pretokens and token_sums of ``count_tokens`` (or of an earlier
    ``recount``, whose edited_text is the text then), and nothing but the edited regions is
    encoded; without, trees are built first, in the same pass. ``keep_text=False`` leaves
    edited_text and the tree null. Long texts are taken whole; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    edits = F.transform(F.col(edits_col), lambda e: F.struct(e["start"].cast("long").alias("start"), e["end"].cast("long").alias("end"), e["new"].cast("string").alias("new")))
    columns = ["leaf_chars", "leaf_pretokens", "token_sums"] if stored else []
    return docs.select(id_col, text_col, edits.alias("__edits"), *columns).mapInArrow(releasing(_edited(ranks_path, pattern, stored, keep_text)), f"`{id_col}` {kind}, {EDITED}")
