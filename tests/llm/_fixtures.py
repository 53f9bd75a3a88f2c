"""Rows that every operator must take: nulls, blanks, long texts, ties, repeats, clashing columns."""

from collections import defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size int, id string, a int, key long, block int, held_out int"
WORDS = "the of and rest than with from that this over under some never always again".split()


def prose(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 11
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[(x >> 8) % len(WORDS)] + str((x >> 16) % 40))
    return " ".join(out)


def odd_rows():
    base = prose(1, 120)
    words = base.split()
    near = " ".join(words[:-3] + ["x", "y", "z"])
    rows = [
        (0, None, None, None, None),
        (1, "", "en", "a", 0),
        (2, " \n\t ", "en", "a", 4),
        (3, base, "en", "a", 1),
        (4, base.replace(" ", "  "), "en", "b", 1),
        (5, base, "fr", "b", 1),
        (6, near, "en", "b", 1),
        (7, near.upper(), "en", None, 1),
        (8, "Ünïcode é wörd", "de", "c", 1),
        (9, "one two three", "en", "c", 1),
        (10, "ONE two  three", "en", "c", 1),
        (11, "###!!! 123 $$$", None, "c", 1),
        (12, prose(5, 30_000), "en", "c", 1),
        (13, "z" * 20_000, "en", "c", 1),
        (None, "a row without an id, with a few words", "en", "c", 1),
    ]
    rows += [(100 + k, prose(50 + k, 60 + k), "en", "hot", 1) for k in range(30)]
    return [(*r, True, 1, "x", 1, 1, 1, 1) for r in rows]


def words_of(text):
    return (text or "").encode().split()


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_components(rows):
    """doc_id -> smallest id reachable over pairs at 0.75 or more."""
    sets = {i: shingle_set(t) for i, t in rows}
    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in sets.items():
        for j in {j for x in s for j in by[x] if j > i}:
            both = len(s & sets[j])
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}
