"""Text functions of the matching engine as Column expressions.

Word boundaries are ASCII look-arounds, since Java's ``\\b`` follows Unicode letters.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _chain(text: Column, *steps: tuple[str, str]) -> Column:
    for pattern, new in steps:
        text = F.regexp_replace(text, pattern, new)
    return text


def bound(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make(value)`` with the value found once, wherever it stands inside.

    A column does not do that: Spark puts what made it in its place if it is named once, and
    inside a lambda it would be made again for each element.
    """
    return F.get(F.transform(F.array(value), make), F.lit(0))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "\\s+", " "))


#: An address without the places inside a word where it cannot start, so that a long word is read once.
ADDRESS = "(?<![^\\s@])[^\\s@]++@[^\\s@]+\\.[^\\s@]+"


#: Space and the other characters that part words without a sign (Unicode's Zs).
SPACES = " \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"


def trimmed(text: Column) -> Column:
    """Without spaces of any width at both ends."""
    return F.trim(text, F.lit(SPACES))


def contains_any(text: Column, parts) -> Column:
    out = F.lit(False)
    for x in parts:
        out = out | F.contains(text, F.lit(x))
    return out


def has_pattern(text: Column, pattern: str) -> Column:
    """``rlike``; alternatives of plain letters are looked for by bytes, which takes a tenth of the time."""
    parts = pattern.split("|") if re.fullmatch("[^()\\[\\]{}\\\\]*", pattern) else [pattern]
    plain = [x for x in parts if re.fullmatch("[\\w -]+", x)]
    others = [x for x in parts if x not in plain]
    found = contains_any(text, plain)
    return found | text.rlike("|".join(others)) if others else found


def strip_markup(text: Column) -> Column:
    """Lower case without tags, links, addresses, paths and day dates; ``[a-z0-9 -._/]`` is left.

    Texts without a sign that all of these have are not searched for them.
    """
    low = F.lower(text)
    bare = _chain(
        low,
        ("<[^>]*>", " "),
        ("https?://[^\\s]+", " "),
        (ADDRESS, " "),
        ("[a-zA-Z]:[\\\\/][^\\s]*", " "),
        ("/[a-zA-Z0-9_./\\-]*", " "),
        ("\\d{1,2}[/\\-]\\d{1,2}[/\\-]\\d{2,4}", " "),
    )
    marked = contains_any(text, ("<", "@", "/", ":\\")) | (F.contains(text, F.lit("-")) & text.rlike("\\d-\\d"))
    return F.trim(F.regexp_replace(F.when(marked, bare).otherwise(low), "[^a-z0-9\\-._/]+", " "))


def without_suffixes(text: Column) -> Column:
    """Words without ``.js`` and ``.ts``, other signs as spaces."""
    return collapse(_chain(F.lower(text), ("\\.(js|ts)", ""), ("[^\\w\\s]", " ")))


def words_only(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "\\W+", " "))


def squeezed(text: Column) -> Column:
    """Signs deleted without a space in their place."""
    return collapse(F.regexp_replace(F.lower(text), "[^\\w\\s]", ""))


def keep_hyphens(text: Column) -> Column:
    return collapse(F.regexp_replace(F.lower(text), "[^\\w\\s-]", " "))


def keep_technical(text: Column) -> Column:
    return collapse(F.regexp_replace(F.lower(text), "[^\\w\\s\\-/+#.]", " "))


#: Names whose signs are kept, and their stand-ins.
PROTECTED = (("c\\+\\+", "cplusplus"), ("c#", "csharp"), ("node\\.js", "nodejs"), ("next\\.js", "nextjs"), ("\\.net", "dotnet"))


def protect_names(text: Column) -> Column:
    return collapse(_chain(F.lower(text), *PROTECTED, ("[^\\w\\s]", " ")))


def letters_of_any_script(text: Column) -> Column:
    return collapse(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}\\s.\\-/]", " "))


def keep_dots(text: Column) -> Column:
    return collapse(F.regexp_replace(F.lower(text), "[^\\w\\s.-]", " "))


def no_separators(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[.\\-_/\\\\]", "")


def comparable(text: Column) -> Column:
    return collapse(F.lower(text))


NORMALISERS = {f.__name__: f for f in (strip_markup, without_suffixes, words_only, squeezed, keep_hyphens, keep_technical, protect_names, letters_of_any_script, keep_dots, no_separators, comparable)}


def tokens(normalised: Column) -> Column:
    """Words of a text whose white space is collapsed to single spaces."""
    return F.filter(F.split(normalised, " "), lambda x: x != "")


def without_stopwords(toks: Column, stop: list[str], least: int = 3) -> Column:
    """Tokens of ``least`` characters or more that are no stop words."""
    return F.filter(toks, lambda x: (F.length(x) >= least) & ~x.isin(stop))


def ngrams(toks: Column, n: int) -> Column:
    """Neighbouring ``n`` tokens joined by spaces."""
    spans = F.when(F.size(toks) >= n, F.sequence(F.lit(1), F.size(toks) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(spans, lambda i: F.array_join(F.slice(toks, i, n), " "))


def grams_up_to_two(toks: Column) -> Column:
    return F.concat(toks, ngrams(toks, 2))


def separated_terms(text: Column) -> Column:
    """Parts between ``/``, ``,`` and ``|``."""
    return F.filter(F.transform(F.split(F.lower(text), "[/,|]"), lambda x: F.trim(x)), lambda x: (F.length(x) > 1) & (F.length(x) < 50))


def word_set(text: Column) -> Column:
    """Distinct words of three characters or more, split at punctuation."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[\\s,;:.!?()|/]+"), lambda x: F.length(x) > 2))


def first_words(toks: Column, n: int = 1) -> Column:
    return F.array_join(F.slice(toks, 1, n), " ")


def first_meaningful(toks: Column, stop: list[str]) -> Column:
    return F.try_element_at(F.filter(toks, lambda x: ~x.isin(stop)), F.lit(1))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "[.!?]+"), lambda x: F.trim(x)), lambda x: x != "")


def whole_word(word: str) -> str:
    """Pattern of the word between characters that are not ``[A-Za-z0-9_]``."""
    return f"(?<![A-Za-z0-9_]){re.escape(word)}(?![A-Za-z0-9_])"


def count_word(text: Column, word: str) -> Column:
    return F.regexp_count(text, F.lit(whole_word(word)))


def context_words(toks: Column, word: str, width: int = 2) -> Column:
    """The first find of the word with ``width`` tokens on each side; null if absent."""
    at = F.array_position(toks, word)
    start = F.greatest(F.lit(1), at - width)
    return F.when(at > 0, F.array_join(F.slice(toks, start.cast("int"), (at + width - start + 1).cast("int")), " "))


def context_characters(text: Column, word: str, width: int = 50) -> Column:
    """Up to ``width`` characters on each side of every find."""
    return F.regexp_extract_all(text, F.lit(f"(.{{0,{width}}}{re.escape(word)}.{{0,{width}}})"), 1)


def stem_steps(word: Column) -> Column:
    """Endings taken in turn: ies, es, s, ing, ed, ation, tion."""
    cut = lambda w, end, new: F.when(w.endswith(end), F.concat(F.substring(w, F.lit(1), F.length(w) - len(end)), F.lit(new))).otherwise(w)
    for end, new in (("ies", "i"), ("es", ""), ("s", ""), ("ing", ""), ("ed", ""), ("tion", "t"), ("ation", "t")):
        word = cut(word, end, new)
    return word


def stem_once(word: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(word, "(s|es|ed|ing|tion|ation)$", ""), "y$", "i")


def stem_short(word: Column) -> Column:
    return F.regexp_replace(word, "(ing|tion|ment|al|ed|s|ly)$", "")


def similarity(a: Column, b: Column) -> Column:
    """(longest - edit distance) / longest over letters and digits; 1 if both are empty."""
    a, b = (F.regexp_replace(F.lower(x), "[^a-z0-9]", "") for x in (a, b))
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise((longest - F.levenshtein(a, b)) / longest)


def ascii_share(text: Column) -> Column:
    return F.try_divide(F.regexp_count(text, F.lit("[\\x00-\\x7F]")), F.length(text))


def keyword_density(text: Column, keyword: str) -> Column:
    """5 for each find of the phrase (15 at most), plus 10 times the share of its words in the text."""
    words = sorted(set(keyword.split()))
    found = F.size(F.array_intersect(tokens(words_only(text)), F.array(*map(F.lit, words))))
    return F.least(F.lit(15), count_word(F.lower(text), keyword) * 5) + F.floor(found * 10 / len(words) + 0.5)


def rolling_hash(text: Column) -> Column:
    """h = 31 h + code in 32 bits over the characters, as a non-negative number."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    h = F.aggregate(codes, F.lit(0).cast("long"), lambda s, c: F.pmod(s * 31 + c, F.lit(2**32)))
    return F.abs(F.when(h >= 2**31, h - 2**32).otherwise(h))


def base36(number: Column) -> Column:
    return F.lower(F.conv(number.cast("string"), 10, 36))


def capitalised(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 2**31 - 1))


def rounded(value: Column) -> Column:
    """Half up to an integer."""
    return F.floor(value + 0.5)


def clamped(value: Column, low: float = 0, high: float = 100) -> Column:
    """Into [low, high]; null and NaN are ``low``."""
    return F.least(F.lit(high), F.greatest(F.lit(low), F.coalesce(F.nanvl(value.cast("double"), F.lit(float(low))), F.lit(float(low)))))
