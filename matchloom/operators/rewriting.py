"""Cleaning and rewriting of bullets: ordered rules as one conditional expression each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import bound, capitalised, contains_any, trimmed


def _chain(text: Column, *steps: tuple[str, str]) -> Column:
    for pattern, new in steps:
        text = F.regexp_replace(text, pattern, new)
    return text


def first_rule(text: Column, rules, make) -> Column:
    """``make(rule)`` of the first rule whose ``test(text)`` holds, else null. ``rules``: (test, value)."""
    out = F.lit(None).cast("string")
    for test, value in reversed(list(rules)):
        out = F.when(test, make(value)).otherwise(out)
    return out


def replace_opening(text: Column, openings, gerund_after: tuple[str, ...] = ()) -> Column:
    """Text whose weak opening is replaced; a gerund behind some openings is dropped; else null."""
    low = F.lower(text)

    def rewritten(rule):
        weak, strong = rule
        rest = trimmed(F.substring(text, len(weak) + 1, 2**31 - 1))
        if weak in gerund_after:
            rest = F.regexp_replace(rest, "^(?i)[a-z]+ing\\s+(?=\\S)", "")
        return F.concat(F.lit(strong), F.lit(" "), capitalised(rest))

    return first_rule(text, [(low.startswith(w), (w, s)) for w, s in openings], rewritten)


def replace_pattern(text: Column, patterns) -> Column:
    """Text whose first matching opening pattern is replaced, else null."""
    return first_rule(text, [(text.rlike(f"(?i)^{p}"), (p, new)) for p, new in patterns], lambda r: F.regexp_replace(text, f"(?i)^{r[0]}", r[1]))


def longest_opening(text: Column, openings) -> Column:
    """Text with its longest matching opening replaced, else null."""
    ordered = sorted(openings, key=lambda x: (-len(x[0]), x[0]))
    return replace_opening(text, ordered)


def with_metric_tail(text: Column, tails, other: str) -> Column:
    """The bullet with the tail of its first topic behind it."""
    bare = F.regexp_replace(F.trim(text), "\\.\\s*$", "")
    tail = first_rule(text, [(text.rlike(f"(?i){p}"), t) for p, t in tails], F.lit)
    return F.concat(bare, F.coalesce(tail, F.lit(other)))


def fix_punctuation(text: Column) -> Column:
    return F.trim(_chain(text, ("\\.,", ","), ("\\.\\.", "."), (",\\.", "."), ("\\s+,", ","), ("\\s+\\.", ".")))


#: Endings that claim a result without a source.
UNFOUNDED = (
    "(?i),?\\s*resulting in \\d+[x%+k,]+\\s*improvement",
    "(?i),?\\s*resulting in enterprise-scale improvement",
    "(?i),?\\s*resulting in [\\w.-]+\\+?\\s*improvement",
    "(?i),?\\s*resulting in \\d+[x%+k,]+.*$",
    "(?i),?\\s*achieving \\d+%\\s*model accuracy[^.]*\\.?",
    "(?i),?\\s*reducing inference latency by \\d+%\\.?",
    "(?i),?\\s*delivering measurable business value\\.?$",
)


def sanitised(text: Column) -> Column:
    """Without unfounded endings, with clean punctuation and a final stop."""
    out = _chain(text, *[(p, "") for p in UNFOUNDED], ("\\.\\s*\\.", "."), (",\\s*\\.", "."), ("\\s{2,}", " "))
    out = F.trim(out)
    return F.when((out != "") & ~out.rlike("[.!?]$"), F.concat(out, F.lit("."))).otherwise(out)


def cleaned_bullet(text: Column) -> Column:
    """One space between words, single signs, no neighbouring repeats, a capital and a final stop.

    Texts without white space or signs that go are not searched for them.
    """
    even = F.when(contains_any(text, ("  ", "\t", "\n", "\x0b", "\f", "\r")), F.regexp_replace(text, "\\s+", " ")).otherwise(text)
    single = F.when(contains_any(text, ("..", "!!", "??", ",,")), F.regexp_replace(even, "([.!?,])\\1+", "$1")).otherwise(even)
    kept = bound(F.split(F.trim(single), " "), lambda words: F.filter(words, lambda x, i: (i == 0) | (F.lower(x) != F.lower(F.get(words, i - 1)))))
    end = lambda out: F.when((out != "") & ~out.rlike("[.!?]$"), F.concat(out, F.lit("."))).otherwise(out)
    return bound(capitalised(F.array_join(kept, " ")), end)


def grammar_issues(text: Column, strong: list[str]) -> Column:
    """Names of the issues of a bullet, joined by commas; empty if it is sound."""
    words = F.filter(F.transform(F.split(F.lower(text), "\\s+"), lambda w: F.regexp_replace(w, "[^\\w\\-]", "")), lambda w: w != "")
    word = lambda k: F.coalesce(F.try_element_at(words, F.lit(k)), F.lit(""))
    tests = (
        ("empty", F.trim(text) == ""),
        ("double_verb", word(1).isin(strong) & word(2).isin(strong)),
        ("bad_combination", text.rlike("(?i)^(integrated|handled|processed|managed|coordinated|worked)\\s+(analyze|create|build|develop)")),
        ("too_short", F.size(F.split(text, "\\s+")) < 4),
        ("preposition", F.trim(text).rlike("(?i)^(to |with |using |for )")),
    )
    return F.concat_ws(",", *[F.when(test, name) for name, test in tests])


def insert_keyword(text: Column, keyword: Column) -> Column:
    """The keyword behind ``technologies`` or ``using``, else in a tail; unchanged if it is there."""
    return (
        F.when(F.contains(text, keyword), text)
        .when(text.contains("technologies"), F.concat(F.substring_index(text, "technologies", 1), F.lit("technologies including "), keyword, F.substring(text, F.instr(text, "technologies") + 12, F.length(text))))
        .when(text.contains("using"), F.concat(F.substring_index(text, "using", 1), F.lit("using "), keyword, F.lit(" and"), F.substring(text, F.instr(text, "using") + 5, F.length(text))))
        .otherwise(F.concat(F.substring(text, F.lit(1), F.length(text) - 1), F.lit(", leveraging "), keyword))
    )


def quoted_or_listed(text: Column) -> Column:
    """Quoted parts of a sentence; without any, its parts between commas, semicolons and ``and``."""
    quoted = F.regexp_extract_all(text, F.lit("\"([^\"]+)\""), 1)
    listed = F.filter(F.transform(F.split(text, "\\s*(?:,|;|\\band\\b)\\s*"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(quoted) > 0, quoted).otherwise(listed)
