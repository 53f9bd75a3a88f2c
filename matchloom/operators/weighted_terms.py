"""Keywords of a requirement by a weighted dictionary, longest terms first, by the part of the text they stand in.

All of it happens in the text's row. The dictionary is one constant array; a term is
looked for only in texts that hold its first word, so a text is not scanned once a term.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TERM = "struct<term:string,weight:int,role:string,first:string,pattern:string>"
KEYWORD = "struct<keyword:string,score:double,weight:int,frequency:int,role:string>"


def _bounded(term: Column) -> Column:
    return F.concat(F.lit("\\b"), F.regexp_replace(term, "([.*+?^${}()|\\[\\]\\\\])", "\\\\$1"), F.lit("\\b"))


def _constant(rows: list[dict], schema: str) -> Column:
    return F.from_json(F.lit(json.dumps(rows)), f"array<{schema}>")


def _behind(low: Column, cues: tuple[str, ...], window: int) -> Column:
    """The ``window`` characters from the first cue of the list that the text holds; else empty."""
    return F.coalesce(*[F.when(F.contains(low, F.lit(c)), F.substring(low, F.instr(low, c), window)) for c in cues], F.lit(""))


def weighted_terms(
    rows: DataFrame, key: str, text: str, terms: list[tuple[str, int, str]], verbs: list[str], no_keywords: list[str], required: tuple[str, ...], preferred: tuple[str, ...], window: int = 800, most: int = 25
) -> DataFrame:
    """(key, rank, keyword, score, weight, frequency, role): the first ``most`` keywords by score.

    ``terms`` are (term, weight, role), in the order that settles ties; a longer term that
    stands in the text hides the ones inside it. What stands between slashes (2 to 29
    characters) counts, too, once for each term that holds it or is inside it. The score is
    weight * frequency, times 1.5 for terms behind a required cue and 0.8 behind a preferred
    one. Verbs score twice their frequency. Ties: found between slashes, by term, by verb.
    A null or empty text has no keywords, and repeated rows are told apart by nothing.
    """
    told = [{"term": t, "weight": w, "role": r, "first": (re.findall("[a-z0-9_]+", t) or [""])[0], "pattern": rf"\b{re.sub(r'([.*+?^${}()|\[\]\\])', r'\\\1', t)}\b"} for t, w, r in sorted(terms, key=lambda x: -len(x[0]))]
    dictionary = _constant(told, TERM)
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    norm = F.trim(F.regexp_replace(F.regexp_replace(low, "[^\\w\\s/.+#-]", " "), "\\s+", " "))
    base = rows.select(F.col(key).alias("__key"), low.alias("low"), norm.alias("norm"))
    base = base.withColumns({"req": _behind(F.col("low"), required, window), "pre": _behind(F.col("low"), preferred, window)})
    firsts = F.array(*[F.lit(f) for f in sorted({d["first"] for d in told})])
    base = base.withColumn("hits", F.array_intersect(F.array_append(F.split("norm", "[^a-z0-9_]+"), F.lit("")), firsts))

    times = lambda pattern: F.regexp_count(F.col("norm"), pattern)
    counted = F.transform(F.filter(dictionary, lambda d: F.array_contains("hits", d["first"])), lambda d: F.struct(d["term"].alias("term"), d["weight"].alias("weight"), d["role"].alias("role"), times(d["pattern"]).alias("n")))
    parts = F.filter(F.array_distinct(F.transform(F.split("norm", "/+"), lambda s: F.trim(s))), lambda s: F.length(s).between(2, 29))
    near = lambda s: F.filter(dictionary, lambda d: F.contains(s, d["term"]) | F.contains(d["term"], s))
    base = base.withColumn("terms", F.filter(counted, lambda m: m["n"] > 0)).withColumn("parts", F.transform(parts, lambda s: F.struct(s.alias("term"), F.size(near(s)).alias("of"))))
    slashed = F.transform(F.filter("parts", lambda p: p["of"] > 0), lambda p: F.struct(p["term"].alias("term"), (p["of"] * times(_bounded(p["term"]))).alias("n")))
    base = base.withColumn("slashed", F.filter(slashed, lambda p: p["n"] > 0))

    hides = lambda rows_, m: F.exists(rows_, lambda f: (F.length(f["term"]) > F.length(m["term"])) & F.contains(f["term"], m["term"]))
    base = base.withColumn("kept", F.filter("terms", lambda m: ~hides("terms", m) & ~hides("slashed", m)))
    same = lambda rows_, term: F.get(F.filter(rows_, lambda x: x["term"] == term), F.lit(0))
    one = F.lit(1.0)

    def scored(term: Column, weight: Column, n: Column, role: Column, known) -> Column:
        factor = F.when(known & F.contains("req", term), F.lit(1.5)).otherwise(one) * F.when(known & F.contains("pre", term), F.lit(0.8)).otherwise(one)
        return F.struct(term.alias("keyword"), (weight * n * factor).alias("score"), weight.alias("weight"), n.alias("frequency"), role.alias("role"))

    between = F.transform("slashed", lambda p: F.struct(p.alias("p"), same(dictionary, p["term"]).alias("d"), F.coalesce(same("kept", p["term"])["n"], F.lit(0)).alias("more")))
    between = F.transform(between, lambda x: scored(x["p"]["term"], F.coalesce(x["d"]["weight"], F.lit(1)), x["p"]["n"] + x["more"], F.coalesce(x["d"]["role"], F.lit("general")), x["d"].isNotNull()))
    alone = F.transform(F.filter("kept", lambda m: same("slashed", m["term"]).isNull()), lambda m: scored(m["term"], m["weight"], m["n"], m["role"], F.lit(True)))
    base = base.withColumn("found", F.concat(between, alone))
    acts = F.array(*[F.struct(F.lit(v).alias("keyword"), times(F.lit(rf"\b{v}\b")).alias("n")) for v in dict.fromkeys(verbs)])
    acts = F.transform(F.filter(acts, lambda a: (a["n"] > 0) & ~F.exists("found", lambda k: k["keyword"] == a["keyword"])), lambda a: F.struct(a["keyword"], (a["n"] * 2.0).alias("score"), F.lit(2).alias("weight"), a["n"].alias("frequency"), F.lit("responsibility").alias("role")))
    every = F.concat(F.col("found").cast(f"array<{KEYWORD}>"), acts.cast(f"array<{KEYWORD}>"))
    placed = F.array_sort(F.transform(every, lambda k, i: F.struct((-k["score"]).alias("s"), i.alias("i"), k.alias("k"))))
    named = F.filter(placed, lambda x: ~x["k"]["keyword"].isin(no_keywords) & (F.length(x["k"]["keyword"]) >= 2))
    out = base.select("__key", F.posexplode(F.slice(named, 1, most)).alias("at", "x"))
    return out.select(F.col("__key").alias(key), (F.col("at") + 1).alias("rank"), "x.k.*")
