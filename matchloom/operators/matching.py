"""Keywords of requirements, their canonical forms, and how résumés match them.

A pair of résumé and requirement meets by an equi-join of tokens: both sides are
exploded to distinct tokens, so the cost is that of the shared tokens and no text is
compared with all keywords. Substring profiles need the text and run on given pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t


#: Rows up to which a counted side is broadcast; beyond, the planner joins as it likes.
BROADCAST_ROWS = 200_000


def counted_broadcast(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def by_repeated_key(rows: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` whose key stands once in ``keys``, and those whose key is repeated or null (None if there are none). Only keys shuffle."""
    repeated = keys.groupBy(key).count().where((F.col("count") > 1) | F.col(key).isNull()).select(F.col(key).alias("__key"))
    if repeated.isEmpty():
        return rows, None
    repeated, same = counted_broadcast(repeated), F.col(key).eqNullSafe(F.col("__key"))
    return rows.join(repeated, same, "left_anti"), rows.join(repeated, same, "left_semi")


def token_rows(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, token): words of the normalised text with their positions from 1."""
    return rows.select(key, F.posexplode(t.tokens(t.words_only(F.col(text)))).alias("pos", "token")).withColumn("pos", F.col("pos") + 1)


def weighted_keywords(tokens: DataFrame, key: str, stop: list[str], k: int, cap: int = 5, least: int = 3) -> DataFrame:
    """(key, keyword, weight, rnk): the ``k`` most frequent words; earlier ones first among equals."""
    rows = tokens.where((F.length("token") >= least) & ~F.col("token").isin(stop))
    counts = rows.groupBy(key, F.col("token").alias("keyword")).agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("at"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "at"))
    return counts.withColumn("rnk", rank).where(F.col("rnk") <= k).select(key, "keyword", F.least("n", F.lit(cap)).alias("weight"), "rnk")


def matched_keywords(resumes: DataFrame, keywords: DataFrame) -> DataFrame:
    """(resume_id, jd_id, keyword, weight, rnk, matched): whole-word matches of résumés (resume_id, jd_id, text).

    A requirement's keywords are one array, which meets the résumé on ``jd_id``; the words
    that both have are found in the row. If there are few requirements, nothing shuffles.
    """
    wanted = keywords.groupBy(F.col("jd_id").alias("__j")).agg(F.collect_list(F.struct("keyword", "weight", "rnk")).alias("__ks"))
    met = resumes.join(counted_broadcast(wanted), F.col("jd_id") == F.col("__j"))
    both = F.array_intersect(t.tokens(t.words_only(F.col("text"))), F.transform("__ks", lambda k: k["keyword"]))
    rows = met.select("resume_id", "jd_id", "__ks", both.alias("__both")).select("resume_id", "jd_id", "__both", F.explode("__ks").alias("k"))
    return rows.select("resume_id", "jd_id", "k.*", F.array_contains("__both", F.col("k.keyword")).alias("matched"))


def with_missing(resumes: DataFrame, keywords: DataFrame) -> DataFrame:
    """``resumes`` (jd_id, text) and how many keywords its requirement has (n_keywords), and those that it lacks in order, ``missing`` (rnk, keyword, weight); none without a requirement."""
    wanted = keywords.groupBy(F.col("jd_id").alias("__j")).agg(F.array_sort(F.collect_list(F.struct("rnk", "keyword", "weight"))).alias("__ks"))
    met = resumes.join(counted_broadcast(wanted), F.col("jd_id") == F.col("__j"), "left")
    both = F.array_intersect(t.tokens(t.words_only(F.col("text"))), F.transform("__ks", lambda k: k["keyword"]))
    lacks = t.bound(both, lambda found: F.filter("__ks", lambda k: ~F.array_contains(found, k["keyword"])))
    n = F.when(F.col("__ks").isNotNull(), F.size("__ks")).otherwise(0)
    return met.select(*resumes.columns, n.alias("n_keywords"), F.coalesce(lacks, F.array().cast(wanted.schema["__ks"].dataType)).alias("missing"))


def with_synonyms(keywords: DataFrame, synonyms: DataFrame, key: str) -> DataFrame:
    """(key, keyword, form): the keyword itself and the other forms of its groups (grp, form)."""
    own = keywords.select(key, "keyword", F.col("keyword").alias("form"))
    grp = synonyms.select(F.col("grp").alias("__g"), F.col("form").alias("__f"))
    hit = keywords.join(grp, F.col("keyword") == F.col("__f")).select(key, "keyword", "__g")
    more = hit.join(synonyms, F.col("__g") == F.col("grp")).select(key, "keyword", "form")
    return own.unionByName(more).distinct()


def match_scores(matches: DataFrame) -> DataFrame:
    """Per pair: matched and missing counts, plain and weighted shares in per cent."""
    out = matches.groupBy("resume_id", "jd_id").agg(
        F.count(F.lit(1)).alias("n_keywords"),
        F.count_if("matched").alias("n_matched"),
        F.sum("weight").alias("weight"),
        F.sum(F.when(F.col("matched"), F.col("weight")).otherwise(0)).alias("matched_weight"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("matched"), F.struct("rnk", "keyword")))), lambda x: x["keyword"]), ",").alias("missing"),
    )
    percent = lambda a, b: F.floor(F.col(a) * 100 / F.col(b) + 0.5)
    return out.withColumns({"percent": percent("n_matched", "n_keywords"), "weighted_percent": percent("matched_weight", "weight")})


def vote(tokens: DataFrame, key: str, roles: DataFrame, default: str) -> DataFrame:
    """(key, role, votes): the role whose terms occur most; the first in order among equals, ``default`` without votes."""
    hits = tokens.join(counted_broadcast(roles), F.col("token") == F.col("term")).groupBy(key, "role", "ord").agg(F.count(F.lit(1)).alias("votes"))
    best = hits.groupBy(key).agg(F.min(F.struct((-F.col("votes")).alias("v"), "ord", "role")).alias("b")).select(F.col(key).alias("__k"), F.col("b.role").alias("role"), (-F.col("b.v")).alias("votes"))
    return tokens.select(key).distinct().join(best, F.col(key) == F.col("__k"), "left").select(key, F.coalesce("role", F.lit(default)).alias("role"), F.coalesce("votes", F.lit(0)).alias("votes"))


def _pieces(column: str, width: Column) -> Column:
    """All pieces of ``width`` characters with their places from 1."""
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(column) - width + 1))
    return F.transform(places, lambda i: F.struct(i.alias("at"), F.substring(F.col(column), i, width).alias("piece")))


def similar_terms(left: DataFrame, right: DataFrame, least: float = 0.85) -> DataFrame:
    """(left, right, distance) of terms with similarity over ``least``; equal terms included.

    Similarity over .85 allows fewer than .15 * longest edits, so one of the first
    ``edits + 1`` pieces of one term stands unmoved by more than that in the other. Terms
    of up to 6 letters must be equal. Others meet on (piece, place) and on near lengths,
    not in a cross join.
    """
    a = left.select(F.col("term").alias("left")).distinct()
    b = right.select(F.col("term").alias("right")).distinct()
    equal = a.join(b, F.col("left") == F.col("right")).select("left", "right", F.lit(0).alias("distance"))

    def allowed(length: Column) -> Column:
        return (F.ceil(length * (1 - least)) - 1).cast("int")

    # pieces of the right term: allowed edits of the longest partner plus one, of even length
    longest = F.length("right") + F.greatest(F.lit(1), allowed(F.ceil(F.length("right") / least)))
    edits = F.greatest(F.lit(1), allowed(longest))
    b = b.where(F.length("right") > 5).withColumns({"__e": edits, "__n": F.length("right")})
    width = F.greatest(F.lit(1), F.floor(F.col("__n") / (F.col("__e") + 1))).cast("int")
    cuts = F.transform(F.sequence(F.lit(0), F.col("__e")), lambda i: F.struct((i * width).alias("at"), F.substring(F.col("right"), (i * width + 1).cast("int"), width).alias("piece")))
    b = b.select("right", "__n", "__e", F.explode(cuts).alias("c")).select("right", "__n", "__e", F.col("c.at").alias("__at"), F.col("c.piece").alias("__p"), F.length("c.piece").alias("__w"))
    # the widths that a partner of the left term can have; the lengths of partners are bounded by its own
    a = a.where(F.length("left") > 5)
    shortest, farthest = F.floor(F.length("left") * least), F.ceil(F.length("left") / least)
    cut = lambda n: F.greatest(F.lit(1), F.floor(n / (F.greatest(F.lit(1), allowed(n + F.greatest(F.lit(1), allowed(F.ceil(n / least))))) + 1))).cast("int")
    widths = F.array_distinct(F.transform(F.sequence(shortest, farthest), cut))
    spots = F.flatten(F.transform(widths, lambda w: _pieces("left", w)))
    a = a.select("left", F.explode(spots).alias("s")).select("left", F.length("left").alias("__l"), F.col("s.at").alias("__i"), F.col("s.piece").alias("__q"))
    a = counted_broadcast(a)
    met = a.join(b, (F.col("__q") == F.col("__p")) & (F.abs(F.col("__l") - F.col("__n")) <= F.col("__e")) & (F.abs(F.col("__i") - 1 - F.col("__at")) <= F.col("__e")) & (F.col("left") != F.col("right")))
    pairs = met.select("left", "right").distinct().withColumn("distance", F.levenshtein("left", "right"))
    near = (F.greatest(F.length("left"), F.length("right")) - F.col("distance")) / F.greatest(F.length("left"), F.length("right")) > least
    return equal.unionByName(pairs.where(near))
