"""Keywords of several words against résumés: the first method of a ladder that finds them, and the form found.

A requirement's keywords meet a résumé as one array, and phrases are looked for in its row,
so no text is shuffled or compared with the keywords of other requirements. Only keywords
that no form of theirs finds go on: their words, and they as a whole, meet the distinct
words of all résumés by the blocked similarity join, and then the postings of those words
that are like some keyword.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..sources import store
from .matching import similar_terms


def gram_keywords(tokens: DataFrame, key: str, stop: list[str], n: int, k: int) -> DataFrame:
    """(key, keyword, rnk): the ``k`` most frequent stretches of ``n`` words of (key, pos, token), none of them short or a stop word."""
    fit = (F.length("token") > 2) & ~F.col("token").isin(stop)
    here = Window.partitionBy(key).orderBy("pos").rowsBetween(0, n - 1)
    rows = tokens.select(key, "pos", F.collect_list(F.when(fit, F.col("token"))).over(here).alias("g")).where(F.size("g") == n)
    counts = rows.groupBy(key, F.array_join("g", " ").alias("keyword")).agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("at"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "at"))
    return counts.withColumn("rnk", rank).where(F.col("rnk") <= k).select(key, "keyword", "rnk")


def phrase_matches(resumes: DataFrame, keywords: DataFrame, synonyms: DataFrame, least: float = 0.85) -> DataFrame:
    """(resume_id, jd_id, keyword, method, found_as) of each keyword of a résumé's requirement.

    Methods, the first that holds: ``exact``, the keyword stands in the normalised text;
    ``synonym``, another form of one of its groups (grp, form) does, the first by
    alphabet; ``word_match``, a keyword of several words has a like word in the text for
    each of them; ``fuzzy``, some word is like the whole keyword, the first in the text;
    else ``none``. Words are like another with similarity over ``least``.
    """
    own = synonyms.select(F.col("grp").alias("__g"), F.col("form").alias("__f"))
    forms = keywords.select("keyword").distinct().join(own, F.col("keyword") == F.col("__f")).join(synonyms, F.col("__g") == F.col("grp"))
    forms = forms.where(F.col("form") != F.col("keyword")).groupBy(F.col("keyword").alias("__k")).agg(F.array_sort(F.collect_set("form")).alias("__forms"))
    wanted = keywords.join(forms, F.col("keyword") == F.col("__k"), "left").select("jd_id", F.struct("keyword", F.coalesce("__forms", F.array().cast("array<string>")).alias("forms")).alias("k"))
    wanted = wanted.groupBy(F.col("jd_id").alias("__j")).agg(F.collect_list("k").alias("__ks"))
    rows = resumes.join(wanted, F.col("jd_id") == F.col("__j")).select("resume_id", "jd_id", "__ks", t.words_only(F.col("text")).alias("__norm"))
    has = lambda x: F.contains(F.col("__norm"), x)
    told = F.transform("__ks", lambda k: F.struct(k["keyword"].alias("keyword"), has(k["keyword"]).alias("exact"), F.try_element_at(F.filter(k["forms"], has), F.lit(1)).alias("form")))
    rows = rows.select("resume_id", "jd_id", F.explode(told).alias("m")).select("resume_id", "jd_id", "m.*")

    # what no form has found: the words of the résumés that are like a keyword or a word of one
    open_ = rows.where(~F.col("exact") & F.col("form").isNull()).select("resume_id", "keyword")
    terms = keywords.select("keyword").distinct()
    parts = terms.select("keyword", F.split("keyword", " ").alias("w")).withColumn("n", F.size("w"))
    asked = parts.select(F.col("keyword").alias("term")).unionByName(parts.where("n > 1").select(F.explode("w").alias("term"))).distinct()
    # postings stay where the résumé is read: only the distinct words and the finds shuffle
    words = t.tokens(t.words_only(F.col("text")))
    postings = resumes.select("resume_id", F.posexplode(words).alias("pos", "token"))
    like = similar_terms(asked, resumes.select(F.explode(F.array_distinct(words)).alias("term")), least).select(F.col("left").alias("term"), F.col("right").alias("__t"))
    like = store.written(like, "like-words")
    finds = postings.join(like, F.col("token") == F.col("__t")).groupBy("resume_id", "term").agg(F.min(F.struct("pos", "token")).alias("first"))
    finds = finds.select(F.col("resume_id").alias("__r"), F.col("term").alias("__term"), F.col("first.token").alias("like"))

    def met(left: DataFrame, term: str) -> DataFrame:
        return left.join(finds, (F.col("resume_id") == F.col("__r")) & (F.col(term) == F.col("__term")))

    several = parts.where("n > 1").select(F.col("keyword").alias("__k"), F.explode(F.array_distinct("w")).alias("word"), F.size(F.array_distinct("w")).alias("n"))
    each = met(open_.join(several, F.col("keyword") == F.col("__k")), "word").groupBy("resume_id", "keyword").agg(F.count(F.lit(1)).alias("found"), F.first("n").alias("n"))
    each = each.where("found = n").select("resume_id", "keyword", F.lit(None).cast("string").alias("like"))
    whole = met(open_, "keyword").select("resume_id", "keyword", "like")
    more = each.withColumn("way", F.lit(1)).unionByName(whole.withColumn("way", F.lit(2))).groupBy(F.col("resume_id").alias("__r"), F.col("keyword").alias("__k")).agg(F.min(F.struct("way", "like")).alias("m"))
    out = rows.join(more, (F.col("resume_id") == F.col("__r")) & (F.col("keyword") == F.col("__k")), "left")
    method = F.when(F.col("exact"), "exact").when(F.col("form").isNotNull(), "synonym").when(F.col("m.way") == 1, "word_match").when(F.col("m.way") == 2, "fuzzy").otherwise("none")
    found = F.when(F.col("exact"), F.col("keyword")).when(F.col("form").isNotNull(), F.col("form")).when(F.col("m.way") == 1, F.col("keyword")).otherwise(F.col("m.like"))
    return out.select("resume_id", "jd_id", "keyword", method.alias("method"), found.alias("found_as"))


def stem_phrase_matches(resumes: DataFrame, keywords: DataFrame, synonyms: dict[str, list[str]]) -> DataFrame:
    """(resume_id, jd_id, keyword, and a column for each ladder) over the same keywords.

    ``substring_stems``: the keyword in the text, else all its stems among the text's;
    ``substring_tokens_stem``: in the text, else all its words in the text, else its last
    word's stem; ``substring_synonym_tokens``: in the text, else a form of its group, else
    all its words in the text; ``synonym_both_ways``: in the text, else a form of its
    group; ``synonym_or_word``: a form of its group or itself in the text when it has one,
    else the whole word. Values are the step that found it, or ``none``.
    """
    wanted = keywords.groupBy(F.col("jd_id").alias("__j")).agg(F.collect_list("keyword").alias("__ks"))
    rows = resumes.join(wanted, F.col("jd_id") == F.col("__j")).select("resume_id", "jd_id", "__ks", t.words_only(F.col("text")).alias("__norm"))
    rows = rows.withColumn("__stems", F.array_distinct(F.transform(F.array_distinct(t.tokens(F.col("__norm"))), t.stem_once)))

    def judged(known):
        k, here, words, inside = known["k"], known["here"], known["words"], known["inside"]
        stems = F.forall(words, lambda w: F.array_contains("__stems", t.stem_once(w)))
        last = F.array_contains("__stems", t.stem_once(F.element_at(words, -1)))
        grouped, form = F.lit(False), F.lit(False)
        for forms in synonyms.values():
            grouped = grouped | k.isin(forms)
            form = form | (k.isin(forms) & F.exists(F.array(*map(F.lit, forms)), lambda f: F.contains(F.col("__norm"), f)))
        word = F.contains(F.concat(F.lit(" "), F.col("__norm"), F.lit(" ")), F.concat(F.lit(" "), k, F.lit(" ")))
        step = lambda *tests: F.coalesce(*[F.when(test, name) for name, test in tests], F.lit("none"))
        return F.struct(
            k.alias("keyword"),
            step(("substring", here), ("stems", stems)).alias("substring_stems"),
            step(("substring", here), ("tokens", inside), ("stem", last)).alias("substring_tokens_stem"),
            step(("substring", here), ("synonym", form), ("tokens", inside & (F.size(words) > 1))).alias("substring_synonym_tokens"),
            step(("substring", here), ("synonym", form)).alias("synonym_both_ways"),
            step(("synonym", form), ("word", ~grouped & word)).alias("synonym_or_word"),
        )

    has = lambda x: F.contains(F.col("__norm"), x)
    known = F.transform("__ks", lambda k: F.struct(k.alias("k"), has(k).alias("here"), F.split(k, " ").alias("words"), F.forall(F.split(k, " "), has).alias("inside")))
    return rows.select("resume_id", "jd_id", F.explode(F.transform(known, judged)).alias("m")).select("resume_id", "jd_id", "m.*")
