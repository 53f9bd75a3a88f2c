"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, hmm, kneser_ney, language_id, licences, mixing, near_dedup, packing, periodic_runs, phrases, quality_rules, simhash_links, token_counts
from ._common import documents, materialise


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir))


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(documents(spark, sf_dir), licences.known_licences(spark))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(documents(spark, sf_dir))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "block", F.array_join("shards", ",").alias("shards"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", "kept")


def edits_of(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with ``edits``: a benchmark passage replaces 40 characters, and a word is put at the end."""
    items = max(1, benchmark.count())
    passage = benchmark.groupBy(F.pmod("item_id", F.lit(items)).alias("__k")).agg(F.min_by("text", "item_id").alias("__new"))
    rows = docs.join(passage, F.pmod(F.col("doc_id"), F.lit(items)) == F.col("__k"), "left")
    at = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.char_length(F.coalesce("text", F.lit(""))) + 1)
    first = F.struct(at.cast("long").alias("start"), (at + 40).cast("long").alias("end"), F.col("__new").alias("new"))
    last = F.struct(F.lit(2**40).alias("start"), F.lit(2**40).alias("end"), F.lit(" end").alias("new"))
    return rows.withColumn("edits", F.array(first, last)).drop("__k", "__new")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees are made and stored with their texts once; the edits then start from the stored trees."""
    import public_tokenizers

    ranks, pattern = vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    stored = materialise(token_counts.count_tokens(documents(spark, sf_dir), ranks, pattern, keep_text=True), "token-trees")
    rows = edits_of(stored, documents(spark, sf_dir, "benchmark"))
    out = token_counts.recount(rows, ranks, pattern, stored=True, keep_text=False)
    return out.select("doc_id", "n_tokens", "n_pretokens", "n_tokens_edited", "n_reencoded", "n_leaves")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op10_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_documents(documents(spark, sf_dir))


def planted_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the words of one document in ten, told by crc32 of its id, repeat from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.array_remove(F.split("text", "[\\x20\\x09-\\x0D]+"), "")
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("words"))
    rows = rows.withColumn("n", F.when(F.col("words").isNotNull(), F.size("words"))).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    again = F.flatten(F.expr("array_repeat(slice(words, a + 1, p), cast(ceil((n - a) / p) as int))"))
    planted = F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(again, F.lit(1), F.col("n") - F.col("a")))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs.periodic_runs(planted_periods(documents(spark, sf_dir)))
    best = F.expr("aggregate(runs, cast(null as struct<start: bigint, length: bigint, period: bigint>), (best, r) -> if(best is null or r.length * best.period > best.length * r.period, r, best))")
    lines = F.expr(r"array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    rows = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


def op13_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_links.simhash_components(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_language_id, op3_best_fit_packing, op4_near_dedup, op5_licence_scan, op6_mixing, op7_quality_rules, op8_token_counts, op9_quality_classifier, op10_hmm_scores, op11_periodic_runs, op12_phrase_collocations, op13_simhash_dedup)}
