"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Sizes and targets: a source's target is the water-filled share of all words.
2. Every source's rows are dealt by hash into at most ``MAX_BLOCKS`` blocks, and the
   blocks stand in a permuted order. A source is drawn in whole passes plus one
   partial pass, which takes blocks in that order and, in the block where the quota
   ends, rows in hash order until the quota is reached. So each source has an exact
   quota of blocks in each pass.
3. A binary tree halves the output shards, pass by pass. At each node an urn holds one
   ball for every block of the sources' quotas there; the balls drawn for the left half
   are those with the smallest hashes, so the sources' counts on either side are a
   multivariate hypergeometric draw, and add up to the exact quotas.
4. The leaves are the shards' quotas of each source. A shard draws that many next blocks
   of the source's permuted order, so shards are disjoint within a pass; in a shard,
   rows stand by a hash key. A row is taken once for every shard that has drawn its block.

Only DataFrame functions are used, and the driver gets nothing but counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
ROWS_PER_BLOCK = 64
MAX_BLOCKS = 4096
BROADCAST_ROWS = 200_000
ROWS_PER_SHARD, LEAST_SHARDS, MAX_SHARDS = 20_000, 8, 4096
#: Ranges of hashes in which the balls of an urn are ranked apart.
RANGES = 256


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _hash(*parts) -> Column:
    """Even 52-bit number from the md5 of the parts joined by ``:``."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("\\N")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def source_targets(sizes: DataFrame, source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per source: n_rows, source_size, weight, target.

    Sources in code-point order, null last, take ``weights`` in turn and share the sum
    of all sizes. target = min(max_epochs * source_size, level * weight) with the one
    level at which the targets add up to that sum; a source without words gets 0.
    """
    per = sizes.groupBy(source_col).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    order = Window.orderBy(F.col(source_col).isNull(), F.encode(F.col(source_col), "UTF-8"))
    place = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place + 1).cast("int")).cast("double")
    per = per.withColumn("weight", weight).withColumn("__cap", F.col("source_size") * float(max_epochs))
    by_ratio = Window.orderBy(F.col("__cap") / F.col("weight"), F.col(source_col).isNull(), F.encode(F.col(source_col), "UTF-8")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("__cap").over(by_ratio), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0)))
    # the level rises while sources are rightly held at their caps, and falls after that
    per = per.withColumn("__level", level)
    free = F.max("__level").over(every)
    target = F.least(F.col("__cap"), free * F.col("weight"))
    return per.select(source_col, "n_rows", "source_size", "weight", target.alias("target"))


def split_tree(balls: DataFrame, shards: int, seed: int) -> DataFrame:
    """``balls`` (__e, __s, __r: pass, source, number of the ball) with __shard, the leaf that drew the ball.

    At each node the left half gets its part, in whole balls, of all that the node has,
    for its part of the node's shards. Balls are ranked within ranges of their hashes, so
    that no task takes a whole urn. One written table a level.
    """
    tree = balls.withColumns({"__low": F.lit(0), "__high": F.lit(shards)})
    keys = ["__e", "__low", "__high"]
    for _ in range((shards - 1).bit_length()):
        ball = _hash(F.lit(seed), F.lit("t"), F.col("__e"), F.col("__low"), F.col("__high"), F.col("__s"), F.col("__r"))
        tree = materialise(tree.withColumn("__h", ball).withColumn("__range", F.floor(F.col("__h") / (2**52 // RANGES))), "mix-urns")
        node = Window.partitionBy(*keys)
        ranges = tree.groupBy(*keys, "__range").agg(F.count(F.lit(1)).alias("__n"))
        ranges = ranges.select(*[F.col(k).alias(f"{k}_of") for k in [*keys, "__range"]], F.sum("__n").over(node).alias("__all"), F.coalesce(F.sum("__n").over(node.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
        met = tree.join(ranges, [F.col(k) == F.col(f"{k}_of") for k in [*keys, "__range"]])
        rank = F.col("__before") + F.row_number().over(Window.partitionBy(*keys, "__range").orderBy("__h"))
        middle = F.floor((F.col("__low") + F.col("__high")) / 2).cast("int")
        left = rank <= F.floor(F.col("__all") * (middle - F.col("__low")) / (F.col("__high") - F.col("__low")))
        inner = F.col("__high") - F.col("__low") > 1
        tree = met.withColumn("__left", left).select("__e", "__s", "__r", F.when(inner & ~F.col("__left"), middle).otherwise(F.col("__low")).alias("__low"), F.when(inner & F.col("__left"), middle).otherwise(F.col("__high")).alias("__high"))
    return tree.select("__e", "__s", "__r", F.col("__low").alias("__shard"))


def _blocks_of(n_rows: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(MAX_BLOCKS), F.ceil(n_rows / ROWS_PER_BLOCK))).cast("long")


def _plans(sized: DataFrame, weights: tuple[int, ...], max_epochs: int, seed: int, shards: int | None) -> tuple[DataFrame, DataFrame]:
    """(per source, per source and block): what each row needs to decide for itself."""
    per = source_targets(sized.select(F.col("__source").alias("source"), F.col("__size").alias("size")), "source", weights, max_epochs)
    passes = F.coalesce(F.least(F.lit(max_epochs), F.floor(F.try_divide(F.col("target"), F.col("source_size")))), F.lit(0)).cast("int")
    per = per.select(F.col("source").alias("__s"), "n_rows", F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), _blocks_of(F.col("n_rows")).alias("__n"), passes.alias("__passes"))
    per = materialise(per.withColumn("__quota", F.col("__target") - F.col("__passes") * F.col("__source_size")), "mix-sources")
    rows = sized.join(_small(per), F.col("__source").eqNullSafe(F.col("__s"))).withColumn("__b", _block(seed))
    blocks = rows.groupBy("__s", "__b", "__quota", "__passes").agg(F.sum("__size").alias("__words"))
    order = Window.partitionBy("__s").orderBy(_hash(F.lit(seed), F.lit("b"), F.col("__s"), F.col("__b")), "__b")
    before = F.coalesce(F.sum("__words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumn("__before", before)
    whole = (F.col("__before") + F.col("__words") <= F.col("__quota")) & (F.col("__quota") > 0)
    cut = ~whole & (F.col("__before") < F.col("__quota"))
    blocks = materialise(blocks.withColumns({"__whole": whole, "__cut": cut}), "mix-blocks")
    # one block a source holds the end of the quota; its rows stand in hash order
    edge = rows.select("__s", "__b", "__id", "__size").join(_small(blocks.where("__cut").select(F.col("__s").alias("__es"), F.col("__b").alias("__eb"), "__before", "__quota")), F.col("__s").eqNullSafe(F.col("__es")) & (F.col("__b") == F.col("__eb")))
    edge = edge.withColumn("__key", _row_key(seed))
    run = F.sum("__size").over(Window.partitionBy("__s").orderBy("__key").rowsBetween(Window.unboundedPreceding, 0))
    edge = edge.withColumn("__run", run).where(F.col("__before") + F.col("__run") - F.col("__size") / 2 <= F.col("__quota"))
    ends = edge.groupBy(F.col("__s").alias("__es")).agg(F.max("__key").alias("__end"))
    blocks = blocks.join(ends, F.col("__s").eqNullSafe(F.col("__es")), "left").select(F.col("__s").alias("__bs"), F.col("__b").alias("__bb"), "__passes", "__whole", F.when(F.col("__cut"), F.col("__end")).alias("__end"))
    if shards is None:
        shards = max(LEAST_SHARDS, min(MAX_SHARDS, -(-(per.agg(F.sum("n_rows")).first()[0] or 0) // ROWS_PER_SHARD)))
    return per.drop("n_rows"), materialise(_drawn_by_shards(blocks, shards, seed), "mix-plan")


def _drawn_by_shards(blocks: DataFrame, shards: int, seed: int) -> DataFrame:
    """``blocks`` with __shards: the shard that draws the block in each pass, in order of the passes.

    A pass of a source is a draw of all its blocks; the last, partial pass draws the whole
    blocks and the one where the quota ends. The tree tells each shard's quota of the
    source, and the shards take that many blocks each in the permuted order.
    """
    partial = (F.col("__whole") | F.col("__end").isNotNull()).cast("int")
    last = F.col("__passes") + partial - 1
    draws = blocks.withColumn("__e", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))))
    order = Window.partitionBy("__bs", "__e").orderBy(_hash(F.lit(seed), F.lit("p"), F.col("__e"), F.col("__bs"), F.col("__bb")), "__bb")
    draws = materialise(draws.select(F.col("__bs").alias("__ds"), F.col("__bb").alias("__db"), F.col("__e").alias("__de"), (F.row_number().over(order) - 1).alias("__rank")), "mix-draws")
    leaves = split_tree(draws.select(F.col("__de").alias("__e"), F.col("__ds").alias("__s"), F.col("__rank").alias("__r")), shards, seed)
    # the quotas as runs of places: shard after shard, as many places as it has balls
    places = leaves.select("__e", "__s", "__shard", (F.row_number().over(Window.partitionBy("__s", "__e").orderBy("__shard", "__r")) - 1).alias("__place"))
    placed = draws.join(places, F.col("__ds").eqNullSafe(F.col("__s")) & (F.col("__de") == F.col("__e")) & (F.col("__rank") == F.col("__place")))
    of_block = placed.groupBy("__ds", "__db").agg(F.transform(F.array_sort(F.collect_list(F.struct("__e", "__shard"))), lambda x: x["__shard"]).alias("__shards"))
    return blocks.join(of_block, F.col("__bs").eqNullSafe(F.col("__ds")) & (F.col("__bb") == F.col("__db")), "left").select("__bs", "__bb", "__whole", "__end", F.coalesce("__shards", F.array().cast("array<int>")).alias("__shards"))


def _block(seed: int) -> Column:
    return F.pmod(_hash(F.lit(seed), F.col("__id")), F.col("__n"))


def _row_key(seed: int) -> Column:
    own = F.coalesce(F.col("__id").cast("string"), F.lit("\\N"))
    return F.concat(F.md5(F.concat_ws(":", F.lit(seed), F.lit("r"), own).cast("binary")), F.lit(":"), own)


def _small(df: DataFrame) -> DataFrame:
    """Broadcast up to ``BROADCAST_ROWS`` counted rows; beyond, the planner joins as it likes."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _named(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    return [F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), word_count(F.col(text_col)).alias("__size")]


def _decided(rows: DataFrame, sized: DataFrame, weights: tuple[int, ...], max_epochs: int, seed: int, shards: int | None) -> DataFrame:
    """``rows`` (__id, __source, __size and others) with size, source_size, target, copies, block, shards in ``__mix``."""
    per, blocks = _plans(sized, weights, max_epochs, seed, shards)
    columns = rows.columns
    rows = rows.join(_small(per), F.col("__source").eqNullSafe(F.col("__s"))).withColumn("__b", _block(seed))
    rows = rows.join(_small(blocks), F.col("__source").eqNullSafe(F.col("__bs")) & (F.col("__b") == F.col("__bb")))
    more = F.coalesce((F.col("__whole") | (_row_key(seed) <= F.col("__end"))).cast("int"), F.lit(0))
    taken = F.slice("__shards", F.lit(1), F.least(F.lit(max_epochs), F.col("__passes") + more).cast("int"))
    return rows.select(*columns, F.struct(F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.size(taken).alias("copies"), F.col("__b").alias("block"), taken.alias("shards")).alias("__mix"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 0, shards: int | None = None) -> DataFrame:
    """Per row: id, source, size, source_size, target, copies, block, shards, taken (= copies * size).

    ``shards`` holds the output shard of each copy, one for each pass, as the splitting
    tree has dealt them; there are as many copies as shards.

    Null text has size 0. A null source is a source of its own. Rows without words are
    dealt like any others and add nothing. Draws depend on ids and ``seed`` alone, so
    reruns agree; rows that repeat an id are drawn alike. Other input columns are
    ignored, whatever their names. An empty table gives no rows.
    """
    sized = materialise(docs.select(*_named(docs, id_col, text_col, source_col)), "mix-sizes")
    out = _decided(sized, sized, weights, max_epochs, seed, shards)
    return out.select(F.col("__id").alias(id_col), F.col("__source").alias(source_col), "__mix.*").withColumn("taken", (F.col("size") * F.col("copies")).cast("long"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 0, shards: int | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, shard by shard in local hash order.

    Columns stay as they are, whatever their names. Nulls, repeats and rows without words
    are treated as in ``mix_sources``. An empty table gives no rows.
    """
    named = _named(docs, id_col, text_col, source_col)
    sized = materialise(docs.select(*named), "mix-sizes")
    rows = docs.select(F.struct(*docs.columns).alias("__row"), *named)
    drawn = _decided(rows, sized, weights, max_epochs, seed, shards).select("__row", "__id", F.posexplode("__mix.shards").alias("__epoch", "__shard"))
    drawn = drawn.withColumn("__key", _hash(F.lit(seed), F.lit("l"), F.col("__epoch"), F.col("__id")))
    # a shard is cut into parts by key, so that no task takes a whole large shard
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return drawn.repartition(n, "__shard", F.pmod("__key", F.lit(16))).sortWithinPartitions("__shard", "__key").select("__row.*")
