"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree over block draws.

Documents of a source are hashed into blocks of about ``block_words`` words, which is a random order of
the source. A source takes whole passes over its blocks and a prefix of one more pass, until its target
is met. The draws of all sources are split among the output shards by `contingency.split_tree`, so each
shard's share of every source is exact and random; a shard gets disjoint runs of a source's permuted
draws, and its documents are shuffled by hash.

DataFrame functions only. Nothing grows with the data on the driver; the vector of block quotas has one
entry per source, and a source is a setting of the job (it has a weight).

Defined results: a null source is a source of its own, last in order; a null or empty text has size 0,
takes part and takes 0 words; repeated rows are separate documents; an empty table gives an empty result.
Input columns travel in the struct ``doc``, so none can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmark.llm import contingency
from reelmark.llm.frames import numbered, running, uniform
from reelmark.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
#: Primes above any block number: multiplying by one permutes the blocks of a pass.
STRIDES = (2147483647, 2147483629, 2147483587)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sources: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Adds ``rank`` and ``target`` to (source, words): shares by weight, none above ``most`` times its words.

    What a full source can't take is shared again by weight among the others, until none is above. All
    sums are of integers, so reruns agree to the last bit.
    """
    ranked = cut_lineage(
        numbered(sources, [F.asc_nulls_last("source")], "rank").withColumn(
            "weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
        )
    )
    level, total, full = 0.0, None, -1
    while True:
        limit = most * F.col("words")
        capped = limit <= level * F.col("weight")
        row = ranked.agg(
            F.sum("words").alias("total"),
            F.sum(F.when(capped, limit)).alias("capped"),
            F.sum(F.when(~capped, F.col("weight"))).alias("open"),
            F.count(F.when(capped, 1)).alias("full"),
        ).first()
        total = row["total"] or 0
        if not total or not row["open"] or row["full"] == full:
            break
        full, level = row["full"], (total - (row["capped"] or 0)) / row["open"]
    share = F.least((most * F.col("words")).cast("double"), F.lit(float(level)) * F.col("weight"))
    return ranked.withColumn("target", share)


def mix(
    docs: DataFrame,
    size: Column,
    *,
    source: str = "source",
    id_column: str = "doc_id",
    weights: tuple[int, ...] = (5, 2, 1),
    most: int = 3,
    shards: int | None = None,
    shard_words: int = 1 << 22,
    block_words: int = 1 << 14,
    seed: int = 17,
) -> DataFrame:
    """One row per document: doc (struct), size, source_size, target, taken, draws array<(pass, shard)>.

    ``draws`` says how often the mix takes the document and into which shards; without ``shards``, there
    are as many as hold ``shard_words`` words each. `order_key` sorts a shard.
    """
    spark = docs.sparkSession
    sized = docs.select(F.struct("*").alias("doc"), F.col(source).alias("source"), size.alias("size")).withColumn(
        "key", F.xxhash64(F.lit(seed), F.col("doc")[id_column], F.col("size"))
    )
    slim = cut_lineage(sized.select("source", "size", "key"))
    sources = cut_lineage(
        targets(slim.groupBy("source").agg(F.sum("size").alias("words")), weights, most)
        .withColumn("passes", F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words"))).otherwise(0).cast("bigint"))
        .withColumn("rest", F.col("target") - F.col("passes") * F.col("words"))
        .withColumnsRenamed({"source": "name", "words": "source_size"})
        .withColumn("blocks", F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("source_size") / block_words).cast("bigint")))
    )
    block = F.pmod("key", "blocks")
    same = F.col("source").eqNullSafe(F.col("name"))
    filled = slim.join(sources, same).groupBy("rank", block.alias("block")).agg(F.sum("size").alias("words"))
    placed = cut_lineage(running(filled, "rank", "block", "words", "before"))

    partial = (
        placed.join(sources.select("rank", "rest"), "rank").where(F.col("before") < F.col("rest"))
        .groupBy("rank").agg((F.max("block") + 1).alias("prefix"))
    )
    quotas = sources.join(partial, "rank", "left").withColumn(
        "quota", F.col("passes") * F.col("blocks") + F.coalesce("prefix", F.lit(0).cast("bigint"))
    )
    vector = quotas.agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "quota"))), lambda x: x["quota"]).alias("vec")
    )
    vector = cut_lineage(vector)
    draws = sum(vector.first()["vec"])
    if shards is None:
        shards = max(1, -(-(sources.agg(F.sum("target")).first()[0] or 0) // shard_words))
        shards = int(shards)
    sums = spark.range(shards + 1).select(F.col("id").alias("pos"), F.expr(f"({draws} * id) div {shards}").alias("sum"))
    counts = cut_lineage(contingency.split_tree(vector, sums, shards, seed))

    runs = running(counts.withColumnRenamed("entry", "rank"), "rank", "leaf", "n", "start").where("n > 0")
    drawn = (
        runs.select("rank", F.col("leaf").cast("int").alias("shard"), F.explode(F.expr("sequence(start, start + n - 1)")).alias("draw"))
        .join(sources.select("rank", "blocks", "passes"), "rank")
        .withColumn("pass", F.expr("draw div blocks"))
        .withColumn("at", F.col("draw") % F.col("blocks"))
    )
    stride = F.element_at(F.array(*map(F.lit, STRIDES)), (F.col("pass") % len(STRIDES) + 1).cast("int"))
    drawn = drawn.withColumn(
        "block", F.when(F.col("pass") < F.col("passes"), F.col("at") * stride % F.col("blocks")).otherwise(F.col("at"))
    )
    per_block = drawn.groupBy("rank", "block").agg(  # a block has a draw per pass
        F.sort_array(F.collect_list(F.struct(F.col("pass").cast("int").alias("pass"), "shard"))).alias("drawn")
    )
    blocks = cut_lineage(placed.select("rank", "block", "before").join(per_block, ["rank", "block"], "left"))

    inside = (
        Window.partitionBy("rank", "block").orderBy("key", F.col("doc")[id_column], "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    rows = (
        sized.join(sources, same)
        .select("doc", "size", "key", "rank", "passes", "rest", "target", "source_size", block.alias("block"))
        .join(blocks, ["rank", "block"], "left")
        .withColumn("ahead", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    )
    # The last pass stops at the document that would lead further from the target than leaving it out.
    fits = F.col("ahead") + F.col("size") / 2 <= F.col("rest")
    taken = F.filter(F.coalesce("drawn", F.array()), lambda d: (d["pass"] < F.col("passes")) | fits)
    return rows.withColumn("draws", taken).select(
        "doc", "size", "source_size", "target", (F.col("size") * F.size("draws")).cast("long").alias("taken"), "draws"
    )


def order_key(seed: int, *parts: Column) -> Column:
    """Sorting a shard by this shuffles it."""
    return uniform(F.lit(seed), *parts)
