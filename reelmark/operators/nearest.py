"""Exact nearest vectors with bounds instead of all scores.

Vectors of similar genres lie together: commonest genre first, in pages of `PAGE` vectors and, within these,
blocks of `BLOCK`. Of each page and block the greatest weight of every genre is known, which bounds the score of all its
vectors. A page of queries first meets the page that promises most, which gives every query a k-th score; then it
meets only pages, and multiplies only blocks, whose bound reaches that score. `Search.counts` says how many blocks
were multiplied.

The rows that travel are pages, never pairs of them. Pages of queries are dealt to `GROUPS` groups and pages of
candidates to slices; a group and a slice are a cell, in which a task holds the group's pages, sees the slice's one after
another and hands on the k best of each query. So a page travels once for each group or slice, however many it meets;
groups beyond `GROUP_PAGES` pages are split, which bounds what a task holds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from reelmark.functions import bounds
from reelmark.session import cut_lineage

PAGE = 1024  # vectors that travel together
BLOCK = 32  # vectors that share a bound
GROUPS = 16  # groups of query pages
GROUP_PAGES = 32  # most query pages that a task holds
FILLER = -1  # number of the page that holds the first titles of all


@dataclass(frozen=True)
class Search:
    """What a search found, and what it did for it."""

    found: DataFrame  # query_id, title, similarity, position
    counts: DataFrame  # query_pages, pages, met (pairs of pages), blocks (queries times blocks there are), multiplied


def _by_genre(rows: DataFrame, commonness: DataFrame) -> DataFrame:
    """Adds ``_key``: the row's genres, commonest first."""
    entries = rows.select("_id", F.explode("vector.genre").alias("genre")).join(commonness, "genre")
    keys = entries.groupBy("_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("rows")).alias("often"), "genre"))).alias("_key"))
    return rows.join(keys, "_id", "left")


def _paged(rows: DataFrame, commonness: DataFrame, ids: str, size: int, signed: bool) -> DataFrame:
    """(ids, vector) in pages, written once."""
    partitions = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = _by_genre(rows.withColumn("_id", F.xxhash64("vector", "ids")), commonness).repartitionByRange(partitions, "_key", "_id")
    sorted_ = ordered.sortWithinPartitions("_key", "_id").select("ids", "vector")
    return cut_lineage(sorted_.mapInArrow(bounds.pack(size, signed), bounds.PAGE_COLUMNS.format(id=ids)))


def _first_titles(profiles: DataFrame, k: int, ids: str) -> DataFrame:
    """A page of the 2k first titles: these fill up where fewer than k titles share anything with a query."""
    titles = profiles.select("vector", F.explode("members").alias("_title")).orderBy("_title").limit(2 * k)
    page = titles.select(F.array("_title").alias("ids"), "vector").coalesce(1)
    return page.mapInArrow(bounds.pack(2 * k, True), bounds.PAGE_COLUMNS.format(id=ids)).withColumn("page", F.lit(FILLER).cast("long"))


def _page_bounds(queries: DataFrame, pages: DataFrame) -> DataFrame:
    """(q_page, page, bound, promise) of pages that share a genre; no vector of a page has more than ``most`` genres.

    The promise is what all vectors of both pages score together: greatest where most of them are alike.
    """

    def entries(side: DataFrame, prefix: str) -> DataFrame:
        zipped = F.explode(F.arrays_zip("names", "tops", "lows", "sums")).alias("_e")
        return side.select(F.col("page").alias(prefix + "page"), "most", zipped).select(
            prefix + "page", F.col("most").alias(prefix + "most"), F.col("_e.names").alias("genre"),
            F.col("_e.tops").alias(prefix + "top"), F.col("_e.lows").alias(prefix + "low"), F.col("_e.sums").alias(prefix + "sum"),
        )

    met = entries(queries, "q_").join(entries(pages, ""), "genre")
    term = F.greatest(F.col("q_top") * F.col("top"), F.col("q_low") * F.col("low"))
    greatest = F.slice(F.sort_array(F.collect_list("_term"), asc=False), 1, F.greatest(F.lit(1), F.least("q_most", "most")))
    grouped = met.withColumn("_term", term).groupBy("q_page", "page", "q_most", "most")
    return grouped.agg(F.aggregate(greatest, F.lit(0.0), lambda a, b: a + b).alias("bound"), F.sum(F.col("q_sum") * F.col("sum")).alias("promise"))


def search(queries: DataFrame, profiles: DataFrame, k: int, signed: bool = False, page: int = PAGE, block: int = BLOCK) -> Search:
    """The k most similar titles per query: (query_id, title, similarity, position), ties by title.

    ``queries`` has (query_id, vector), ``profiles`` (profile, vector, members), members being the first k ids of
    the profile. Negative weights need ``signed``, by which all pages meet.
    """
    query_type = queries.schema["query_id"].dataType
    title_type = profiles.schema["members"].dataType.elementType
    ids, title = to_arrow_type(title_type), title_type.simpleString()
    commonness = cut_lineage(profiles.select(F.explode("vector.genre").alias("genre")).groupBy("genre").agg(F.count(F.lit(1)).alias("rows")))
    candidates = _paged(profiles.select(F.col("members").alias("ids"), "vector"), commonness, title, page, signed)
    asked = _paged(queries.select(F.array("query_id").alias("ids"), "vector"), commonness, query_type.simpleString(), page, signed)
    pairs = cut_lineage(_page_bounds(asked, candidates))
    best = Window.partitionBy("q_page").orderBy(F.desc("promise"), "page")
    first = pairs.withColumn("_n", F.row_number().over(best)).where("_n = 1").select("q_page", "page")
    all_pages = cut_lineage(candidates.unionByName(_first_titles(profiles, k, title)))
    first = first.unionByName(asked.select(F.col("page").alias("q_page"), F.lit(FILLER).cast("long").alias("page")))

    asked_pages, parallel = asked.count(), queries.sparkSession.sparkContext.defaultParallelism
    groups = max(1, min(GROUPS, asked_pages), math.ceil(asked_pages / GROUP_PAGES))
    slices = math.ceil(2 * parallel / groups)

    def scored(some: DataFrame, known: DataFrame) -> DataFrame:
        group, slice_ = F.pmod(F.xxhash64("q_page"), F.lit(groups)), F.pmod(F.xxhash64("page"), F.lit(slices))
        placed = some.withColumn("cell", (group * slices + slice_).cast("int"))
        wanted = placed.groupBy("cell", "page").agg(F.collect_list("q_page").alias("wanted")).join(all_pages, "page")
        holding = placed.select("cell", F.col("q_page").alias("page")).distinct().join(known.drop("ids"), "page")
        rows = holding.unionByName(wanted, allowMissingColumns=True).select(
            "cell", "page", "wanted", "ids", "held", "sizes", "genres", "weights", "names", "most", "floors", "lasts"
        )
        met = rows.repartitionById(groups * slices, "cell").sortWithinPartitions("cell", F.col("wanted").isNotNull(), "page")
        columns = f"q_page long, met long, multiplied long, found array<struct<at:int,title:{title},similarity:double>>"
        return cut_lineage(met.mapInArrow(bounds.score(k, block, ids, FILLER), columns))

    def ranked(results: DataFrame) -> DataFrame:
        rows = results.select("q_page", F.explode("found").alias("_f")).select("q_page", "_f.*").distinct()  # the filler repeats titles
        best_first = Window.partitionBy("q_page", "at").orderBy(F.desc("similarity"), "title")
        return rows.withColumn("position", F.row_number().over(best_first)).where(F.col("position") <= k)

    nothing = F.transform("held", lambda _: F.lit(float("-inf")))
    unknown = asked.withColumn("floors", nothing).withColumn("lasts", F.transform("held", lambda _: F.lit(None).cast(title_type)))
    opening = scored(first, unknown)
    kth = ranked(opening).where(F.col("position") == k).groupBy("q_page").agg(
        F.map_from_entries(F.collect_list(F.struct("at", F.struct("similarity", "title")))).alias("_kth"), F.count(F.lit(1)).alias("_known"),
        F.min("similarity").alias("_least"),
    )
    floored = asked.join(kth.withColumnRenamed("q_page", "page"), "page", "left")
    complete = F.col("_known") == F.size("held")
    floored = floored.withColumn("_least", F.when(complete, F.col("_least")).otherwise(F.lit(float("-inf"))))

    def of_query(field: str, default):
        return F.transform("held", lambda _, i: F.coalesce(F.col("_kth")[i][field], default))

    floored = cut_lineage(
        floored.withColumn("floors", of_query("similarity", F.lit(float("-inf")))).withColumn("lasts", of_query("title", F.lit(None).cast(title_type)))
    )
    least = floored.select(F.col("page").alias("q_page"), "_least")
    rest = pairs.join(first, ["q_page", "page"], "left_anti").join(least, "q_page").where(F.col("bound") + 2 * bounds.SLACK >= F.col("_least"))
    later = scored(rest.select("q_page", "page"), floored.drop("_kth", "_known", "_least"))
    results = opening.unionByName(later)
    names = asked.select(F.col("page").alias("q_page"), F.posexplode("ids").alias("at", "query_id"))
    found = ranked(results).join(names, ["q_page", "at"]).select("query_id", "title", "similarity", F.col("position").cast("int").alias("position"))
    vectors = asked.agg(F.count(F.lit(1)).alias("query_pages"), F.sum(F.size("held")).alias("_queries"))
    sizes = candidates.agg(F.count(F.lit(1)).alias("pages"), F.sum(F.ceil(F.size("held") / block)).alias("_blocks"))
    work = results.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("met", "multiplied")])
    one = F.lit(1).alias("_one")  # a row each
    counts = vectors.select("*", one).join(sizes.select("*", one), "_one").join(work.select("*", one), "_one")
    return Search(found, counts.select("query_pages", "pages", "met", (F.col("_queries") * F.col("_blocks")).alias("blocks"), "multiplied"))
