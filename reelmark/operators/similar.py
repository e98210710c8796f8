"""Cosine neighbours of titles and of users' tastes.

Titles that carry the same genres have the same vector, so the work is done once per distinct
normalised vector (a *profile*) and spread to the titles afterwards.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmark.functions.blocks import DIGITS, nearest_in_block
from reelmark.operators import nearest
from reelmark.plans.joins import lookup_join
from reelmark.session import cut_lineage

QUERY_BLOCK = 4096  # most query vectors in one task
CANDIDATE_BLOCK = 20_000  # most candidate vectors in one task


def _norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, e: acc + e["weight"] * e["weight"]))


def normalize_vectors(titles: DataFrame) -> DataFrame:
    """Scale each ``vector`` to length one; the zero vector (an empty list) stays as it is."""
    norm = _norm(F.col("vector"))
    unit = F.transform(
        "vector", lambda e: F.struct(e["genre"].alias("genre"), (e["weight"] / norm).alias("weight"))
    )
    return titles.withColumn("vector", F.when(norm > 0, unit).otherwise(F.col("vector")))


def l2_normalize(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Scale dense array vectors to length one, row by row; zero rows stay zero."""
    values = F.transform(column, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x * x))
    return vectors.withColumn(
        column, F.when(norm > 0, F.transform(values, lambda x: x / norm)).otherwise(values)
    )


def dense_to_vector(column: str) -> Column:
    """A dense array as a list of (genre, weight), the genre being the position."""
    return F.transform(
        column,
        lambda x, i: F.struct(
            F.lpad(i.cast("string"), 6, "0").alias("genre"), x.cast("double").alias("weight")
        ),
    )


# ---- exact k nearest by blocks -------------------------------------------------------------


def title_profiles(vectors: DataFrame, id_column: str = "t_const") -> DataFrame:
    """(title, profile, vector): unit vectors with a key for each distinct one.

    Written once: every search and taste below reads it, some of them more than once.
    """
    unit = normalize_vectors(vectors).select(F.col(id_column).alias("title"), "vector")
    return cut_lineage(unit.withColumn("profile", F.md5(F.to_json("vector").cast("binary"))))


def _first_members(titles: DataFrame, k: int) -> DataFrame:
    """Profiles with the k smallest title ids that share them: (profile, vector, members).

    All titles of a profile are equally near, so ties go by id and later ones can never place. The
    ranked filter is applied on the map side too, so a profile held by a third of all titles still
    sends k rows per task.
    """
    by_id = Window.partitionBy("profile").orderBy("title")
    return (
        titles.withColumn("_n", F.row_number().over(by_id))
        .where(F.col("_n") <= k)
        .groupBy("profile")
        .agg(F.any_value("vector").alias("vector"), F.sort_array(F.collect_list("title")).alias("members"))
    )


def _numbers(count: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))


def nearest_titles(queries: DataFrame, profiles: DataFrame, k: int) -> DataFrame:
    """The k most similar titles per query: (query_id, title, similarity, position).

    ``queries`` has (query_id, vector), ``profiles`` (profile, vector, members), members being the
    first k ids of the profile. Blocks of queries meet blocks of profiles in one task, which multiplies
    two small matrices and hands on k titles per query; scored pairs never become rows.
    """
    spark = queries.sparkSession
    query_count, profile_count = queries.count(), profiles.count()
    parallel = spark.sparkContext.defaultParallelism
    candidate_blocks = max(1, math.ceil(profile_count / CANDIDATE_BLOCK))
    query_blocks = max(
        math.ceil(query_count / QUERY_BLOCK),
        min(math.ceil(query_count / 256), math.ceil(parallel / candidate_blocks)),
        1,
    )
    sparse = (
        F.transform("vector", lambda e: e["genre"]).alias("genres"),
        F.transform("vector", lambda e: e["weight"]).alias("weights"),
    )
    left = queries.select(
        "query_id",
        *sparse,
        F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).alias("_query_block"),
        F.explode(_numbers(candidate_blocks)).alias("_candidate_block"),
    )
    right = profiles.select(
        *sparse,
        "members",
        F.explode(_numbers(query_blocks)).alias("_query_block"),
        F.pmod(F.xxhash64("profile"), F.lit(candidate_blocks)).alias("_candidate_block"),
    )
    block = ["_query_block", "_candidate_block"]
    id_type = queries.schema["query_id"].dataType.simpleString()
    title_type = profiles.schema["members"].dataType.elementType.simpleString()
    scored = (
        left.groupBy(*block)
        .cogroup(right.groupBy(*block))
        .applyInPandas(
            nearest_in_block(k), f"query_id {id_type}, title {title_type}, similarity double"
        )
    )
    best_first = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "title")
    return scored.withColumn("position", F.row_number().over(best_first)).where(F.col("position") <= k)


def similar_search(titles: DataFrame, k: int, of: DataFrame | None = None, signed: bool = False) -> tuple[DataFrame, nearest.Search]:
    """The titles asked for, and for each profile of theirs the k + 1 nearest titles of all."""
    profiles = cut_lineage(_first_members(titles, k + 1))
    if of is None:
        asked, queries = titles, profiles
    else:
        asked = cut_lineage(lookup_join(titles, of.select("title").distinct(), "title", "left_semi"))
        queries = cut_lineage(asked.groupBy("profile").agg(F.any_value("vector").alias("vector")))
    return asked, nearest.search(queries.select(F.col("profile").alias("query_id"), "vector"), profiles, k + 1, signed)


def knn_similar_titles(titles: DataFrame, k: int = 5, of: DataFrame | None = None, signed: bool = False) -> DataFrame:
    """The k nearest other titles of every title: (title, rank, neighbour, distance).

    ``titles`` comes from `title_profiles`; ``of``, a frame with the titles to ask for, narrows the
    questions but not the answers. distance = 1 - cosine, ties by id. The title itself is
    left out by id, so k + 1 are fetched per profile; titles sharing nothing have distance 1 and fill
    up when fewer than k overlap. Negative weights need ``signed``.
    """
    asked, found = similar_search(titles, k, of, signed)
    # Written so that the join below knows its size: usually small enough to broadcast.
    best = cut_lineage(
        found.found
        .groupBy(F.col("query_id").alias("profile"))
        .agg(F.sort_array(F.collect_list(F.struct("position", "title", "similarity"))).alias("_best"))
    )
    keyed = asked.select("profile", F.col("title").alias("_self"))
    found = lookup_join(keyed, best, "profile", "inner", salt_on=["_self"])
    others = F.slice(F.filter("_best", lambda e: e["title"] != F.col("_self")), 1, k)
    return found.select(
        F.col("_self").alias("title"), F.posexplode(others).alias("_n", "_e")
    ).select(
        "title",
        (F.col("_n") + 1).alias("rank"),
        F.col("_e.title").alias("neighbour"),
        F.round(F.lit(1.0) - F.col("_e.similarity"), DIGITS).alias("distance"),
    )


def user_taste_vector(watched: DataFrame, titles: DataFrame) -> DataFrame:
    """Each user's weighted mean of the unit vectors watched, scaled to length one, in long form.

    ``watched`` has (user_id, title, weight), one row per viewing; null weights count for nothing.
    ``titles`` comes from `title_profiles`. Users whose weights add up to zero have no mean and drop out.
    """
    per_title = (
        watched.where(F.col("weight").isNotNull())
        .groupBy("user_id", "title")
        .agg(F.sum("weight").alias("weight"))
    )
    rows = lookup_join(per_title, titles.select("title", "vector"), "title", "inner", salt_on=["user_id"])
    # An entry of weight one without a genre rides along, so one grouping yields sums and total weight.
    total_entry = F.array(F.struct(F.lit(None).cast("string").alias("genre"), F.lit(1.0).alias("weight")))
    summed = (
        rows.select("user_id", F.col("weight").alias("_w"), F.explode(F.concat("vector", total_entry)).alias("_e"))
        .groupBy("user_id", F.col("_e.genre").alias("genre"))
        .agg(F.sum(F.col("_w") * F.col("_e.weight")).alias("_sum"))
    )
    # A user's rows are bounded by the number of genres from here on.
    of_user = Window.partitionBy("user_id")
    total = F.max(F.when(F.col("genre").isNull(), F.col("_sum"))).over(of_user)
    mean = (
        summed.withColumn("_total", total)
        .where(F.col("genre").isNotNull() & (F.col("_total") != 0))
        .withColumn("_mean", F.col("_sum") / F.col("_total"))
        .withColumn("_norm", F.sqrt(F.sum(F.col("_mean") * F.col("_mean")).over(of_user)))
    )
    return mean.where(F.col("_norm") > 0).select(
        "user_id", "genre", (F.col("_mean") / F.col("_norm")).alias("weight")
    )


def knn_for_user(taste: DataFrame, titles: DataFrame, k: int = 20) -> DataFrame:
    """The k titles nearest to each user's taste, watched ones included: (user_id, rank, title, distance)."""
    profiles = cut_lineage(_first_members(titles, k))
    queries = cut_lineage(
        taste.groupBy(F.col("user_id").alias("query_id")).agg(
            F.sort_array(F.collect_list(F.struct("genre", "weight"))).alias("vector")
        )
    )
    return nearest.search(queries, profiles, k).found.select(
        F.col("query_id").alias("user_id"),
        F.col("position").alias("rank"),
        "title",
        F.round(F.lit(1.0) - F.col("similarity"), DIGITS).alias("distance"),
    )
