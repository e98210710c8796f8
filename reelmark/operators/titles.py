"""Film/TV metadata: list columns to rows, and genre encodings of titles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmark.functions import scalars as fn
from reelmark.plans.joins import lookup_join



def filter_nonblank(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(fn.not_blank(F.col(column)))


def lateral_split(rows: DataFrame, column: str, alias: str, keep: str = "t_const") -> DataFrame:
    """One row per element of a comma-separated column; rows with a null or empty list give none."""
    return filter_nonblank(rows, column).select(keep, F.explode(fn.split_csv(F.col(column))).alias(alias))


def titles_genres_join(titles: DataFrame, genres: DataFrame) -> DataFrame:
    """(t_const, primary_name, genre); ``titles`` has one row per t_const."""
    return lookup_join(
        genres.select("t_const", "genre"), titles.select("t_const", "primary_name"), "t_const", "inner"
    ).select("t_const", "primary_name", "genre")


def genre_counts(titles_genres: DataFrame) -> DataFrame:
    """How often each title carries each genre; repeated tags add up, titles without a name drop out."""
    return (
        titles_genres.where(F.col("primary_name").isNotNull())
        .groupBy("t_const", "primary_name", "genre")
        .agg(F.count(F.lit(1)).alias("weight"))
    )


def title_genre_counts(titles: DataFrame, genres: DataFrame) -> DataFrame:
    """The same counts straight from the two tables.

    Tags are counted before the join, so a title has at most one row per genre there and no title can
    be hot; the join's partitioning by title then also serves the encodings that group by it.
    """
    counted = genres.groupBy("t_const", "genre").agg(F.count(F.lit(1)).alias("weight"))
    named = titles.where(F.col("primary_name").isNotNull()).select("t_const", "primary_name")
    return counted.join(named, "t_const").select("t_const", "primary_name", "genre", "weight")


def genre_values(rows: DataFrame) -> list[str]:
    """Sorted genre names; they become columns, so the vocabulary, not the titles, comes to the driver."""
    found = rows.where(F.col("genre").isNotNull()).select("genre").distinct().collect()
    return sorted(row.genre for row in found)


def onehot_genres(counts: DataFrame, genres: list[str] | None = None) -> DataFrame:
    """One row per (t_const, primary_name), one ``genre_*`` count column per genre in sorted order.

    Genres that differ only by case need ``spark.sql.caseSensitive`` to be columns of one table.
    """
    values = genre_values(counts) if genres is None else genres
    if not values:
        return counts.select("t_const", "primary_name").distinct()
    wide = counts.groupBy("t_const", "primary_name").pivot("genre", values).agg(F.sum("weight").cast("int"))
    return wide.select(
        "t_const",
        "primary_name",
        *[F.coalesce(F.col(f"`{value}`"), F.lit(0)).alias(f"genre_{value}") for value in values],
    )


def select_genre_columns(encoded: DataFrame) -> list[str]:
    return [name for name in encoded.columns if name.startswith("genre_")]


def genre_vectors(counts: DataFrame) -> DataFrame:
    """One row per title with its vector as a sorted list of (genre, weight).

    A title whose only genres are null keeps an empty list, the zero vector. The list is bounded by
    the number of distinct genres because repeated tags are counted first.
    """
    entry = F.when(F.col("genre").isNotNull(), F.struct("genre", F.col("weight").cast("double").alias("weight")))
    return counts.groupBy("t_const", "primary_name").agg(F.sort_array(F.collect_list(entry)).alias("vector"))


def encoded_to_vectors(encoded: DataFrame) -> DataFrame:
    """The same vectors from the wide encoding: its non-zero ``genre_*`` cells."""
    cells = [
        F.struct(F.lit(name[len("genre_"):]).alias("genre"), F.col(f"`{name}`").cast("double").alias("weight"))
        for name in select_genre_columns(encoded)
    ]
    nonzero = F.filter(F.array(*cells), lambda cell: cell["weight"] != 0)
    return encoded.select("t_const", "primary_name", F.sort_array(nonzero).alias("vector"))
