"""Summaries of sessions and the joins the analysis notebook starts from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmark.plans.joins import lookup_join, repeat_rows
from reelmark.plans.quantiles import exact_quantiles
from reelmark.session import cut_lineage

NUMERIC = ("session_span_minutes", "total_seconds_watched", "session_count", "completion_ratio")
TEXT = ("user_id", "item_id", "session_start_timestamp", "session_end_timestamp", "outcome")
HISTOGRAMS = ("total_seconds_watched", "session_span_minutes", "session_count")


def session_summary(sessions: DataFrame) -> DataFrame:
    return sessions.agg(
        F.countDistinct("user_id").alias("unique_users"),
        F.countDistinct("item_id").alias("unique_items"),
        F.count(F.lit(1)).alias("total_sessions"),
        F.avg("session_span_minutes").alias("avg_session_minutes"),
        F.avg(F.col("total_seconds_watched") / F.lit(60.0)).alias("avg_watch_minutes"),
    )


def outcome_distribution(sessions: DataFrame) -> DataFrame:
    """Sessions per outcome, most frequent first; equal counts go by name."""
    return (
        sessions.groupBy("outcome")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "outcome")
    )


def _long(rows: DataFrame, columns: tuple[str, ...], kind: str) -> DataFrame:
    """(metric, value): a row for each value of the columns that is not null."""
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast(kind).alias("value")) for c in columns])
    return rows.select(F.explode(pairs).alias("_p")).select("_p.metric", "_p.value").where(F.col("value").isNotNull())


def describe_sessions(
    sessions: DataFrame, numeric: tuple[str, ...] = NUMERIC, text: tuple[str, ...] = TEXT
) -> DataFrame:
    """One row per column: count, unique/top/freq of text, mean/std/min/quartiles/max of numbers, 2 digits.

    Among equally frequent texts the first in order is the top one.
    """
    narrow = cut_lineage(sessions.select(*numeric, *text))  # read by each of the passes below
    numbers = _long(narrow, numeric, "double")
    moments = numbers.groupBy("metric").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    quartiles = (
        exact_quantiles(numbers.withColumn("n", F.lit(1).cast("long")), [0.25, 0.5, 0.75])
        .groupBy("metric")
        .pivot("probability", [0.25, 0.5, 0.75])
        .agg(F.first("quantile"))
        .toDF("metric", "p25", "p50", "p75")
    )
    texts = (
        _long(narrow, text, "string")
        .groupBy("metric", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("metric")
        .agg(
            F.sum("n").alias("count"),
            F.count(F.lit(1)).alias("unique"),
            # least of (-n, value): the most frequent, ties by text
            F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("_top"),
        )
    )

    def rounded(name: str) -> Column:
        return F.round(name, 2).alias(name)

    figures = ("mean", "std", "min", "p25", "p50", "p75", "max")
    nothing = F.lit(None)
    numeric_rows = moments.join(quartiles, "metric").select(
        "metric",
        "count",
        nothing.cast("long").alias("unique"),
        nothing.cast("string").alias("top"),
        nothing.cast("long").alias("freq"),
        *[rounded(name) for name in figures],
    )
    text_rows = texts.select(
        "metric",
        "count",
        "unique",
        F.col("_top.value").alias("top"),
        (-F.col("_top.n")).alias("freq"),
        *[nothing.cast("double").alias(name) for name in figures],
    )
    return numeric_rows.unionByName(text_rows).withColumnRenamed("metric", "column_name")


def session_histograms(
    sessions: DataFrame, columns: tuple[str, ...] = HISTOGRAMS, bins: int = 50
) -> DataFrame:
    """Counts in equal bins from 0 to the column's maximum; the last bin includes the maximum.

    A column whose maximum is 0 gets the range -0.5 to 0.5, so its zeros land in the middle.
    """
    values = cut_lineage(sessions.select(*columns))
    greatest = values.agg(*[F.max(c).cast("double").alias(c) for c in columns]).first()
    ranges = [
        F.struct(F.lit(c).alias("metric"), F.lit(-0.5 if not top else 0.0).alias("low"), F.lit((top or 1.0) / float(bins)).alias("width"))
        for c, top in greatest.asDict().items()
        if top is not None
    ]
    nothing = F.lit(None).cast("struct<metric:string,low:double,width:double>")
    frame = values.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"), F.explode(F.array_compact(F.array(*ranges, nothing))).alias("_r"))
    frame = frame.select("bin", F.col("_r.metric").alias("metric"), F.col("_r.low").alias("_low"), F.col("_r.width").alias("_width"))
    # One pass: each value to its bin by constants, counted on the map side.
    limits = F.create_map(*[x for r in ranges for x in (r["metric"], r)])[F.col("metric")] if ranges else nothing
    number = F.least(F.floor((F.col("value") - limits["low"]) / limits["width"]), F.lit(bins - 1)) + 1
    counted = (
        _long(values, columns, "double")
        .where(F.col("value") >= limits["low"])
        .groupBy("metric", number.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # Bins times columns: a fixed size.
    return frame.join(F.broadcast(counted), ["metric", "bin"], "left").select(
        F.col("metric").alias("column_name"),
        "bin",
        (F.col("_low") + F.col("_width") * (F.col("bin") - 1)).alias("bin_start"),
        F.coalesce("n", F.lit(0)).alias("sessions"),
    )


def sessions_items_genres(sessions: DataFrame, library: DataFrame, genres: DataFrame) -> DataFrame:
    """(user_id, item_id, item_name, genre_name), one row per session and genre row of its item.

    An item's genre names are gathered per library item first, so the sessions, where one item may
    be a third of the rows, meet a lookup with one row per item.
    """
    per_item = (
        library.select("item_id", "item_name")
        .join(
            # Bounded by one item's genre rows, which come from one catalogue document.
            genres.groupBy("item_id", "genre_name")
            .agg(F.count(F.lit(1)).alias("n"))
            .groupBy("item_id")
            .agg(F.collect_list(F.struct("genre_name", "n")).alias("_genres")),
            "item_id",
        )
    )
    joined = lookup_join(
        sessions.select("user_id", "item_id", "session_start_timestamp"),
        per_item,
        "item_id",
        "inner",
        salt_on=["user_id", "session_start_timestamp"],
    )
    rows = joined.select("user_id", "item_id", "item_name", F.explode("_genres").alias("_g"))
    return repeat_rows(
        rows.select("user_id", "item_id", "item_name", "_g.genre_name", F.col("_g.n").alias("_n")), "_n"
    )


def stats_with_item_names(stats: DataFrame, library: DataFrame) -> DataFrame:
    """Statistics under their report names, with the item's name."""
    named = lookup_join(stats, library.select("item_id", "item_name"), "item_id", "left", salt_on=["user_id"])
    return named.select(
        "user_id",
        "item_id",
        "item_name",
        F.col("total_sessions").alias("num_plays"),
        "total_minutes_watched",
        F.col("average_completion_ratio").alias("avg_fraction_completed"),
        F.col("first_watched_timestamp").alias("first_watch_at"),
        F.col("last_watched_timestamp").alias("last_watch_at"),
    )


def head_items(rows: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    """The first n rows in the given order."""
    return rows.orderBy(*order).limit(n)


def column_rename(rows: DataFrame, names: list[str]) -> DataFrame:
    """Positional columns to named ones."""
    return rows.toDF(*names)


def table_row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table, largest first."""
    counts = [
        rows.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, rows in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts).orderBy(F.desc("row_count"), "table_name")


def _firsts_of_user(counted: DataFrame, name: str, measure: str, n: int) -> DataFrame:
    """The n greatest per user, ties by name; the cut is applied before the shuffle too."""
    order = Window.partitionBy("user_id").orderBy(F.desc(measure), name)
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def top_genres_of_users(sessions: DataFrame, genres: DataFrame, n: int = 5) -> DataFrame:
    """Each user's most common genres: (user_id, rank, genre_name, sessions), a session counting once for each genre of its item.

    Sessions are counted per user and item before they meet the genres, so a hot item or user joins as one row each.
    """
    per_item = sessions.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("_n"))
    of_item = genres.where(F.col("genre_name").isNotNull()).groupBy("item_id").agg(F.collect_set("genre_name").alias("_genres"))
    joined = lookup_join(per_item, of_item, "item_id", "inner", salt_on=["user_id"])
    counted = joined.select("user_id", "_n", F.explode("_genres").alias("genre_name")).groupBy("user_id", "genre_name").agg(
        F.sum("_n").alias("sessions")
    )
    return _firsts_of_user(counted, "genre_name", "sessions", n).select("user_id", "rank", "genre_name", "sessions")


def top_items_of_users(stats: DataFrame, library: DataFrame, n: int = 5) -> DataFrame:
    """Each user's most watched items: (user_id, rank, item_id, item_name, total_seconds_watched), ties by id."""
    firsts = _firsts_of_user(stats.select("user_id", "item_id", "total_seconds_watched"), "item_id", "total_seconds_watched", n)
    named = lookup_join(firsts, library.select("item_id", "item_name"), "item_id", "left", salt_on=["user_id"])
    return named.select("user_id", "rank", "item_id", "item_name", "total_seconds_watched")
