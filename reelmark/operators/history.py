"""Playback events to sessions to per-user, per-item statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmark.functions import scalars as fn
from reelmark.plans.joins import lookup_join, null_safe_join

# Playback times before this moment were logged seven hours behind UTC, later ones ten ahead.
CLOCK_CUTOFF = "2025-08-15 11:10:00"
CLOCK_SHIFT_HOURS = 17

# Assumed runtimes (seconds) where the library has none.
EPISODE_SECONDS = 1500.0
MOVIE_SECONDS = 7200.0
EPISODE_ADHERENCE_SECONDS = 3600.0

# Outcome thresholds (seconds: completed, partial, sampled) where the library has no runtime.
EPISODE_OUTCOME_SECONDS = (1200, 300, 60)
MOVIE_OUTCOME_SECONDS = (5400, 1800, 300)

PAIR = ["user_id", "item_id"]


def project_raw_event(events: DataFrame) -> DataFrame:
    """Nine stored columns plus the parsed timestamp; a duration that is no number fails the job."""
    return events.select(
        "date",
        "time",
        "user_id",
        "item_name",
        "item_id",
        "item_type",
        F.col("duration").cast("long").alias("duration"),
        F.coalesce("remote_address", F.lit("")).alias("remote_address"),
        "user_name",
        fn.parse_ts(F.col("date"), F.col("time")).alias("event_ts"),
    )


def normalize_tz(events: DataFrame, cutoff: str = CLOCK_CUTOFF, shift_hours: int = CLOCK_SHIFT_HOURS) -> DataFrame:
    """Shift events logged strictly before ``cutoff``; the date and time text follow the new clock."""
    moment = F.col("event_ts")
    shifted = F.when(
        moment < F.lit(cutoff).cast("timestamp"), fn.add_hours(moment, shift_hours)
    ).otherwise(moment)
    return (
        events.withColumn("event_ts", shifted)
        .withColumn("date", F.date_format("event_ts", "yyyy-MM-dd"))
        .withColumn("time", F.date_format("event_ts", "HH:mm:ss"))
    )


def _slot(ts: Column, gap_minutes: int) -> Column:
    # Two events of one slot are at most `gap` seconds apart, so a slot never straddles two sessions.
    return F.floor(F.unix_timestamp(ts) / F.lit(gap_minutes * 60 + 1))


def _starts_session(previous_end: Column, start: Column, gap_minutes: int) -> Column:
    return previous_end.isNull() | (fn.seconds_between(previous_end, start) > gap_minutes * 60)


def _kind_rank(item_type: Column) -> Column:
    # Keeps string order around the two names that matter, so max() works on a number: that lets Spark
    # aggregate by hash, where a max over strings would sort the events.
    return (
        F.when(item_type > "Movie", 4)
        .when(item_type == "Movie", 3)
        .when(item_type > "Episode", 2)
        .when(item_type == "Episode", 1)
        .otherwise(0)
    )


def _kind_name(rank: Column) -> Column:
    return F.when(rank == 3, "Movie").when(rank == 1, "Episode")


def gap_sessions(events: DataFrame, gap_minutes: int = 15) -> DataFrame:
    """Sessions of each (user, item): a gap of more than ``gap_minutes`` starts the next one.

    ``item_kind`` is the greatest item type of the session if that is Movie or Episode, else null.

    Events are first combined per time slot no wider than the gap. That runs before the shuffle, so
    copies and bursts collapse on the map side, and it bounds what a window partition can hold by
    (time span / gap) whatever the number of events of the pair.
    """
    slots = events.groupBy(*PAIR, _slot(F.col("event_ts"), gap_minutes).alias("_slot")).agg(
        F.min("event_ts").alias("_start"),
        F.max("event_ts").alias("_end"),
        F.sum("duration").alias("_seconds"),
        F.count(F.lit(1)).alias("_events"),
        F.max(_kind_rank(F.col("item_type"))).alias("_rank"),
    )
    in_order = Window.partitionBy(*PAIR).orderBy("_slot")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        slots.withColumn("_previous_end", F.lag("_end").over(in_order))
        .withColumn(
            "_boundary", _starts_session(F.col("_previous_end"), F.col("_start"), gap_minutes).cast("long")
        )
        .withColumn("session_group_id", F.sum("_boundary").over(so_far))
        .groupBy(*PAIR, "session_group_id")
        .agg(
            F.min("_start").alias("session_start_timestamp"),
            F.max("_end").alias("session_end_timestamp"),
            F.sum("_seconds").alias("total_seconds_watched"),
            F.sum("_events").alias("session_count"),
            F.max("_rank").alias("_rank"),
        )
        .withColumn("item_kind", _kind_name(F.col("_rank")))
        .drop("_rank")
    )


def _distinct_moments(events: DataFrame, gap_minutes: int) -> DataFrame:
    """One row per (user, item, second) with the previous distinct second and the session number.

    Two windows replace one over the whole pair: the first is bounded by the seconds of a slot, the
    second by the number of slots.
    """
    slot = _slot(F.col("event_ts"), gap_minutes).alias("_slot")
    moments = events.groupBy(*PAIR, slot, "event_ts").agg(F.min("row_id").alias("_first_row"))
    in_slot = Window.partitionBy(*PAIR, "_slot").orderBy("event_ts")
    moments = moments.withColumn("_previous_in_slot", F.lag("event_ts").over(in_slot))
    across = Window.partitionBy(*PAIR).orderBy("_slot")
    slots = (
        moments.groupBy(*PAIR, "_slot")
        .agg(F.min("event_ts").alias("_start"), F.max("event_ts").alias("_end"))
        .withColumn("_previous_end", F.lag("_end").over(across))
        .withColumn(
            "_boundary", _starts_session(F.col("_previous_end"), F.col("_start"), gap_minutes).cast("int")
        )
        .withColumn(
            "session_group_id",
            F.sum("_boundary").over(across.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        )
    )
    return null_safe_join(moments, slots, [*PAIR, "_slot"], "inner").select(
        *PAIR,
        "event_ts",
        "_first_row",
        F.coalesce("_previous_in_slot", "_previous_end").alias("_previous"),
        F.when(F.col("_previous_in_slot").isNull(), F.col("_boundary")).otherwise(0).alias("_boundary"),
        "session_group_id",
    )


def mark_sessions(events: DataFrame, gap_minutes: int = 15) -> DataFrame:
    """Each event with the previous event's time, a new-session flag and its session number.

    Order within a pair is (event_ts, row_id): of the events in one second only the first looks back
    to an earlier second. All pairs go through their distinct moments, which bounds every window by time.
    Events without a time come first and are one session; a null user or item is a user or item like others.
    """
    marked = null_safe_join(events, _distinct_moments(events, gap_minutes), [*PAIR, "event_ts"])
    first = F.col("row_id") == F.col("_first_row")
    return marked.select(
        *[F.col(f"`{c}`") for c in events.columns],
        F.when(first, F.col("_previous")).otherwise(F.col("event_ts")).alias("prev_event_timestamp"),
        F.when(first, F.col("_boundary")).otherwise(0).cast("int").alias("is_new_session"),
        F.col("session_group_id").cast("long").alias("session_group_id"),
    )


def with_runtime(facts: DataFrame, library: DataFrame, salt_on: list[str]) -> DataFrame:
    """Left-join the library's runtime (seconds) and type by item."""
    lookup = library.select(
        "item_id",
        F.col("runtime_seconds").alias("_runtime"),
        F.col("item_type").alias("_library_type"),
    )
    return lookup_join(facts, lookup, "item_id", "left", salt_on=salt_on)


def _completion_ratio(watched: Column, runtime: Column, item_type: Column) -> Column:
    return (
        F.when(runtime > 0, fn.cap(watched / runtime))
        .when(item_type == "Episode", fn.cap(watched / F.lit(EPISODE_SECONDS)))
        .when(item_type == "Movie", fn.cap(watched / F.lit(MOVIE_SECONDS)))
    )


def _grade(watched: Column, completed, partial, sampled) -> Column:
    return (
        F.when(watched >= completed, "completed")
        .when(watched >= partial, "partial")
        .when(watched >= sampled, "sampled")
        .otherwise("abandoned")
    )


def sessions_agg(
    events: DataFrame,
    library: DataFrame,
    gap_minutes: int = 15,
    completed_ratio: float = 0.9,
    partial_ratio: float = 0.25,
    min_sampled_seconds: int = 60,
) -> DataFrame:
    """Sessions with span, watched seconds, completion ratio and outcome."""
    sessions = with_runtime(
        gap_sessions(events, gap_minutes), library, ["user_id", "session_start_timestamp"]
    )
    watched, runtime, item_type = F.col("total_seconds_watched"), F.col("_runtime"), F.col("item_kind")
    start, end = F.col("session_start_timestamp"), F.col("session_end_timestamp")
    outcome = (
        F.when(
            runtime > 0,
            _grade(
                watched,
                F.lit(float(completed_ratio)) * runtime,
                F.lit(float(partial_ratio)) * runtime,
                F.lit(int(min_sampled_seconds)),
            ),
        )
        .when(item_type == "Episode", _grade(watched, *map(F.lit, EPISODE_OUTCOME_SECONDS)))
        .when(item_type == "Movie", _grade(watched, *map(F.lit, MOVIE_OUTCOME_SECONDS)))
        .otherwise("unknown")
    )
    return sessions.select(
        fn.content_key(F.col("user_id"), F.col("item_id"), start).alias("session_id"),
        "user_id",
        "item_id",
        start,
        end,
        fn.whole_minutes_between(start, end).alias("session_span_minutes"),
        watched,
        "session_count",
        _completion_ratio(watched, runtime, item_type).alias("completion_ratio"),
        outcome.alias("outcome"),
    )


def conditional_counts() -> list[Column]:
    """One count per graded outcome; `unknown` sessions are in none of them."""
    return [
        F.sum(F.when(F.col("outcome") == name, 1).otherwise(0)).alias(f"{name}_sessions")
        for name in ("completed", "partial", "abandoned", "sampled")
    ]


def user_item_stats(sessions: DataFrame, library: DataFrame) -> DataFrame:
    """Engagement of each (user, item); the library is joined to the grouped rows, not to the sessions."""
    grouped = sessions.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("total_sessions"),
        F.sum("total_seconds_watched").alias("total_seconds_watched"),
        F.max("total_seconds_watched").alias("_longest"),
        F.avg("total_seconds_watched").alias("_mean"),
        F.min("session_start_timestamp").alias("first_watched_timestamp"),
        F.max("session_end_timestamp").alias("last_watched_timestamp"),
        *conditional_counts(),
    )
    rows = with_runtime(grouped, library, ["user_id"])
    runtime, kind = F.col("_runtime"), F.col("_library_type")
    count, total = F.col("total_sessions"), F.col("total_seconds_watched")
    longest, mean = F.col("_longest"), F.col("_mean")

    def by_kind(known: Column, episode: Column, movie: Column) -> Column:
        return (
            F.when(runtime > 0, known)
            .when(kind == "Episode", episode)
            .when(kind == "Movie", movie)
            .otherwise(F.lit(0.0))
        )

    def share(seconds: Column) -> Column:
        return by_kind(
            fn.cap(seconds / runtime),
            fn.cap(seconds / F.lit(EPISODE_SECONDS)),
            fn.cap(seconds / F.lit(MOVIE_SECONDS)),
        )

    def blend(weights, reach: Column, enough: float, volume: Column) -> Column:
        best_weight, count_weight, volume_weight = map(F.lit, weights)
        return (
            best_weight * fn.cap(reach) + count_weight * fn.cap(count / F.lit(enough)) + volume_weight * fn.cap(volume)
        )

    # Weights of best share, session count and total volume, and the count that is "enough".
    adherence = by_kind(
        blend((0.6, 0.3, 0.1), longest / runtime, 3.0, total / runtime),
        blend((0.6, 0.3, 0.1), longest / F.lit(EPISODE_SECONDS), 3.0, total / F.lit(EPISODE_ADHERENCE_SECONDS)),
        blend((0.7, 0.2, 0.1), longest / F.lit(MOVIE_SECONDS), 2.0, total / F.lit(MOVIE_SECONDS)),
    )
    first, last = F.col("first_watched_timestamp"), F.col("last_watched_timestamp")
    return rows.select(
        fn.content_key(F.col("user_id"), F.col("item_id")).alias("stat_id"),
        "user_id",
        "item_id",
        "total_sessions",
        "total_seconds_watched",
        (total / F.lit(60.0)).alias("total_minutes_watched"),
        share(longest).alias("best_completion_ratio"),
        share(mean).alias("average_completion_ratio"),
        (count - 1).alias("rewatch_count"),
        first,
        last,
        fn.days_between(first, last).alias("days_between_first_last"),
        adherence.alias("adherence_score"),
        "completed_sessions",
        "partial_sessions",
        "abandoned_sessions",
        "sampled_sessions",
    )


def update_completion_ratios(sessions: DataFrame, library: DataFrame) -> DataFrame:
    """Recompute the ratio wherever the library now has a runtime; nothing else changes."""
    runtimes = runtimes_known(library).select("item_id", F.col("runtime_seconds").alias("_runtime"))
    rows = lookup_join(sessions, runtimes, "item_id", "left", salt_on=["user_id", "session_start_timestamp"])
    ratio = F.when(
        F.col("_runtime").isNotNull(), fn.cap(F.col("total_seconds_watched") / F.col("_runtime"))
    ).otherwise(F.col("completion_ratio"))
    return rows.withColumn("completion_ratio", ratio).select(*sessions.columns)


def runtimes_known(library: DataFrame) -> DataFrame:
    return library.where(F.col("runtime_seconds") > 0)


def filter_exists_runtime(sessions: DataFrame, library: DataFrame) -> DataFrame:
    """Sessions whose item has a positive runtime in the library."""
    return lookup_join(
        sessions,
        runtimes_known(library).select("item_id"),
        "item_id",
        "left_semi",
        salt_on=["user_id", "session_start_timestamp"],
    )
