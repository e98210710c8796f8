from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import rows
from reelmark.operators import history
from reelmark.plans import joins

START = datetime(2025, 9, 1, 12, 0, 0)


def make_events(spark, events):
    """(user, item, type, seconds after START, duration) to raw events."""
    data = [
        (i, u, item, kind, START + timedelta(seconds=at), d) for i, (u, item, kind, at, d) in enumerate(events)
    ]
    return spark.createDataFrame(
        data, "row_id long, user_id string, item_id string, item_type string, event_ts timestamp, duration long"
    )


def make_library(spark, items):
    return spark.createDataFrame(items, "item_id string, item_type string, runtime_seconds long")


def brute_sessions(events, gap_seconds):
    """(user, item) -> list of (start, end, watched, count), event by event."""
    found = {}
    for user, item, _, at, duration in sorted(events, key=lambda e: (e[0], e[1], e[3])):
        sessions = found.setdefault((user, item), [])
        if sessions and at - sessions[-1][1] <= gap_seconds:
            start, _, watched, count = sessions[-1]
            sessions[-1] = (start, at, watched + duration, count + 1)
        else:
            sessions.append((at, at, duration, 1))
    return found


def as_brute(df):
    found = {}
    for r in df.orderBy("session_start_timestamp").collect():
        found.setdefault((r.user_id, r.item_id), []).append(
            (
                int((r.session_start_timestamp - START).total_seconds()),
                int((r.session_end_timestamp - START).total_seconds()),
                r.total_seconds_watched,
                r.session_count,
            )
        )
    return found


@pytest.mark.parametrize("gap,sessions", [(899, 1), (900, 1), (901, 2)])
def test_gap_is_exclusive(spark, gap, sessions):
    events = make_events(spark, [("u", "1", "Movie", 0, 10), ("u", "1", "Movie", gap, 10)])
    assert history.gap_sessions(events, 15).count() == sessions


@pytest.mark.parametrize("gap_minutes", [0, 1, 15, 600])
def test_sessions_equal_event_by_event(spark, gap_minutes):
    rng = random.Random(gap_minutes)
    events = [
        (f"u{rng.randrange(3)}", str(rng.randrange(3)), "Movie", rng.choice([rng.randrange(90000), rng.randrange(50) * 60]), rng.randrange(100))
        for _ in range(600)
    ]
    got = as_brute(history.gap_sessions(make_events(spark, events), gap_minutes))
    assert got == brute_sessions(events, gap_minutes * 60)


def test_sessions_before_the_epoch(spark):
    at = -int(START.timestamp())
    events = [("u", "1", "Movie", at + s, 1) for s in (-1000, -100, 100, 1001)]
    assert as_brute(history.gap_sessions(make_events(spark, events), 15)) == brute_sessions(events, 900)


def test_hot_pair_and_copies(spark):
    """A pair with most of the rows, many of them copies, collapses to a few slots before the window."""
    events = [("hot", "1", "Movie", (i % 40) * 10, 1) for i in range(4000)] + [("u", "2", "Movie", 0, 1)]
    sessions = history.gap_sessions(make_events(spark, events), 15)
    assert as_brute(sessions) == brute_sessions(events, 900)


def test_marks_equal_lag(spark):
    rng = random.Random(5)
    events = [("u", str(rng.randrange(3) // 2), "Movie", rng.randrange(60) * 100, 1) for _ in range(200)]
    got = {r.row_id: r for r in history.mark_sessions(make_events(spark, events), 5).collect()}
    assert len(got) == len(events)
    order = sorted(range(len(events)), key=lambda i: (events[i][1], events[i][3], i))
    group, previous = 0, None
    for i in order:
        at = events[i][3]
        if previous is None or events[previous][1] != events[i][1]:
            want_prev, boundary, group = None, 1, 1
        else:
            want_prev = START + timedelta(seconds=events[previous][3])
            boundary = int(at - events[previous][3] > 300)
            group += boundary
        previous = i
        assert (got[i].prev_event_timestamp, got[i].is_new_session, got[i].session_group_id) == (
            want_prev, boundary, group,
        )


@pytest.mark.parametrize(
    "runtime,kind,watched,outcome,ratio",
    [
        (1000, "Movie", 900, "completed", 0.9),
        (1000, "Movie", 899, "partial", 0.899),
        (1000, "Movie", 250, "partial", 0.25),
        (1000, "Movie", 249, "sampled", 0.249),
        (1000, "Movie", 60, "sampled", 0.06),
        (1000, "Movie", 59, "abandoned", 0.059),
        (1000, "Trailer", 5000, "completed", 1.0),
        (None, "Episode", 1200, "completed", 0.8),
        (None, "Episode", 1199, "partial", 1199 / 1500),
        (None, "Episode", 300, "partial", 0.2),
        (0, "Episode", 299, "sampled", 299 / 1500),
        (None, "Episode", 60, "sampled", 0.04),
        (None, "Episode", 59, "abandoned", 59 / 1500),
        (None, "Movie", 5400, "completed", 0.75),
        (None, "Movie", 5399, "partial", 5399 / 7200),
        (None, "Movie", 1800, "partial", 0.25),
        (None, "Movie", 1799, "sampled", 1799 / 7200),
        (None, "Movie", 300, "sampled", 300 / 7200),
        (None, "Movie", 299, "abandoned", 299 / 7200),
        (None, "Trailer", 9999, "unknown", None),
    ],
)
def test_outcome_and_ratio(spark, runtime, kind, watched, outcome, ratio):
    # the library calls it something else: a session goes by its events' type
    library = make_library(spark, [("1", "Other", runtime)])
    row = history.sessions_agg(make_events(spark, [("u", "1", kind, 0, watched)]), library).first()
    assert row.outcome == outcome
    assert row.completion_ratio == (None if ratio is None else pytest.approx(ratio))


def test_mixed_types_take_the_greatest(spark):
    events = [("u", "1", k, i, 400) for i, k in enumerate(["Episode", "Movie"])]
    events += [("u", "2", k, i, 400) for i, k in enumerate(["Movie", "Trailer"])]
    events += [("u", "3", k, i, 400) for i, k in enumerate(["Audio", "Episode"])]
    got = {r.item_id: r.outcome for r in history.sessions_agg(
        make_events(spark, events), make_library(spark, [("9", "Movie", 1)])
    ).collect()}
    assert got == {"1": "sampled", "2": "unknown", "3": "partial"}


def test_golden_stats_row(spark):
    """A published example: 7458 s watched once of a 7762 s item."""
    library = make_library(spark, [("536641", "Movie", 7762)])
    sessions = history.sessions_agg(make_events(spark, [("u", "536641", "Movie", 0, 7458)]), library)
    row = history.user_item_stats(sessions, library).first()
    assert row.total_minutes_watched == pytest.approx(124.3)
    assert row.best_completion_ratio == pytest.approx(0.9608348363823757)
    assert row.average_completion_ratio == pytest.approx(0.9608348363823757)
    assert row.adherence_score == pytest.approx(0.772584385467663)
    assert (row.rewatch_count, row.days_between_first_last, row.completed_sessions) == (0, 0.0, 1)
    assert (row.partial_sessions, row.abandoned_sessions, row.sampled_sessions) == (0, 0, 0)


def test_stats_by_library_type(spark):
    events = make_events(
        spark, [("u", item, "Movie", at, 1800) for item in ("known", "ep", "mv", "tr", "orphan") for at in (0, 90000)]
    )
    library = make_library(
        spark, [("known", "Movie", 3600), ("ep", "Episode", None), ("mv", "Movie", 0), ("tr", "Trailer", None)]
    )
    stats = history.user_item_stats(history.sessions_agg(events, library), library)
    got = {r.item_id: r for r in stats.collect()}
    assert got["known"].best_completion_ratio == pytest.approx(0.5)
    assert got["known"].adherence_score == pytest.approx(0.6 * 0.5 + 0.3 * 2 / 3 + 0.1)
    assert got["ep"].average_completion_ratio == 1.0
    assert got["ep"].adherence_score == pytest.approx(0.6 + 0.3 * 2 / 3 + 0.1)
    assert got["mv"].average_completion_ratio == pytest.approx(0.25)
    assert got["mv"].adherence_score == pytest.approx(0.7 * 0.25 + 0.2 + 0.1 * 0.5)
    for name in ("tr", "orphan"):
        assert (got[name].best_completion_ratio, got[name].average_completion_ratio, got[name].adherence_score) == (0, 0, 0)
    assert got["ep"].rewatch_count == 1
    assert got["ep"].days_between_first_last == pytest.approx(90000 / 86400)


def test_totals_are_kept(spark):
    rng = random.Random(1)
    events = [(f"u{rng.randrange(5)}", str(rng.randrange(4)), "Movie", rng.randrange(10**6), rng.randrange(500)) for _ in range(500)]
    library = make_library(spark, [("1", "Movie", 400)])
    sessions = history.sessions_agg(make_events(spark, events), library)
    stats = history.user_item_stats(sessions, library)
    assert sessions.agg(F.sum("session_count")).first()[0] == len(events)
    assert stats.agg(F.sum("total_seconds_watched")).first()[0] == sum(e[4] for e in events)
    assert sessions.where("completion_ratio < 0 OR completion_ratio > 1").count() == 0
    assert sessions.select("session_id").distinct().count() == sessions.count()


def test_update_ratios_is_idempotent_and_keeps_the_rest(spark):
    events = make_events(spark, [("u", "1", "Movie", 0, 720), ("u", "2", "Movie", 0, 720), ("u", "3", "X", 0, 5)])
    blind = make_library(spark, [("9", "Movie", 1)])
    late = make_library(spark, [("1", "Movie", 1440), ("2", "Movie", 0)])
    sessions = history.sessions_agg(events, blind)
    once = history.update_completion_ratios(sessions, late)
    got = {r.item_id: (r.completion_ratio, r.outcome) for r in once.collect()}
    assert got == {"1": (0.5, "sampled"), "2": (0.1, "sampled"), "3": (None, "unknown")}
    assert rows(history.update_completion_ratios(once, late)) == rows(once)


def test_clock_shift(spark):
    data = [("2025-08-15", "11:09:59"), ("2025-08-15", "11:10:00"), ("2025-12-31", "23:00:00"), ("2025-04-06", "01:30:00")]
    events = spark.createDataFrame(
        [(d, t, "u", "n", "1", "Movie", "12", None, "U") for d, t in data],
        "date string, time string, user_id string, item_name string, item_id string, item_type string, "
        "duration string, remote_address string, user_name string",
    )
    got = history.normalize_tz(history.project_raw_event(events))
    assert sorted((r.date, r.time) for r in got.collect()) == [
        ("2025-04-06", "18:30:00"),
        ("2025-08-15", "11:10:00"),
        ("2025-08-16", "04:09:59"),
        ("2025-12-31", "23:00:00"),
    ]
    assert {(r.duration, r.remote_address) for r in got.collect()} == {(12, "")}


@pytest.mark.parametrize("field,value", [("duration", "1x"), ("date", "2025-13-01")])
def test_malformed_event_fails(spark, field, value):
    event = dict(
        date="2025-08-20", time="04:17:06", user_id="u", item_name="n", item_id="1", item_type="Movie",
        duration="1", remote_address="", user_name="U",
    )
    event[field] = value
    with pytest.raises(Exception):
        history.project_raw_event(spark.createDataFrame([event])).collect()


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_lookup_join_equals_broadcast(spark, how):
    facts = spark.range(2000).select(
        "id",
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.lit(None)).otherwise(
            (F.col("id") % 50).cast("string")
        ).alias("k"),
    )
    lookup = spark.createDataFrame([("hot", 1), ("2", 2), ("5", 3)], "k string, v int")
    assert rows(joins.lookup_join(facts, lookup, "k", how)) == rows(facts.join(F.broadcast(lookup), "k", how))


def test_lookup_of_deceptive_size_is_not_broadcast(spark, tmp_path):
    """Files that compress well and rows that multiply look small to an estimate, not to a measured shuffle."""
    spark.range(300_000).select("id", F.lit("x" * 40).alias("v")).write.option("compression", "zstd").parquet(str(tmp_path / "v"))
    compressible = spark.read.parquet(str(tmp_path / "v"))
    exploded = spark.range(300).select(F.explode(F.sequence(F.col("id") * 1000, F.col("id") * 1000 + 999)).alias("id"), F.lit("x" * 40).alias("v"))
    facts = spark.range(400_000)
    for lookup in (compressible, exploded):
        matched = joins.lookup_join(facts, lookup, "id").agg(F.count("v").alias("n"))
        assert matched.collect()[0].n == 300_000
        plan = matched._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_events_without_a_time(spark):
    rows_ = [(0, "u", "1", None), (1, "u", "1", START), (2, "u", "1", None), (3, None, "1", START), (4, "u", "1", START)]
    events = spark.createDataFrame(rows_, "row_id long, user_id string, item_id string, event_ts timestamp")
    got = {r.row_id: (r.is_new_session, r.session_group_id) for r in history.mark_sessions(events, 5).collect()}
    assert got == {0: (1, 1), 2: (0, 1), 1: (1, 2), 4: (0, 2), 3: (1, 1)}


def test_whole_job_with_shuffled_lookups(spark):
    events = make_events(spark, [(f"u{i % 7}", "1" if i % 3 else str(i % 5), "Movie", i * 700, 60) for i in range(300)])
    library = make_library(spark, [(str(i), "Movie", 100 * i) for i in range(4)])

    def job():
        sessions = history.sessions_agg(events, library)
        return rows(sessions), rows(history.user_item_stats(sessions, library))

    small = job()
    limit = "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        assert job() == small
    finally:
        spark.conf.set(limit, before)


def test_repeat_rows(spark):
    got = joins.repeat_rows(spark.createDataFrame([("a", 3), ("b", 0), ("c", 25)], "k string, n long"), "n", chunk=10)
    assert {r.k: r["count"] for r in got.groupBy("k").count().collect()} == {"a": 3, "c": 25}
