"""Plans under skew, with thresholds lowered so that small data shows them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from reelmark.operators import history, similar
from reelmark.plans import joins


def test_spark_splits_what_salting_leaves(spark, tmp_path):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        facts = spark.range(200_000, numPartitions=16).select(
            "id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.md5(F.col("id").cast("string"))).alias("k")
        )
        lookup = spark.range(1000).select(F.md5(F.col("id").cast("string")).alias("k"), F.col("id").alias("v"))
        hot = spark.createDataFrame([("hot", -1)], "k string, v long")
        joined = joins.lookup_join(facts, lookup.unionByName(hot), "k", "left", salt_on=["id"])
        out = str(tmp_path / "joined")
        joined.write.parquet(out)
        assert spark.read.parquet(out).count() == 200_000
        assert spark.read.parquet(out).where("v = -1").count() == 66_667
        joined.count()
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_hot_pair_reaches_the_window_as_slots(spark, tmp_path):
    """Half a million events of one pair shuffle as slots, one row per quarter hour and map task at most."""
    events = spark.range(500_000, numPartitions=8).select(
        F.col("id").alias("row_id"),
        F.lit("hot").alias("user_id"),
        F.lit("1").alias("item_id"),
        F.lit("Movie").alias("item_type"),
        F.timestamp_seconds(F.lit(1_750_000_000) + F.col("id") % 86_400).alias("event_ts"),
        F.lit(1).cast("long").alias("duration"),
    )
    sessions = history.gap_sessions(events, 15)
    row = sessions.collect()[0]
    assert (row.session_count, row.total_seconds_watched) == (500_000, 500_000)

    def shuffled(plan):
        found = [int(plan.metrics().apply("shuffleRecordsWritten").value())] if plan.nodeName() == "Exchange" else []
        children = plan.children()
        inner = plan.finalPhysicalPlan() if plan.nodeName().startswith("AdaptiveSparkPlan") else None
        if inner is not None:
            return shuffled(inner)
        if plan.nodeName() in ("ShuffleQueryStage",):
            return shuffled(plan.plan())
        for i in range(children.size()):
            found += shuffled(children.apply(i))
        return found

    written = shuffled(sessions._jdf.queryExecution().executedPlan())
    assert written and max(written) <= 8 * (86_400 // 901 + 2)


def test_profile_held_by_most_titles(spark):
    """Most titles share one vector; their neighbours come from a list of k + 1, joined by title."""
    titles = spark.range(3000).selectExpr(
        "lpad(cast(id as string), 5, '0') AS t_const",
        """if(id < 2900, array(named_struct('genre', 'Drama', 'weight', 1d)),
              array(named_struct('genre', 'Drama', 'weight', 1d),
                    named_struct('genre', concat('g', id % 7), 'weight', 1d))) AS vector""",
    )
    near = similar.knn_similar_titles(similar.title_profiles(titles), k=3)
    got = {}
    for r in near.orderBy("title", "rank").collect():
        got.setdefault(r.title, []).append((r.neighbour, r.distance))
    assert len(got) == 3000
    assert got["02000"] == [("00000", 0.0), ("00001", 0.0), ("00002", 0.0)]
    assert got["00001"] == [("00000", 0.0), ("00002", 0.0), ("00003", 0.0)]
    assert got["02905"] == [("02912", 0.0), ("02919", 0.0), ("02926", 0.0)]


def test_hot_item_in_every_lookup(spark):
    """An item with most of the sessions gives the same statistics through the joins."""
    events = spark.range(6000).select(
        F.col("id").alias("row_id"),
        F.concat(F.lit("u"), (F.col("id") % 500).cast("string")).alias("user_id"),
        F.when(F.col("id") % 10 != 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("item_id"),
        F.lit("Movie").alias("item_type"),
        F.timestamp_seconds(F.lit(1_750_000_000) + F.col("id") * 1000).alias("event_ts"),
        F.lit(100).cast("long").alias("duration"),
    )
    library = spark.createDataFrame([("hot", "Movie", 200), ("3", "Movie", 400)], "item_id string, item_type string, runtime_seconds long")
    sessions = history.sessions_agg(events, library)
    assert sessions.count() == 6000
    by_item = {r.item_id: r for r in sessions.groupBy("item_id").agg(F.max("completion_ratio").alias("r"), F.count("*").alias("n")).collect()}
    assert (by_item["hot"].n, by_item["hot"].r) == (5400, 0.5)
    assert by_item["3"].r == 0.25
    stats = history.user_item_stats(sessions, library)
    assert stats.agg(F.sum("total_sessions")).first()[0] == 6000


@pytest.mark.parametrize("limit, moved", [(16 << 20, False), (10, True)])
def test_facts_move_only_for_a_lookup_that_measures_large(spark, limit, moved):
    facts = spark.range(1000).selectExpr("id", "concat('g', id % 7) AS name")
    lookup = spark.range(5).selectExpr("concat('g', id) AS name", "id * 10 AS number")
    kept, size = joins.measured(lookup)
    assert kept.count() == 5 and 5 * 64 < size < 5 * 400
    joined = joins.measured_join(facts, lookup, "name", limit=limit)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert ("Exchange hashpartitioning(name" in plan) == moved and ("BroadcastHashJoin" in plan) != moved
    want = {(i, f"g{i % 7}", i % 7 * 10 if i % 7 < 5 else None) for i in range(1000)}
    assert {(r["id"], r["name"], r["number"]) for r in joined.collect()} == want
