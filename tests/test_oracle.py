"""Every registered query against its SQL, and its plan against what a cluster could not bear."""

from __future__ import annotations

import pytest

import check
from __spark_entry__ import entry, oracle_sql, queries
from reelmark import oracles, queries as registry
from reelmark.operators import similar

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return check.duck(SF)


def test_every_query_has_sql():
    """All of the library's own; training-data queries have SQL where it can express them."""
    assert set(oracles.ORACLES) == set(registry.QUERIES)
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, duck, name):
    assert check.compare(spark, duck, SF, name) is None


@pytest.mark.parametrize(
    "name", ["sessions_agg", "user_item_stats", "win_session_group", "item_genres", "upsert_library_items", "genre_vectors", "user_taste_vector"]
)
def test_plan_stays_in_the_jvm_without_cross_joins(spark, name):
    plan = queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert operator not in plan


def test_session_plan(spark):
    """One exchange for the pre-aggregate, one for both windows and the final grouping; hash aggregates only.

    The look-up of runtimes adds one for each side, by whose measured size it becomes a broadcast.
    """
    sessions = queries()["sessions_agg"](spark, SF)
    plan = sessions._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 4
    assert plan.count("Window [") == 2
    assert "SortAggregate" not in plan
    assert "event_type" not in plan.split("ReadSchema")[1].split("\n")[0]
    sessions.collect()
    assert "BroadcastHashJoin" in sessions._jdf.queryExecution().executedPlan().toString()


def test_member_lists_are_cut_before_the_shuffle(spark):
    titles = spark.read.parquet(f"{SF}/part.parquet").selectExpr(
        "p_type AS profile", "array(named_struct('genre', p_type, 'weight', 1d)) AS vector", "p_partkey AS title"
    )
    plan = similar._first_members(titles, 3)._jdf.queryExecution().executedPlan().toString()
    # read bottom up: a partial limit per vector, the exchange, the final limit
    final, exchange = plan.index("WindowGroupLimit"), plan.index("Exchange")
    assert final < exchange < plan.index("WindowGroupLimit", exchange)
    assert plan.count("Exchange") == 1
