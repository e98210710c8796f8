from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from conftest import rows
from reelmark.operators import quality, reports
from reelmark.plans import quantiles
from reelmark.schemas import TABLES


@pytest.mark.parametrize("splits", [2, 256])
def test_quantiles_are_exact(spark, monkeypatch, splits):
    monkeypatch.setattr(quantiles, "SPLITS", splits)
    rng = np.random.default_rng(2)
    columns = {
        "skewed": np.r_[np.zeros(700), rng.exponential(50, 300)],
        "few": np.r_[1.0, 2.0],
        "one": np.r_[4.0],
        "ints": rng.integers(0, 20, 1000).astype(float),
    }
    data = [(name, float(v), int(n)) for name, values in columns.items() for v, n in zip(*np.unique(values, return_counts=True))]
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = quantiles.exact_quantiles(spark.createDataFrame(data, "metric string, value double, n long"), probabilities)
    found = {(r.metric, r.probability): r.quantile for r in got.collect()}
    for name, values in columns.items():
        for p in probabilities:
            assert found[name, p] == pytest.approx(np.quantile(values, p)), (name, p)


def test_describe_equals_pandas(spark):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame({"a": rng.integers(0, 9, 101), "b": rng.random(101), "who": rng.choice(["x", "y", "z"], 101, p=[0.2, 0.5, 0.3])})
    frame.loc[3, "b"] = np.nan
    data = [(int(a), None if np.isnan(b) else float(b), w) for a, b, w in frame.itertuples(index=False)]
    got = reports.describe_sessions(spark.createDataFrame(data, "a long, b double, who string"), ("a", "b"), ("who",))
    want = frame.describe(include="all").round(2)
    for r in got.collect():
        mine = r.asDict()
        for ours, theirs in {"count": "count", "unique": "unique", "top": "top", "freq": "freq", "mean": "mean", "std": "std",
                             "min": "min", "p25": "25%", "p50": "50%", "p75": "75%", "max": "max"}.items():
            expected = want.loc[theirs, r.column_name]
            assert (mine[ours] is None) if pd.isna(expected) else mine[ours] == pytest.approx(expected, abs=0.0051)


def test_histograms_equal_numpy(spark):
    rng = np.random.default_rng(6)
    values, zeros = rng.integers(0, 777, 300), [0] * 300
    frame = spark.createDataFrame([(int(v), z) for v, z in zip(values, zeros)], "v long, z long")
    got = reports.session_histograms(frame, ("v", "z")).orderBy("column_name", "bin").collect()
    assert [r.sessions for r in got if r.column_name == "v"] == np.histogram(values, 50, (0, values.max()))[0].tolist()
    assert [r.sessions for r in got if r.column_name == "z"] == np.histogram(zeros, 50)[0].tolist()


def test_session_genre_rows_multiply(spark):
    sessions = spark.createDataFrame([("u", "1", 1), ("u", "1", 2), ("v", "2", 1), ("v", "3", 1)], "user_id string, item_id string, session_start_timestamp long")
    library = spark.createDataFrame([("1", "One"), ("2", "Two")], "item_id string, item_name string")
    genres = spark.createDataFrame([("1", "A"), ("1", "A"), ("1", None), ("3", "B")], "item_id string, genre_name string")
    got = rows(reports.sessions_items_genres(sessions, library, genres))
    assert got == sorted([("u", "1", "One", "A")] * 4 + [("u", "1", "One", None)] * 2, key=repr)


def test_outcomes_in_order(spark):
    sessions = spark.createDataFrame([(o,) for o in "aabbbcc"], "outcome string")
    assert [tuple(r) for r in reports.outcome_distribution(sessions).collect()] == [("b", 3), ("a", 2), ("c", 2)]


def test_constraint_reports(spark):
    frame = spark.createDataFrame([("1", "ab"), ("1", "abc"), (None, "x"), (None, None)], "k string, v string")
    assert rows(quality.dq_unique(frame, ["k"])) == [("1", 2)]
    assert rows(quality.dq_not_null(frame, ["k", "v"])) == [("k", 2), ("v", 1)]
    assert rows(quality.dq_max_length(frame, {"v": 2})) == [("v", 2, 1, 3)]
    parent = spark.createDataFrame([("2",)], "id string")
    assert rows(quality.dq_foreign_key(frame, "k", parent, "id")) == [("1", 2)]
    assert quality.dq_not_null(frame.limit(0), ["k"]).first().null_count == 0


def test_require_valid(spark):
    ratings = "t_const string, avg_rating double, num_votes int"
    quality.require_valid(spark.createDataFrame([("a", 1.0, 1)], ratings), TABLES["ratings"], "ratings")
    for bad in ([("a", 1.0, 1), ("a", 2.0, 1)], [(None, 1.0, 1)]):
        with pytest.raises(ValueError):
            quality.require_valid(spark.createDataFrame(bad, ratings), TABLES["ratings"], "ratings")
