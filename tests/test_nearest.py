"""The bounded search against all scores, and how much it leaves out."""

import numpy as np
import pytest

from reelmark.functions import bounds
from reelmark.operators import nearest, similar
from tests.conftest import rows

VECTOR = "array<struct<genre:string,weight:double>>"


def made(spark, weights, id_type="string", prefix="t"):
    """Titles with the given weights (rows) and their unit vectors."""
    def name(i):
        return f"{prefix}{i:04d}" if id_type == "string" else i

    data = [(name(i), [(f"g{j:03d}", float(w)) for j, w in enumerate(row) if w]) for i, row in enumerate(weights)]
    norms = np.linalg.norm(weights, axis=1, keepdims=True)
    unit = np.divide(weights, norms, out=np.zeros(weights.shape), where=norms > 0)
    return spark.createDataFrame(data, f"t_const {id_type}, vector {VECTOR}"), unit, name


def expected(unit, queries, k):
    scores = (queries @ unit.T).round(9)
    return [sorted(range(len(unit)), key=lambda j: (-s[j], j))[:k] for s in scores], scores


def tagged(rng, count, genres, tags=3):
    """Rows of three tags each, one common, one rarer, one rare, as catalogues have them."""
    out = np.zeros((count, sum(genres)))
    for i in range(count):
        for at, size in enumerate(genres[:tags]):
            out[i, sum(genres[:at]) + rng.integers(size)] += 1
    return out


@pytest.mark.parametrize("page, block, id_type", [(1024, 32, "string"), (7, 2, "long"), (16, 16, "string"), (1, 1, "long")])
def test_equals_all_scores(spark, page, block, id_type):
    rng = np.random.default_rng(page)
    weights = tagged(rng, 90, (3, 6, 20))
    weights[5] = 0  # no genres
    weights[10:14] = weights[20]  # equal vectors
    weights[30:33] *= 2
    frame, unit, name = made(spark, weights, id_type)
    profiles = similar._first_members(similar.title_profiles(frame), 6)
    asked = spark.createDataFrame([(i, [(f"g{j:03d}", float(w)) for j, w in enumerate(unit[i]) if w]) for i in range(0, 90, 3)], f"query_id long, vector {VECTOR}")
    got = {}
    for r in nearest.search(asked, profiles, 6, page=page, block=block).found.collect():
        got.setdefault(r["query_id"], {})[r["position"]] = (r["title"], r["similarity"])
    order, scores = expected(unit, unit[::3], 6)
    for at, i in enumerate(range(0, 90, 3)):
        assert [got[i][p + 1] for p in range(6)] == [(name(j), pytest.approx(scores[at, j], abs=1e-9)) for j in order[at]]


def test_signed_weights(spark):
    rng = np.random.default_rng(2)
    weights = rng.normal(size=(40, 5)) * (rng.random((40, 5)) < 0.5)
    frame, unit, name = made(spark, weights)
    profiles = similar._first_members(similar.title_profiles(frame), 4)
    asked = profiles.selectExpr("members[0] AS query_id", "vector")
    found = nearest.search(asked, profiles, 4, signed=True, page=6, block=2).found.collect()
    order, _ = expected(unit, unit, 4)
    got = {}
    for r in found:
        got.setdefault(r["query_id"], {})[r["position"]] = r["title"]
    assert all([got[q][p] for p in range(1, 5)] == [name(j) for j in order[int(q[1:])]] for q in got)
    with pytest.raises(Exception, match="signed"):
        nearest.search(asked, profiles, 4, page=6).found.collect()


def test_most_blocks_are_never_multiplied(spark):
    weights = tagged(np.random.default_rng(3), 6000, (12, 40, 60))
    frame, _, _ = made(spark, weights)
    _, found = similar.similar_search(similar.title_profiles(frame), 5)
    counts = found.counts.first()
    assert counts["pages"] >= 6 and counts["met"] <= counts["query_pages"] * counts["pages"]
    assert counts["multiplied"] < 0.2 * counts["blocks"]


def test_pages_out_of_reach_are_not_met(spark):
    """Families of titles that share nothing: a page of queries meets its own pages only."""
    weights = np.zeros((2000, 100))
    for i in range(2000):
        weights[i, i % 20 * 5 : i % 20 * 5 + 5] = np.random.default_rng(i).random(5)
    frame, _, _ = made(spark, weights)
    profiles = similar._first_members(similar.title_profiles(frame), 3)
    asked = profiles.selectExpr("members[0] AS query_id", "vector")
    counts = nearest.search(asked, profiles, 3, page=25).counts.first()
    assert counts["met"] < 0.5 * counts["query_pages"] * counts["pages"]


def test_bounds_hold_and_are_tight():
    rng = np.random.default_rng(4)
    queries, candidates = rng.normal(size=(20, 12)), rng.normal(size=(30, 12)) * (rng.random((30, 12)) < 0.3)
    starts = np.arange(0, 30, 4)
    most = int((candidates != 0).sum(axis=1).max())
    got = bounds.bounds(queries, candidates, starts, most)
    scores = queries @ candidates.T
    for b, start in enumerate(starts):
        assert (got[:, b] >= scores[:, start : start + 4].max(axis=1) - 1e-12).all()
    single = bounds.bounds(np.abs(queries), np.abs(candidates), np.arange(30), 12)
    assert np.allclose(single, np.abs(queries) @ np.abs(candidates).T)


def test_more_asked_than_there_are(spark):
    frame, _, _ = made(spark, np.eye(3))
    profiles = similar._first_members(similar.title_profiles(frame), 9)
    found = nearest.search(profiles.selectExpr("members[0] AS query_id", "vector"), profiles, 9).found
    assert rows(found.where("query_id = 't0001'"), "title", "position", "similarity") == [("t0000", 2, 0.0), ("t0001", 1, 1.0), ("t0002", 3, 0.0)]
    nobody = profiles.limit(0)
    assert nearest.search(profiles.selectExpr("members[0] AS query_id", "vector"), nobody, 3).found.count() == 0
    assert nearest.search(nobody.selectExpr("members[0] AS query_id", "vector"), profiles, 3).found.count() == 0


def test_pages_travel_by_cell_and_only_the_best_come_back(spark, monkeypatch):
    frame, _, _ = made(spark, tagged(np.random.default_rng(5), 200, (3, 6, 20)))
    profiles = similar._first_members(similar.title_profiles(frame), 4)
    asked = profiles.selectExpr("members[0] AS query_id", "vector")
    steps, write = [], nearest.cut_lineage
    monkeypatch.setattr(nearest, "cut_lineage", lambda df: steps.append(write(df)) or steps[-1])
    counts = nearest.search(asked, profiles, 4, page=8).counts.first()
    opening, later = [s for s in steps if "found" in s.columns]
    assert later.count() < counts["met"] / 2
    most = opening.unionByName(later).selectExpr("q_page", "explode(found) AS f").groupBy("q_page", "f.at").count().agg({"count": "max"}).first()[0]
    assert most <= 4 * (later.groupBy("q_page").count().agg({"count": "max"}).first()[0] + 2)
