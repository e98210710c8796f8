from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows
from reelmark.functions import blocks
from reelmark.operators import similar, titles

ROWS = [
    ("a", "A", "Drama"), ("a", "A", "Drama"), ("a", "A", "Crime"), ("b", "B", "Comedy"), ("b", "B", None),
    ("c", "C", None), ("d", None, "Drama"),
]


@pytest.fixture
def tagged(spark):
    return spark.createDataFrame(ROWS, "t_const string, primary_name string, genre string")


def test_onehot_equals_dummies(spark, tagged):
    frame = pd.DataFrame(ROWS, columns=["t_const", "primary_name", "genre"])
    dummies = pd.get_dummies(frame["genre"], prefix="genre", dtype="int")
    want = pd.concat([frame.drop(columns="genre"), dummies], axis=1).groupby(["t_const", "primary_name"], as_index=False).sum()
    got = titles.onehot_genres(titles.genre_counts(tagged))
    assert got.columns == list(want.columns)
    assert rows(got) == sorted((tuple(r) for r in want.itertuples(index=False)), key=repr)


def test_counts_from_tables(spark, tagged):
    names = tagged.select("t_const", "primary_name").distinct()
    from_tables = titles.title_genre_counts(names, tagged.select("t_const", "genre"))
    assert rows(from_tables) == rows(titles.genre_counts(tagged))
    joined = titles.titles_genres_join(names, tagged.select("t_const", "genre"))
    assert rows(joined) == rows(tagged)


def test_every_genre_is_a_column(spark):
    tagged = spark.range(12_000).select(F.format_string("g%05d", "id").alias("genre"))
    assert titles.genre_values(tagged) == [f"g{i:05d}" for i in range(12_000)]


def test_vectors_from_both_forms(spark, tagged):
    counts = titles.genre_counts(tagged)
    direct = titles.genre_vectors(counts)
    assert rows(titles.encoded_to_vectors(titles.onehot_genres(counts))) == rows(direct)
    assert {r.t_const: [tuple(e) for e in r.vector] for r in direct.collect()} == {
        "a": [("Crime", 1.0), ("Drama", 2.0)], "b": [("Comedy", 1.0)], "c": [],
    }


def random_vectors(spark, count, vocabulary, seed):
    rng = np.random.default_rng(seed)
    matrix = (rng.random((count, vocabulary)) < 0.25) * rng.integers(1, 4, (count, vocabulary))
    matrix[0] = 0
    matrix[5] = matrix[6] = matrix[7] = matrix[8] = matrix[4]
    data = [
        (f"t{i:03d}", [(f"g{j}", float(w)) for j, w in enumerate(row) if w]) for i, row in enumerate(matrix)
    ]
    frame = spark.createDataFrame(data, "t_const string, vector array<struct<genre:string,weight:double>>")
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    unit = np.divide(matrix, norms, out=np.zeros(matrix.shape), where=norms > 0)
    return frame, unit


@pytest.mark.parametrize("query_block,candidate_block", [(4096, 20000), (7, 9)])
def test_neighbours_equal_brute_force(spark, monkeypatch, query_block, candidate_block):
    monkeypatch.setattr(similar, "QUERY_BLOCK", query_block)
    monkeypatch.setattr(similar, "CANDIDATE_BLOCK", candidate_block)
    frame, unit = random_vectors(spark, 60, 8, seed=3)
    scores = (unit @ unit.T).round(9)
    got: dict[str, list] = {}
    for r in similar.knn_similar_titles(similar.title_profiles(frame), k=5).orderBy("title", "rank").collect():
        got.setdefault(r.title, []).append((r.neighbour, r.distance))
    for i in range(60):
        order = sorted((j for j in range(60) if j != i), key=lambda j: (-scores[i, j], j))[:5]
        assert got[f"t{i:03d}"] == [(f"t{j:03d}", pytest.approx(1 - scores[i, j])) for j in order]


def test_block_scores_in_small_steps(monkeypatch):
    monkeypatch.setattr(blocks, "CELLS", 10)
    monkeypatch.setattr(blocks, "STRIP", 2)
    rng = np.random.default_rng(0)
    left, right = rng.random((9, 7)), rng.random((6, 7))
    names = np.array([f"g{i}" for i in range(7)], dtype=object)
    queries = pd.DataFrame({"query_id": range(9), "genres": [names] * 9, "weights": list(left)})
    candidates = pd.DataFrame({"members": [np.array([10 * i, 10 * i + 5]) for i in range(6)], "genres": [names] * 6, "weights": list(right)})
    out = blocks.nearest_in_block(3)(None, queries, candidates)
    scores = (left @ right.T).round(9)
    for q in range(9):
        flat = sorted((-scores[q, c], t) for c in range(6) for t in (10 * c, 10 * c + 5))[:3]
        mine = out[out["query_id"] == q]
        assert list(zip(-mine["similarity"], mine["title"])) == flat


def test_neighbours_of_chosen_titles(spark):
    frame, _ = random_vectors(spark, 30, 5, seed=11)
    profiles = similar.title_profiles(frame)
    chosen = spark.createDataFrame([("t003",), ("t006",), ("gone",)], "title string")
    every = similar.knn_similar_titles(profiles).where("title in ('t003', 't006')")
    assert rows(similar.knn_similar_titles(profiles, of=chosen)) == rows(every)


def test_fewer_titles_than_neighbours(spark):
    frame, _ = random_vectors(spark, 9, 3, seed=1)
    few = frame.where("t_const in ('t001', 't002', 't003')")
    assert similar.knn_similar_titles(similar.title_profiles(few), k=5).groupBy("title").count().toDF("t", "n").select("n").distinct().first().n == 2


def test_dense_normalize(spark):
    frame = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "id int, embedding array<float>")
    got = {r.id: r.embedding for r in similar.l2_normalize(frame).collect()}
    assert got == {1: [0.6, 0.8], 2: [0.0, 0.0]}


def test_taste_and_user_neighbours(spark):
    frame, unit = random_vectors(spark, 40, 6, seed=9)
    profiles = similar.title_profiles(frame)
    other = next(i for i in range(10, 40) if unit[i].any())
    watched = [("u", "t001", 0.5), ("u", "t001", 0.25), ("u", "t002", 1.0), ("u", "t003", None), ("u", "gone", 1.0),
               ("zero", "t004", 0.0), ("v", f"t{other:03d}", 2.0)]
    taste = similar.user_taste_vector(spark.createDataFrame(watched, "user_id string, title string, weight double"), profiles)
    mean = np.average(unit[[1, 1, 2]], axis=0, weights=[0.5, 0.25, 1.0])
    want = mean / np.linalg.norm(mean)
    got = {(r.user_id, r.genre): r.weight for r in taste.collect()}
    assert {g: w for (u, g), w in got.items() if u == "u"} == pytest.approx({f"g{i}": w for i, w in enumerate(want) if w})
    assert {u for u, _ in got} == {"u", "v"}
    near = similar.knn_for_user(taste, profiles, k=20).where("user_id = 'u'").orderBy("rank").collect()
    scores = (unit @ want).round(9)
    order = sorted(range(40), key=lambda j: (-scores[j], j))[:20]
    assert [r.title for r in near] == [f"t{j:03d}" for j in order]
    assert [r.distance for r in near] == pytest.approx([1 - scores[j] for j in order])
