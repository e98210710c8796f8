"""Near vectors: families that touch, and the audit."""

import numpy as np
import pytest

from reelmark.llm import op6_neardup, vectors

VECS = "vec_id long, embedding array<double>"
FOUND = "row long, n_links long"


def family(draw, centre, size, inside):
    other = draw.standard_normal((size, len(centre)))
    other = vectors.unit(other - np.outer(other @ centre, centre))
    return np.sqrt(inside) * centre + np.sqrt(1 - inside) * other


def touching():
    """Three families, 0.999 inside; the first two, and the last two, at 0.969 across."""
    draw = np.random.default_rng(12)
    a, side, turn = np.linalg.qr(draw.standard_normal((64, 3)))[0].T
    b = 0.97 * a + np.sqrt(1 - 0.97**2) * side
    c = 0.97 * b + np.sqrt(1 - 0.97**2) * turn
    alone = draw.standard_normal((60, 64))
    return vectors.unit(np.concatenate([*(family(draw, x, 40, 0.999) for x in (a, b, c)), alone]))


def test_families_that_touch_are_one_component(spark):
    x = touching()
    hit = x @ x.T >= 0.95
    np.fill_diagonal(hit, False)
    assert hit[:40, 40:80].all() and hit[40:80, 80:120].all() and not hit[:40, 80:120].any()
    got = op6_neardup.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VECS)).collect()
    want = [(i, int(hit[i].sum()), 0 if i < 120 else i, i == 0 or i >= 120) for i in range(len(x))]
    assert sorted(map(tuple, got)) == want


def test_every_vector_counts_the_same_in_the_audit(spark):
    true = spark.createDataFrame([(0, 1, 5000), (1, 1, 1), (2, 1, 1), (3, 2, 1)], "row long, copies long, actual long")
    links = spark.createDataFrame([(0, 5000), (3, 2)], FOUND)
    assert op6_neardup.audit(true, links) == 0.5


def test_rare_links_are_audited(spark):
    draw = np.random.default_rng(3)
    x = draw.standard_normal((3000, 32))
    x[2990:] = x[:10] + 0.02 * draw.standard_normal((10, 32))
    rows = [(i, v.tolist(), 32, 1) for i, v in enumerate(x)]
    valid = spark.createDataFrame(rows, "row long, x array<double>, dim int, copies long")
    true = op6_neardup.linked(valid, 3000, 0.95, 41)
    assert sorted(r["row"] for r in true.collect()) == [*range(10), *range(2990, 3000)]
    assert op6_neardup.audit(true, spark.createDataFrame([], FOUND)) == 0


def test_lost_links_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(op6_neardup, "start", lambda placed, *_: spark.createDataFrame([], "u long, v long, cos double, away boolean"))
    monkeypatch.setattr(op6_neardup, "ATTEMPTS", 2)
    rows = [(i, v.tolist()) for i, v in enumerate(touching())]
    with pytest.raises(RuntimeError, match="recall"):
        op6_neardup.near_duplicates(spark.createDataFrame(rows, VECS))


def test_tables_grow_with_the_signature():
    for count in (10_000, 10_000_000, 1_000_000_000):
        bits, tables = op6_neardup.table_count(count, 0.95)
        assert (1 - (1 - np.arccos(0.95) / np.pi) ** bits) ** tables <= 0.0101
