"""Mixing and sharding."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from reelmark.llm import contingency, op1_mix, op5_shard

SCHEMA = "doc_id long, text string, source string, size long, shard int, doc string"


def documents():
    rows = [(i, "w " * (1 + i * 7 % 90), f"s{i % 5}" if i % 3 else "s0", 0, 0, "x") for i in range(400)]
    return rows + [(900, None, "s1", 1, 1, None), (901, "", None, 1, 1, None), (902, "a b", None, 1, 1, None), (3, rows[3][1], "s0", 0, 0, "x"), (None, "c d", "s2", 0, 0, "x"), (903, "long " * 20000, "s3", 0, 0, "x")]


def water(sizes, weights, most=3):
    """Targets by sharing what full sources can't take, again and again."""
    total, target, full = sum(sizes), [0.0] * len(sizes), set()
    while True:
        rest = total - sum(most * sizes[i] for i in full)
        open_ = [i for i in range(len(sizes)) if i not in full]
        for i in open_:
            target[i] = rest * weights[i] / sum(weights[k] for k in open_)
        over = {i for i in open_ if target[i] > most * sizes[i]}
        if not over:
            return target
        for i in over:
            target[i] = most * sizes[i]
        full |= over


def test_mix(spark):
    df = spark.createDataFrame(documents(), SCHEMA)
    run = lambda: op1_mix.mix(df, op1_mix.words(F.col("text")), block_words=256, shards=7)
    rows = [(r["doc"]["doc_id"], r["doc"]["source"], r["size"], r["source_size"], r["target"], r["taken"], r["draws"]) for r in run().collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, ((r["doc"]["doc_id"], r["doc"]["source"], r["size"], r["source_size"], r["target"], r["taken"], r["draws"]) for r in run().collect())))
    assert len(rows) == len(documents())
    sizes = Counter()
    for d in documents():
        sizes[d[2]] += len((d[1] or "").split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, water([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])))
    taken, largest = Counter(), Counter()
    for _, source, size, source_size, target, took, draws in rows:
        assert source_size == sizes[source] and target == pytest.approx(want[source]) and took == size * len(draws) <= 3 * size
        taken[source] += took
        largest[source] = max(largest[source], size)
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in names)


def test_mix_of_nothing(spark):
    assert op1_mix.mix(spark.createDataFrame([], SCHEMA), op1_mix.words(F.col("text"))).count() == 0
    only_empty = spark.createDataFrame([(1, "", "a", 0, 0, ""), (2, None, None, 0, 0, "")], SCHEMA)
    assert [r["taken"] for r in op1_mix.mix(only_empty, op1_mix.words(F.col("text"))).collect()] == [0, 0]


def test_shuffle(spark):
    df = spark.createDataFrame(documents(), SCHEMA).repartition(6)
    rows = op5_shard.shuffle(df, 9).collect()
    assert Counter(repr(r["doc"]) for r in rows) == Counter(repr(r) for r in df.select("*").collect())
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(9)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shuffle_of_few_rows(spark):
    assert op5_shard.shuffle(spark.createDataFrame([], SCHEMA), 5).count() == 0
    assert op5_shard.shuffle(spark.createDataFrame([(1, None, None, None, None, None)], SCHEMA), 5).count() == 1


def test_hypergeometric_has_its_distribution(spark):
    from math import comb

    drawn = spark.range(20000).select(
        contingency.hypergeometric(F.lit(20), F.lit(7), F.lit(6), (F.pmod(F.xxhash64("id"), F.lit(1 << 40)) + 0.5) / float(1 << 40)).alias("x")
    )
    seen = {r["x"]: r["count"] for r in drawn.groupBy("x").count().collect()}
    for x in range(7):
        p = comb(7, x) * comb(13, 6 - x) / comb(20, 6)
        assert abs(seen.get(x, 0) - 20000 * p) <= 5 * (20000 * p * (1 - p)) ** 0.5 + 1


def test_split_tree_meets_all_margins(spark):
    totals, leaves = [500, 3, 0, 77], [10, 200, 0, 370]
    sums = spark.createDataFrame([(i, sum(leaves[:i])) for i in range(5)], "pos long, sum long")
    vector = spark.createDataFrame([(totals,)], "vec array<long>")
    rows = contingency.split_tree(vector, sums, 4, 1).collect()
    assert [sum(r["n"] for r in rows if r["entry"] == e) for e in range(4)] == totals
    assert [sum(r["n"] for r in rows if r["leaf"] == k) for k in range(4)] == leaves and min(r["n"] for r in rows) >= 0
