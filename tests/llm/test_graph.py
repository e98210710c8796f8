import random

import numpy as np
import pytest

from reelmark.llm import graph


def brute(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


@pytest.mark.parametrize("batch, hub", [(1 << 20, 1 << 20), (40, 1 << 20), (1 << 20, 20), (40, 7)])
def test_components_of_paths_hubs_and_random_links(spark, batch, hub):
    draw = random.Random(3)
    edges = [(i, i + 1) for i in range(2000, 2120)] + [(5000, 5000 + i) for i in range(1, 300)]
    edges += [(7000, 6000 + i) for i in range(1, 300)]  # the hub is the greatest
    edges += [(draw.randrange(600), draw.randrange(600)) for _ in range(360)] + [(7, 7)] + [(i + 1, i) for i in range(9000, 9040)]
    draw.shuffle(edges)
    # Small Arrow batches, so that a hub's links span several of a task.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        found = graph.components(spark.createDataFrame(edges, "u long, v long").repartition(5), batch, hub).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r["node"]: r["root"] for r in found} == brute(edges)


def test_no_links(spark):
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_least_labels():
    nodes, root = graph.least_labels(np.array([9, 5, 3]), np.array([5, 4, 2]))
    assert dict(zip(nodes.tolist(), root.tolist())) == {9: 4, 5: 4, 4: 4, 3: 2, 2: 2}


def test_links_are_found_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    edges = spark.range(0, 1000, 1, 4).selectExpr("id AS u", "id div 10 AS v").mapInArrow(counted, "u long, v long")
    assert graph.components(edges).select("root").distinct().count() == 1
    assert seen.value == 1000
