"""Connected components of very large, very uneven graphs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmark.session import cut_lineage

BATCH = 1 << 20  # links looked at together in a task
HUB, SALTS = 2048, 32  # links of a node that meet in one task; keys that a node's links have in the join with the hubs


def least_labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of these links, and the least node that each reaches by them."""
    nodes, back = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = back[: len(u)], back[len(u) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _contract(limit: int):
    """Stars for the links of a task, ``limit`` at a time; ``new`` counts links that were not there.

    The last node's link goes along into the next batch, where more of its links may follow.
    """

    def star(parts: list[pa.RecordBatch], carried: list[tuple]) -> tuple[pa.RecordBatch, list[tuple]]:
        u = np.concatenate([np.array([c[0] for c in carried], np.int64), *(p.column(0).to_numpy() for p in parts)])
        v = np.concatenate([np.array([c[1] for c in carried], np.int64), *(p.column(1).to_numpy() for p in parts)])
        nodes, root = least_labels(u, v)
        moved = nodes != root
        links = u != v
        known = np.unique(np.stack([np.maximum(u, v)[links], np.minimum(u, v)[links]], axis=1), axis=0)
        out = np.stack([nodes[moved], root[moved]], axis=1)
        same = len(known) + len(out) - len(np.unique(np.concatenate([known, out]), axis=0))
        new = np.zeros(len(out), np.int64)
        new[:1] = max(len(out), len(known)) - same
        last = u[-1]
        batch = pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1]), pa.array(new)], names=["u", "v", "new"])
        return batch, [(last, root[np.searchsorted(nodes, last)])]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, carried = [], 0, []
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= limit:
                out, carried = star(held, carried)
                yield out
                held, rows = [], 0
        if rows:
            yield star(held, carried)[0]

    return work


def _parted(links: DataFrame, hub: int) -> DataFrame:
    """Adds ``part``: a node's links in parts of about ``hub``, each with the link to the node's least neighbour.

    That link is what makes all parts of a node arrive at the same root.
    """
    hubs = links.groupBy("u").agg(F.count(F.lit(1)).alias("_links"), F.min("v").alias("_least")).where(F.col("_links") > hub)
    hubs = hubs.withColumn("_parts", F.ceil(F.col("_links") / hub).cast("int"))
    salted = hubs.select("u", "_parts", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    spread = links.withColumn("_salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(salted, ["u", "_salt"], "left")
    part = F.coalesce(F.pmod(F.xxhash64("v", F.lit(1)), F.col("_parts")), F.lit(0)).cast("int")
    least = hubs.select("u", F.col("_least").alias("v"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part"))
    return spread.select("u", "v", part.alias("part")).unionByName(least)


def components(edges: DataFrame, batch: int = BATCH, hub: int = HUB) -> DataFrame:
    """(node, root) for every node of (u, v); root is the least node of its component.

    Round by round, a node's links, smaller and larger, meet in one task, which contracts what it has to
    stars, so links move to ever smaller nodes until no task finds anything to move. The links of a node with
    more than ``hub`` are dealt out in parts, and a task looks at a batch of links at a time, handing its last
    node's link on to the next. Every round is a written table.
    """
    stars = "u long, v long, new long"
    # Written, as a round reads its links four times, and they may be costly to find.
    now = cut_lineage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        dealt = _parted(both, hub).repartition("u", "part").sortWithinPartitions("u", "part").select("u", "v")
        now = cut_lineage(dealt.mapInArrow(_contract(batch), stars))
        if not now.agg(F.sum("new")).first()[0]:
            break
    leaves = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return leaves.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
