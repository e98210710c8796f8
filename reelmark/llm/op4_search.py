"""Exact top-k search with vector-approximation files.

Components are integers, floor(256 * x). Candidates lie in blocks, queries too, and every pair of blocks
meets in one task, which holds the candidates' approximation: each component's range in the block is cut
into 16 cells. Scanning the cells bounds every inner product from below and above. The k-th greatest lower
bound rules most candidates out; exact vectors of the others are read in the order of their upper
bounds until the k-th score found is above every bound left. A block hands on k candidates a query, and
the best k of these are the result.

Every query meets every candidate in blocks: the query set is a stated share of the rows. A task holds one
block of each kind; nothing is broadcast.

Defined results: vectors that are null, empty or hold a null or non-finite component, and rows without
id, take no part; vectors meet only those with as many components; repeated ids are separate rows, so a
copy may be found by its twin; a query with fewer candidates returns all of them; an empty table gives an
empty result. Integers past 64 bits saturate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmark.llm import vectors
from reelmark.session import cut_lineage

CANDIDATES, QUERIES, STEP = 8192, 1024, 64
CELLS = 16
EXACT = 1 << 52


def block_top(query: np.ndarray, query_rows: np.ndarray, cand: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple]:
    """(query index, candidate index, score) of the k best of each query; ties go to the smaller id."""
    low, high = cand.min(axis=0), cand.max(axis=0)
    most = float(np.abs(query.astype(float)).max()) * max(abs(float(low.min())), abs(float(high.max())), 1.0) * query.shape[1] * CELLS
    if most >= EXACT:  # doubles can't hold the sums: Python integers do
        wide = cand.astype(object)
        for i, q in enumerate(query.astype(object)):
            best = sorted((-int(s), int(ids[j]), j) for j, s in enumerate(wide @ q) if rows[j] != query_rows[i])[:k]
            for s, _, j in best:
                yield i, j, max(-(1 << 63), min((1 << 63) - 1, -s))
        return
    width = (high - low) // CELLS + 1
    cells = ((cand - low) // width).astype(np.uint8)
    q = query.astype(np.float64)
    base = (q * width) @ cells.T.astype(np.float64) + (q @ low.astype(np.float64))[:, None]
    below = np.minimum(q, 0) @ (width - 1).astype(np.float64)
    above = np.maximum(q, 0) @ (width - 1).astype(np.float64)
    at = {int(r): j for j, r in enumerate(rows.tolist())}
    exact = cand.astype(np.float64)
    for i in range(len(q)):
        bound = base[i]
        own = at.get(int(query_rows[i]))
        if own is not None:
            bound[own] = -np.inf
        if len(bound) > k:
            certain = np.partition(bound, len(bound) - k)[len(bound) - k] + below[i]
            left = np.flatnonzero(bound + above[i] >= certain)
        else:
            left = np.arange(len(bound))
        left = left[np.isfinite(bound[left])]
        left = left[np.argsort(-bound[left], kind="stable")]
        found = np.empty(0)
        for start in range(0, len(left), STEP):
            if len(found) >= k and bound[left[start]] + above[i] < np.partition(found, len(found) - k)[len(found) - k]:
                left = left[:start]
                break
            found = np.append(found, exact[left[start : start + STEP]] @ q[i])
        for j in np.lexsort((ids[left], -found[: len(left)]))[:k].tolist():
            yield i, int(left[j]), int(found[j])


def top_k(table: DataFrame, is_query: Column, k: int, *, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k greatest inner products of every row for which ``is_query`` (over ``id``) holds."""
    whole = F.transform("x", lambda x: F.floor(x.cast("double") * 256).cast("bigint"))
    found = vectors.rows(table, id_column, vector).where(F.col("ok") & F.col("id").isNotNull())
    found = cut_lineage(found.select("row", "id", whole.alias("x"), F.size("x").alias("dim"), is_query.alias("asks")))
    counts = found.agg(F.count(F.lit(1)), F.count(F.when(F.col("asks"), 1))).first()
    blocks, sets = -(-max(1, counts[0]) // CANDIDATES), -(-max(1, counts[1]) // QUERIES)
    spread = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cand = found.select("dim", "row", "id", "x", spread(blocks).alias("block"), every(sets).alias("set"))
    asked = found.where("asks").select("dim", "row", "id", "x", spread(sets).alias("set"), every(blocks).alias("block"))

    def search(asks: pa.Table, given: pa.Table) -> pa.Table:
        out = []
        if len(asks) and len(given):
            query, own = vectors.matrix(asks["x"], np.int64), asks["row"].to_numpy()
            cands, rows, ids = vectors.matrix(given["x"], np.int64), given["row"].to_numpy(), given["id"].to_numpy()
            names = asks["id"].to_numpy()
            out = [(own[i], names[i], ids[j], rows[j], s) for i, j, s in block_top(query, own, cands, rows, ids, k)]
        columns = list(zip(*out)) if out else [()] * 5
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["ask", "query_id", "vec_id", "row", "score"])

    keys = ["dim", "block", "set"]
    near = asked.groupBy(*keys).cogroup(cand.groupBy(*keys)).applyInArrow(
        search, "ask long, query_id long, vec_id long, row long, score long"
    )
    best = Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id", "row")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
