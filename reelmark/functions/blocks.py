"""Scoring one block of sparse query vectors against one block of candidates, inside a task.

Spark decides which blocks meet and merges their results; a block is bounded whatever the data.
"""

from __future__ import annotations

import heapq
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle

DIGITS = 9  # similarities are rounded before ranking, so ties do not hang on summation order
CELLS = 4_000_000  # most scores held at once
STRIP = 256  # genres multiplied at a time

# Workers get these functions by value, so the package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _entries(vectors: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, genre and weight of every entry of every vector."""
    lengths = vectors["genres"].map(len).to_numpy()
    rows = np.repeat(np.arange(len(vectors)), lengths)
    if not len(rows):
        return rows, np.array([], dtype=object), np.array([])
    return rows, np.concatenate(vectors["genres"].to_list()), np.concatenate(vectors["weights"].to_list())


class _Sparse:
    """Vectors over a shared list of genres, read out as dense column strips."""

    def __init__(self, vectors: pd.DataFrame, genres: pd.Index):
        rows, names, weights = _entries(vectors)
        columns = genres.get_indexer(names)
        order = np.argsort(columns, kind="stable")
        order = order[np.searchsorted(columns[order], 0) :]  # entries outside the list are indexed -1
        self.rows, self.columns, self.weights = rows[order], columns[order], weights[order]
        self.height = len(vectors)

    def strip(self, start: int, width: int) -> np.ndarray:
        low, high = np.searchsorted(self.columns, [start, start + width])
        dense = np.zeros((self.height, width))
        dense[self.rows[low:high], self.columns[low:high] - start] = self.weights[low:high]
        return dense


def _similarity(queries: pd.DataFrame, candidates: pd.DataFrame) -> np.ndarray:
    names = _entries(queries)[1]
    genres = pd.Index(pd.unique(names))
    left, right = _Sparse(queries, genres), _Sparse(candidates, genres)
    similarity = np.zeros((left.height, right.height))
    for start in range(0, len(genres), STRIP):
        similarity += left.strip(start, STRIP) @ right.strip(start, STRIP).T
    return similarity.round(DIGITS)


def nearest_in_block(k: int):
    """Best k titles of one candidate block for each query of one query block."""

    def nearest(_key, queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(candidates):
            # By first title: of candidates with equal scores only the first k can then place, since each
            # stands for at least one title. For the same reason nothing below the k-th best score can.
            candidates = candidates.iloc[np.argsort(candidates["members"].str[0].to_numpy(), kind="stable")]
            members = candidates["members"].to_list()
            keep = min(k, len(candidates))
            batch = max(1, CELLS // len(candidates))
            for first in range(0, len(queries), batch):
                some = queries.iloc[first : first + batch]
                similarity = _similarity(some, candidates)
                floor = -np.partition(-similarity, keep - 1, axis=1)[:, keep - 1]
                for query_id, scores, least in zip(some["query_id"], similarity, floor):
                    chosen = [*np.flatnonzero(scores > least), *np.flatnonzero(scores == least)[:k]]
                    near = ((-scores[c], title) for c in chosen for title in members[c])
                    found.extend((query_id, title, -score) for score, title in heapq.nsmallest(k, near))
        return pd.DataFrame(found, columns=["query_id", "title", "similarity"])

    return nearest
