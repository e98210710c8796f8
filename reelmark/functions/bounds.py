"""Scoring pages of sparse query vectors against pages of candidates, block by block, inside a task.

A page is a row: vectors one after another, as bytes, with the ids that share each. A block is a few neighbouring
vectors of a candidate page; its greatest and least weight of every genre bound what any of its vectors can
score, so a query multiplies a block only where the bound reaches what the query already has. A task holds the
query pages of its cell with the best of each query so far, and sees the candidate pages one after another.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle

from reelmark.functions.blocks import DIGITS

SLACK = 10.0**-DIGITS  # scores are rounded before they are compared

# Workers get these functions by value, so the package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PAGE_COLUMNS = (
    "page long, ids array<{id}>, held array<int>, sizes binary, genres binary, weights binary, "
    "names array<string>, tops array<double>, lows array<double>, sums array<double>, most int"
)


def _list(column: pa.Array, row: int) -> pa.Array:
    return column.slice(row, 1).flatten()


def pack(size: int, signed: bool):
    """Rows (ids, vector) in order to pages of ``size`` vectors."""

    def packed(rows: list[tuple[pa.RecordBatch, int, int]], number: int) -> list:
        parts = [b.slice(first, count) for b, first, count in rows]
        ids, vectors = (pa.concat_arrays([p.column(i) for p in parts]) for i in (0, 1))
        flat = vectors.flatten()
        genres, weights = flat.field("genre"), flat.field("weight").to_numpy()
        if not signed and len(weights) and weights.min() < 0:
            raise ValueError("negative weights: search with signed=True")
        coded = genres.dictionary_encode()
        tops, lows, sums = (np.zeros(len(coded.dictionary)) for _ in range(3))
        np.add.at(sums, coded.indices.to_numpy(), weights)
        np.maximum.at(tops, coded.indices.to_numpy(), weights)
        np.minimum.at(lows, coded.indices.to_numpy(), weights)
        sizes = vectors.value_lengths().to_numpy().astype(np.int32)
        names = coded.dictionary.to_pylist()
        if signed:  # an entry that all pages share lets every pair of pages meet
            names, tops, lows, sums = [*names, ""], np.append(tops, 0.0), np.append(lows, 0.0), np.append(sums, 0.0)
        held = ids.value_lengths().to_pylist()
        return [
            number, ids.flatten().to_pylist(), held, sizes.tobytes(), coded.indices.to_numpy().astype(np.int32).tobytes(),
            weights.astype(np.float64).tobytes(), names, tops.tolist(), lows.tolist(), sums.tolist(), int(sizes.max(initial=0)),
        ]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, waiting, count = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            first = 0
            kind = batch.schema.field(0).type
            while first < batch.num_rows:
                some = min(size - count, batch.num_rows - first)
                waiting.append((batch, first, some))
                first, count = first + some, count + some
                if count == size:
                    yield _page(packed(waiting, number), kind)
                    number, waiting, count = number + 1, [], 0
        if waiting:
            yield _page(packed(waiting, number), waiting[0][0].schema.field(0).type)

    return work


def _page(row: list, ids: pa.DataType) -> pa.RecordBatch:
    texts, numbers, counts = pa.list_(pa.string()), pa.list_(pa.float64()), pa.list_(pa.int32())
    kinds = [pa.int64(), ids, counts, pa.binary(), pa.binary(), pa.binary(), texts, numbers, numbers, numbers, pa.int32()]
    names = ["page", "ids", "held", "sizes", "genres", "weights", "names", "tops", "lows", "sums", "most"]
    return pa.RecordBatch.from_arrays([pa.array([value], kind) for value, kind in zip(row, kinds)], names=names)


class _Vectors:
    """A page's vectors: genres are numbers of ``names``."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        self.page = batch.column("page")[row].as_py()
        self.sizes, self.genres = (np.frombuffer(batch.column(c)[row].as_py(), np.int32) for c in ("sizes", "genres"))
        self.weights = np.frombuffer(batch.column("weights")[row].as_py(), np.float64)
        self.names, self.most = batch.column("names")[row].as_py(), batch.column("most")[row].as_py()

    def over(self, columns: dict[str, int]) -> np.ndarray:
        """Dense, over the given genres."""
        out = np.zeros((len(self.sizes), len(columns)))
        if len(self.weights):
            at = np.array([columns.get(g, -1) for g in self.names], np.int64)[self.genres]
            vector = np.repeat(np.arange(len(self.sizes)), self.sizes)
            out[vector[at >= 0], at[at >= 0]] = self.weights[at >= 0]
        return out


class _Queries(_Vectors):
    """A page of queries, with the best of each so far; a floor is what a score must reach, ``lasts`` the id that has it."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        super().__init__(batch, row)
        self.columns = {g: i for i, g in enumerate(self.names)}
        self.floors = np.array(batch.column("floors")[row].as_py(), float)
        self.lasts = batch.column("lasts")[row].as_py()
        self.best: dict[int, list[tuple]] = {}
        self.met = self.multiplied = 0

    def keep(self, q: int, ways: list[tuple], k: int) -> None:
        """Of what was found for a query and (-score, id) now, the first k."""
        best = self.best[q] = sorted({*self.best.get(q, ()), *ways})[:k]
        if len(best) == k:
            least, last = best[-1]
            if -least > self.floors[q] or -least == self.floors[q] and (self.lasts[q] is None or last < self.lasts[q]):
                self.floors[q], self.lasts[q] = -least, last


class _Candidates(_Vectors):
    """A page of candidates, with the ids that share each vector and the pages of queries that it shall meet."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        super().__init__(batch, row)
        held, ids = (_list(batch.column(c), row) for c in ("held", "ids"))
        ends, ids = np.cumsum(held.to_numpy()), ids.to_pylist()
        self.members = [ids[e - h : e] for h, e in zip(held.to_pylist(), ends.tolist())]
        self.wanted = batch.column("wanted")[row].as_py()


def bounds(queries: np.ndarray, candidates: np.ndarray, starts: np.ndarray, most: int) -> np.ndarray:
    """What no vector of a block can score above, for each query (rows) and block.

    No vector has more than ``most`` genres, so only that many of the greatest terms can come together.
    """
    tops = np.maximum(np.maximum.reduceat(candidates, starts), 0)
    lows = np.minimum(np.minimum.reduceat(candidates, starts), 0)
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    out = np.zeros((len(queries), len(starts)))
    for block in range(len(starts)):
        used = np.flatnonzero((tops[block] > 0) | (lows[block] < 0))
        if len(used) <= most:
            out[:, block] = up[:, used] @ tops[block, used] + down[:, used] @ lows[block, used]
            continue
        terms = up[:, used] * tops[block, used] + down[:, used] * lows[block, used]
        out[:, block] = np.partition(terms, len(used) - most, axis=1)[:, len(used) - most :].sum(axis=1)
    return out


class _Pair:
    """A page of queries against a page of candidates."""

    def __init__(self, asked: _Queries, page: _Candidates, k: int, block: int):
        self.k, self.asked = k, asked
        self.queries, self.candidates = asked.over(asked.columns), page.over(asked.columns)
        self.floors, self.lasts, self.members = asked.floors.copy(), asked.lasts, page.members
        self.starts = np.arange(0, len(self.members), block)
        self.bounds = bounds(self.queries, self.candidates, self.starts, page.most) + SLACK
        self.scores = np.full((len(self.queries), len(self.members)), -np.inf)
        self.multiplied = np.zeros(self.bounds.shape, bool)

    def multiply(self, chosen: np.ndarray) -> None:
        chosen = chosen & ~self.multiplied
        self.multiplied |= chosen
        ends = [*self.starts[1:].tolist(), len(self.members)]
        for block, (start, end) in enumerate(zip(self.starts.tolist(), ends)):
            rows = np.flatnonzero(chosen[:, block])
            if len(rows):
                self.scores[rows, start:end] = (self.queries[rows] @ self.candidates[start:end].T).round(DIGITS)

    def run(self) -> None:
        """Hands on everything that can be among a query's k best."""
        unknown = np.isneginf(self.floors)
        if unknown.any():  # the most promising blocks first give a score that the others must reach
            first = min(len(self.starts), 1 + self.k // max(1, int(np.diff(np.append(self.starts, len(self.members))).min())))
            best = np.argpartition(-self.bounds, first - 1, axis=1)[:, :first]
            chosen = np.zeros_like(self.multiplied)
            np.put_along_axis(chosen, best, True, axis=1)
            self.multiply(chosen & unknown[:, None])
            if len(self.members) >= self.k:
                kth = -np.partition(-self.scores, self.k - 1, axis=1)[:, self.k - 1]
                self.floors = np.where(unknown, kth, self.floors)
        reach = self.bounds > self.floors[:, None]
        # Where the bound only equals what a query has, smaller ids decide.
        close = reach & (self.bounds <= self.floors[:, None] + 3 * SLACK)
        if close.any():
            least = [min(m for ids in self.members[s:e] for m in ids) for s, e in zip(self.starts, [*self.starts[1:], len(self.members)])]
            for q, b in zip(*np.nonzero(close)):
                reach[q, b] = self.lasts[q] is None or least[b] < self.lasts[q] or self.bounds[q, b] > self.floors[q] + 2 * SLACK
        self.multiply(reach)
        near = (self.scores >= self.floors[:, None]) & ~np.isneginf(self.scores)
        for q in np.flatnonzero(near.any(axis=1)).tolist():
            of = np.flatnonzero(near[q])
            if len(of) > self.k:
                scores = self.scores[q, of]
                kth = -np.partition(-scores, self.k - 1)[self.k - 1]
                of = of[scores >= kth]
            self.asked.keep(q, [(-float(self.scores[q, c]), i) for c in of.tolist() for i in self.members[c]], self.k)


def score(k: int, block: int, ids: pa.DataType, filler: int):
    """Cells of pages to (q_page, met, multiplied, found); counts are of pairs of pages, and of queries times blocks.

    Of a cell the pages of queries come first, then the pages of candidates, each with the numbers of those it meets.
    Pages numbered ``filler`` don't count.
    """
    entry = pa.list_(pa.struct([("at", pa.int32()), ("title", ids), ("similarity", pa.float64())]))
    schema = pa.schema([("q_page", pa.int64()), ("met", pa.int64()), ("multiplied", pa.int64()), ("found", entry)])

    def best(asked: _Queries) -> pa.RecordBatch:
        found = [{"at": q, "title": i, "similarity": -s} for q, ways in asked.best.items() for s, i in ways]
        values = [asked.page, asked.met, asked.multiplied, found]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, {}
        for batch in batches:
            for row in range(batch.num_rows):
                if batch.column("cell")[row].as_py() != cell:
                    yield from map(best, held.values())
                    cell, held = batch.column("cell")[row].as_py(), {}
                if batch.column("wanted")[row].as_py() is None:
                    asked = _Queries(batch, row)
                    held[asked.page] = asked
                    continue
                page = _Candidates(batch, row)
                for asked in map(held.get, page.wanted):
                    pair = _Pair(asked, page, k, block)
                    pair.run()
                    if page.page != filler:
                        asked.met += 1
                        asked.multiplied += int(pair.multiplied.sum())
        yield from map(best, held.values())

    return work
