"""Packing: order-preserving dynamic programming over token windows, with a monotone queue.

Documents keep their order. Their tokens form one stream per task, cut into windows of at most ``limit``
tokens. A cut at a document's end is free, at a sentence's end or inside one it costs a truncation
penalty; a window costs its padding. With P the places a cut may be and f the least cost so far,

    f(j) = penalty(j) + limit - j + min { f(i) + i : j - limit <= i < j },

a minimum over a sliding window, kept in a monotone queue: every place enters and leaves it once. Where
sentences are longer than a window, every ``limit``-th token is a place too. Windows whose length is a
power of two need no padding, so a stream's last, short window is split into such lengths.

The stream is worked off in bounded stretches: the plan of a stretch is kept up to its last cut but one,
where the next stretch takes over. A task holds one batch of documents at a time, and nothing is
shuffled; a window's id names the task and its place there. A repeated task gives the same pieces if it
reads the same rows, as it does from files; write a table first whose order may change.

Defined results: a null text is empty; an empty document is its end token alone; a document longer than a
window is cut; repeated rows and null ids are packed row by row; an empty table gives no pieces. Only the
id and the text are read.
"""

from __future__ import annotations

import functools
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmark.llm import pretokens
from reelmark.llm.op10_counts import byte_signs, specials, tokenizer

STRETCH = 1 << 18  # tokens
MID_DOCUMENT, MID_SENTENCE = 2, 8  # penalties, in tokens of padding
FILLS = 4  # exact windows in a row that may follow a sentence's end
NO_CUT = 1 << 40


def windows(places: list[int], penalties: list[int], limit: int) -> list[int]:
    """The cheapest cuts from 0 to places[-1]; no two places are more than ``limit`` apart."""
    at = [0, *places]
    back, queue, where, value = ([0] * len(at) for _ in range(4))  # queue: numbers, places and f(i) + i, rising from head on
    head = tail = 0
    for j, (here, penalty) in enumerate(zip(places, penalties), 1):
        while where[head] < here - limit:
            head += 1
        back[j] = queue[head]
        best = value[head] + limit + penalty  # f(j) + j; above that of the head, where the search below ends
        while value[tail] >= best:
            tail -= 1
        tail += 1
        queue[tail], where[tail], value[tail] = j, here, best
    cuts = []
    j = len(at) - 1
    while j:
        cuts.append(at[j])
        j = back[j]
    return cuts[::-1]


@functools.lru_cache(1)
def sign_points() -> np.ndarray:
    """The code point that stands for each byte in a vocabulary; 255 stays, as the mark between tokens."""
    return np.array([ord(s) for s in bytes(range(256)).decode("latin-1").translate(byte_signs())], "<u4")


class Ids:
    """Token ids of texts: the merges run once per distinct pre-token of a task, ids are gathered from there."""

    def __init__(self, path: str):
        self.library, self.specials = tokenizer(path), specials(path)
        self.merge = self.library.model.tokenize
        self.known = pretokens.Known(self._add)
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.places = np.zeros(1, np.int64)  # where the ids of each known pre-token end

    def _add(self, tokens: list[str]) -> np.ndarray:
        """Stores the ids of the tokens; returns the number of each."""
        raw = "\udcff".join(tokens).encode("utf-8", "surrogateescape")  # byte 255 between, which no UTF-8 holds
        signs = sign_points()[np.frombuffer(raw, np.uint8)].tobytes().decode("utf-32-le")
        lists = [[p.id for p in self.merge(t)] for t in signs.split("\xff")]
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        new = np.fromiter(itertools.chain.from_iterable(lists), np.uint32, size.sum())
        if self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.empty(max(self.used, len(new)), np.uint32)])
        self.flat[self.used : self.used + len(new)] = new
        first = len(self.places) - 1
        self.places = np.concatenate([self.places, self.used + np.cumsum(size)])
        self.used += len(new)
        return np.arange(first, first + len(size))

    def of(self, texts: list[str], end: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """All ids after each other, ``end`` after each text; where each text's ids end."""
        odd = {i for i, t in enumerate(texts) if any(s in t for s in self.specials)}
        whole, points, doc_starts = pretokens.joined(["" if i in odd else t for i, t in enumerate(texts)])
        starts, stops = pretokens.byte_spans(points, doc_starts)
        found = self.known.of(whole, points, starts, stops)
        place, size = self.places[found], self.places[found + 1] - self.places[found]
        sums = np.concatenate([[0], np.cumsum(size)])
        flat = self.flat[np.repeat(place - sums[:-1], size) + np.arange(sums[-1])]
        ends = sums[np.searchsorted(starts, doc_starts[1:])]
        parts = [end] * len(texts)
        if odd:
            pieces, last = [], 0
            for i, stop in enumerate(ends.tolist()):
                own = flat[last:stop] if i not in odd else self.library.encode(texts[i], add_special_tokens=False).ids
                pieces.append(np.append(np.asarray(own, np.uint32), np.uint32(end)))
                last = stop
            return np.concatenate(pieces), np.cumsum([len(p) for p in pieces])
        if self.used > 1 << 23:  # forget: the arrays above are copies
            self.known = pretokens.Known(self._add)
            self.used, self.places = 0, np.zeros(1, np.int64)
        return np.insert(flat, ends, parts).astype(np.uint32), ends + np.arange(1, len(texts) + 1)


def sentence_ends(path: str) -> np.ndarray:
    """Which ids end a sentence or line."""
    library = tokenizer(path)
    size = library.get_vocab_size(with_added_tokens=True)
    out = np.zeros(size, bool)
    for i in range(size):
        out[i] = library.decode([i]).endswith((".", "!", "?", "\n"))
    return out


class Packer:
    """Cuts a stream of documents, given in order, into windows; `add` and `close` give finished pieces."""

    def __init__(self, limit: int, is_end: np.ndarray):
        self.limit, self.is_end = limit, is_end
        self.ids, self.ends = np.empty(0, np.uint32), np.empty(0, np.int64)
        self.docs: list[tuple] = []  # (key, start of the stream within it, its length) of those in the stream
        self.sequence = 0

    def add(self, ids: np.ndarray, ends: np.ndarray, keys: list) -> Iterator[tuple]:
        sizes = np.diff(ends, prepend=0).tolist()
        self.docs += [(key, 0, size) for key, size in zip(keys, sizes)]
        self.ends = np.concatenate([self.ends, ends + len(self.ids)])
        self.ids = np.concatenate([self.ids, ids])
        while len(self.ids) > STRETCH:
            yield from self._pack(STRETCH)

    def close(self) -> Iterator[tuple]:
        while len(self.ids) > STRETCH:
            yield from self._pack(STRETCH)
        if len(self.ids):
            yield from self._pack(len(self.ids), last=True)

    def _places(self, until: int) -> tuple[list[int], list[int]]:
        inside = self.is_end[np.minimum(self.ids[:until], len(self.is_end) - 1)]
        docs = self.ends[self.ends <= until]
        penalty = np.full(until + 1, NO_CUT, np.int64)
        penalty[np.flatnonzero(inside) + 1] = MID_DOCUMENT
        penalty[docs] = 0
        penalty[until] = min(penalty[until], MID_SENTENCE)
        at = np.flatnonzero(penalty[1:] < NO_CUT) + 1
        # Exact fills: full windows one after another from each place, so that long sentences are crossed too.
        filled = np.concatenate([[0], at])[:, None] + self.limit * np.arange(1, FILLS + 1)
        filled = filled[filled <= until]
        gaps = np.diff(at, prepend=0)
        long = np.flatnonzero(gaps > self.limit)
        steps = [np.arange(at[k] - gaps[k] + self.limit, at[k], self.limit) for k in long]
        more = np.concatenate([filled, *steps]).astype(np.int64)
        penalty[more] = np.minimum(penalty[more], MID_SENTENCE)
        at = np.flatnonzero(penalty[1:] < NO_CUT) + 1
        return at.tolist(), penalty[at].tolist()

    def _pack(self, until: int, last: bool = False) -> Iterator[tuple]:
        cuts = windows(*self._places(until), self.limit)
        if last:
            start = cuts[-2] if len(cuts) > 1 else 0
            rest, tail = cuts.pop() - start, []
            while rest:
                tail.append(1 << (rest.bit_length() - 1))
                rest -= tail[-1]
            cuts += (start + np.cumsum(tail)).tolist()
        elif len(cuts) > 1:
            cuts.pop()  # the next stretch goes on from the last cut but one
        edges = np.unique(np.concatenate([[0], cuts, self.ends[self.ends < cuts[-1]]])).tolist()
        cut_at = set(cuts)
        doc, window = 0, 0
        ends = self.ends.tolist()
        doc_from = 0
        for a, b in zip(edges, edges[1:]):
            while ends[doc] <= a:
                doc_from = ends[doc]
                doc += 1
            key, skipped, size = self.docs[doc]
            yield key, skipped + a - doc_from, self.ids[a:b], size, self.sequence, a - window
            if b in cut_at:
                self.sequence += 1
                window = b
        done = cuts[-1]
        gone = int(np.searchsorted(self.ends, done, side="right"))
        begin = ends[gone - 1] if gone else 0
        self.docs = self.docs[gone:]
        if self.docs:
            key, skipped, size = self.docs[0]
            self.docs[0] = (key, skipped + done - begin, size)
        self.ids, self.ends = self.ids[done:].copy(), self.ends[gone:] - done


def pack(docs: DataFrame, path: str, *, id_column: str = "doc_id", text: str = "text", limit: int = 1024, end: int = 0) -> DataFrame:
    """A row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the piece's ids (binary)."""
    kind = docs.schema[id_column].dataType.simpleString()
    schema = (
        f"`{id_column}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
        "offset long, ids binary"
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer = Ids(path), Packer(limit, sentence_ends(path))
        base = TaskContext.get().partitionId() << 33

        def out(pieces: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            rows = []
            for key, start, ids, size, sequence, offset in pieces:
                raw = ids.astype("<u4").tobytes()
                rows.append((key, start, len(ids), zlib.crc32(raw), size, base + sequence, offset, raw))
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

        names = [id_column, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        types = [None, *[pa.int64()] * 6, pa.binary()]
        for batch in batches:
            types[0] = batch.schema.field(0).type
            keys = batch.column(0).to_pylist()
            for first, texts in pretokens.text_blocks(batch.column(1)):
                yield from out(packer.add(*coder.of(texts, end), keys[first : first + len(texts)]))
        yield from out(packer.close())

    rows = docs.select(F.col(id_column), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return rows.mapInArrow(cut, schema)
