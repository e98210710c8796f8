"""Pre-tokens of many documents at once, in numpy.

A vocabulary's pre-tokenizer splits text into runs of letters, numbers, other signs and white space. Here
the code points of a block of documents are classed by table, token starts and ends follow from where
classes change, and equal tokens are found by their bytes. A block is bounded, whatever the
documents: `blocks` cuts between documents, and one document is the least it can hold.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_CHARS = 1 << 20
#: Classes of code points.
SPACE, LETTER, NUMBER, OTHER, BREAK = 0, 1, 2, 3, 4
#: The endings that a split apostrophe takes along.
SHORT_ENDINGS, LONG_ENDINGS = "stmd", ("re", "ve", "ll")


@functools.lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8)
    for c in [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]:
        table[c] = SPACE
    return table


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values; equal ones stay equal."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Of spans of UTF-8 bytes that follow each other: which of the distinct ones each is, and these. Equal means equal bytes."""
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1  # a span that starts where another ends stays inside
    held = data[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
    offsets = np.zeros(len(starts) + 1, np.int32 if len(held) < 1 << 31 else np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    kind = pa.binary() if offsets.dtype == np.int32 else pa.large_binary()
    spans = pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(held)]).dictionary_encode()
    return spans.indices.to_numpy(), spans.dictionary


def byte_places(points: np.ndarray) -> np.ndarray:
    """Where each code point, and the end, lies in the UTF-8 form."""
    places = np.zeros(len(points) + 1, np.int64)
    np.cumsum(1 + (points >= 0x80).view(np.int8) + (points >= 0x800).view(np.int8) + (points >= 0x10000).view(np.int8), out=places[1:])
    return places


def blocks(texts: list[str], limit: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``limit`` characters, or of one document."""
    first = held = 0
    for i, text in enumerate(texts):
        if held and held + len(text) > limit:
            yield first, i
            first = i
            held = 0
        held += len(text) + 1
    if first < len(texts):
        yield first, len(texts)


def text_blocks(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of a batch's blocks: only a block's texts are Python strings at a time; null is empty.

    Afterwards memory that Arrow keeps for reuse goes back, as a worker outlives its stage.
    """
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy()
    ends = np.cumsum(sizes + 1)
    first = 0
    while first < len(column):
        end = int(np.searchsorted(ends, (ends[first - 1] if first else 0) + BLOCK_CHARS, side="right"))
        end = max(first + 1, end)
        yield first, [t or "" for t in column.slice(first, end - first).to_pylist()]
        first = end
    pa.default_memory_pool().release_unused()


def joined(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts after each other with a break after each, their code points, and where each text starts."""
    whole = "\x00".join(texts) + "\x00"
    points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return whole, points, starts


def _contractions(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of apostrophes at ``starts`` that take an ending along, and how long it is."""
    at = starts[points[starts] == ord("'")]
    one, two = points[at + 1], points[np.minimum(at + 2, len(points) - 1)]
    size = np.isin(one, [ord(c) for c in SHORT_ENDINGS]).astype(np.int64)
    for a, b in LONG_ENDINGS:
        size = np.maximum(size, 2 * ((one == ord(a)) & (two == ord(b))))
    return at[size > 0], size[size > 0]


def _kinds(points: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    kind = classes()[points]
    kind[doc_starts[1:] - 1] = BREAK
    return kind


def word_spans(points: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of letter runs, single numbers and runs of other signs; white space is dropped."""
    kind = _kinds(points, doc_starts)
    change = np.empty(len(kind), bool)
    change[0] = True
    change[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    at, size = _contractions(points, np.flatnonzero(change & (kind == OTHER)))
    change[at + 1] = False
    after = at + 1 + size
    change[after[kind[after] == LETTER]] = True
    starts = np.flatnonzero(change)
    ends = np.append(starts[1:], len(kind))
    kept = (kind[starts] != SPACE) & (kind[starts] != BREAK)
    return starts[kept], ends[kept]


def byte_spans(points: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that take one leading blank along; of other white space the last sign stands alone."""
    kind = _kinds(points, doc_starts)
    change = np.empty(len(kind), bool)
    change[0] = True
    change[1:] = kind[1:] != kind[:-1]
    runs = np.flatnonzero(change & (kind != SPACE) & (kind != BREAK))
    led = runs[runs > 0]
    led = led[points[led - 1] == 0x20]
    opening = np.setdiff1d(np.flatnonzero(change & (kind == OTHER)), led, assume_unique=True)
    # A run of white space before a token gives its last sign up: a blank joins the token, any other stands alone.
    last = np.flatnonzero(change[1:] & (kind[:-1] == SPACE) & (kind[1:] != BREAK))
    change[last] = True
    change[led] = False
    at, size = _contractions(points, opening)
    change[at + 1] = False
    after = at + 1 + size
    change[after[kind[after] == LETTER]] = True
    starts = np.flatnonzero(change)
    ends = np.append(starts[1:], len(kind))
    kept = kind[starts] != BREAK
    return starts[kept], ends[kept]


class Known:
    """Results per distinct token; forgets everything once it holds ``limit`` tokens.

    ``work`` maps a list of distinct token strings to an array with a value each.
    """

    def __init__(self, work, limit: int = 1 << 19):
        self.work, self.limit = work, limit
        self.values: dict[bytes, int] = {}

    def of(self, whole: str, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The value of each token; ``work`` sees every token not known yet once."""
        if not len(starts):
            return np.empty(0, np.int64)
        places = byte_places(points)
        which, tokens = distinct(np.frombuffer(whole.encode(), np.uint8), places[starts], places[ends])
        tokens = tokens.to_numpy(zero_copy_only=False).tolist()  # bytes, without a scalar for each
        found = list(map(self.values.get, tokens))
        new = [t for t, value in zip(tokens, found) if value is None]
        if new:
            if len(self.values) + len(new) > self.limit:
                self.values, new, found = {}, tokens, [None] * len(tokens)
            values = self.work([t.decode() for t in new]).tolist()
            self.values.update(zip(new, values))
            added = iter(values)
            found = [next(added) if value is None else value for value in found]
        return np.array(found, np.int64)[which]
