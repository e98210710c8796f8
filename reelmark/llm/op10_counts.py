"""Token counts: pieces are counted once per distinct pre-token, then joined to the documents' frequencies.

A task takes its documents in bounded blocks. Pre-tokens are found in numpy; those not met
before in the task go through the vocabulary's merges once, for their number of pieces; a document's
count is the sum over its pre-tokens. No ids are made and nothing is shuffled: a join of all (document,
pre-token) rows over the network would move several times the input (README).

Counts are those of the library with its defaults: special strings inside a text are one token each.
Documents holding such a string, or signs whose normal form or class could depend on the Unicode version,
take the library's own normalizer and splitter.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows and null ids are counted
row by row; an empty table gives an empty result. Only the id and the text are read, so other columns
can't clash.
"""

from __future__ import annotations

import functools
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmark.llm import pretokens

#: Above this code point (Latin letters end here) a document goes through the library's normalizer.
PLAIN = 0x24F


@functools.lru_cache(2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(1)
def byte_signs() -> dict[int, str]:
    """The signs that byte-level vocabularies write for bytes: printable ones stay, others move up from 256."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in kept]
    return {b: chr(0x100 + i) for i, b in enumerate(moved)}


def merge(path: str):
    """A function from one pre-token to its pieces."""
    pieces, signs = tokenizer(path).model.tokenize, byte_signs()
    return lambda token: pieces(token.encode().decode("latin-1").translate(signs))


def specials(path: str) -> list[str]:
    return [t.content for t in tokenizer(path).get_added_tokens_decoder().values()]


class Counter:
    """Token counts of texts under one vocabulary."""

    def __init__(self, path: str):
        self.library, self.specials = tokenizer(path), specials(path)
        pieces = merge(path)
        self.known = pretokens.Known(lambda tokens: np.fromiter((len(pieces(t)) for t in tokens), np.int64, len(tokens)))

    def _plain(self, text: str) -> str | None:
        """The normal form, or None if only the library can tell it."""
        if text.isascii():
            return None if any(s in text for s in self.specials) else text.lower()
        if max(text) > "ɏ" or any(s in text for s in self.specials):
            return None
        return unicodedata.normalize("NFC", text).lower()

    def counts(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        for first, end in pretokens.blocks(texts):
            plain = [self._plain(t) for t in texts[first:end]]
            whole, points, doc_starts = pretokens.joined([p or "" for p in plain])
            starts, ends = pretokens.word_spans(points, doc_starts)
            if len(starts):
                pieces = self.known.of(whole, points, starts, ends)
                sums = np.concatenate([[0], np.cumsum(pieces)])
                at = np.searchsorted(starts, doc_starts)
                out[first:end] = sums[at[1:]] - sums[at[:-1]]
            for i, p in enumerate(plain):
                if p is None:
                    out[first + i] = len(self.library.encode(texts[first + i], add_special_tokens=False))
        return out


def token_counts(docs: DataFrame, path: str, *, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in batches:
            parts = [counter.counts(texts) for _, texts in pretokens.text_blocks(batch.column(1))]
            counts = np.concatenate([np.zeros(0, np.int64), *parts])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts)], names=[id_column, "n_bytes", "n_tokens"])

    given = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_column), given.alias("_text"), F.octet_length(given).cast("long").alias("_bytes"))
    kind = docs.schema[id_column].dataType.simpleString()
    return rows.mapInArrow(count, f"`{id_column}` {kind}, n_bytes long, n_tokens long")
