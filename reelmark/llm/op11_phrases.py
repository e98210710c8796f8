"""Phrase collocation mining by dynamic itemset counting.

The corpus is written once in shards, which are scanned over and over, one after another. Words are looked for from
the first shard on. A longer phrase is looked for from the scan after that by which both its beginning and
its end (all words but the last, all but the first) have come up to the threshold, whatever the lengths being
counted besides, in every shard once. Most phrases of all lengths thus start within the first cycle, instead of one pass
over the corpus per length.

A phrase that occurs often enough in all must occur its share of that in some shard. So a phrase looked for is
kept once a shard has that many, and a kept one is counted for one full cycle, until its count in each shard
is known; what no shard has its share of is counted by its shard and forgotten. The table of counts then holds few
phrases besides the frequent ones.

What a scan is to count is told to its tasks as bitmaps of hashes: of phrases that came up to the threshold, of those
that did so within the last cycle, and of kept phrases whose count in this shard is not known. Of the words and phrases looked
for, most are rare, so a scan reads its shard twice: first it adds up 64-bit hashes, and then counts the phrases whose hash
came up to the share. The hashes are shuffled many to a row, dealt by their first bits into groups of at most `GROUP`. Where few phrases reached the threshold lately, all that are looked for are counted at once. A bitmap or hash that takes one phrase for another lets too much be counted, never too little, and
what is counted is counted whole in its shard. Phrases are counted as strings; hashes only choose. Bitmaps have `BITS` bits
for each phrase in them up to `MAX_BITS`, beyond which they only choose less well. The driver holds those of one scan at a time.

Texts are split into words once, before the scans: of a language and shard they are taken together in blocks of bytes, and
a shard holds each block's distinct words, their hashes and their numbers. A block is bounded, as a long text is cut between pieces or, within
one, between words with the next words given along to be read but not started from. Counts are combined in the task and
summed after one shuffle. Phrases whose count is known in every shard are put aside; a scan joins its counts to the others only.

Defined results: a null text is empty and a null language ``und``; repeated rows count each; an empty table gives
no rows. Other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelmark.llm.frames import removed, written
from reelmark.session import cut_lineage, scratch_path

#: Signs between words of a piece, and signs between pieces.
BLANKS, BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
UNKNOWN = "und"
SHARDS = 3
BLOCK = 4 << 20  # bytes of text counted together
ROWS = 1 << 16  # counts handed on together
REACHED, RECENT, OPEN = range(3)  # kinds of bitmaps
BITS = 16  # of a bitmap for each phrase in it
MAX_BITS = 1 << 26
TALLY = 1 << 21  # hashes added up together in a task
GROUP = 1 << 20  # hashes, at most, whose sums over all tasks are made together
STEP = 1 << 14  # hashes worked on at once, which stay in a processor's cache
FEW = 16  # as many phrases have reached the threshold as did so lately: longer ones are counted without adding up hashes first
CHUNK_BITS = 15  # bits of a bitmap that one row holds
SEED = 42  # of Spark's xxhash64

_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)
_SEPARATORS = re.escape(BLANKS + BREAKS)
_SEPARATOR = re.compile(b"[" + _SEPARATORS + b"]")


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def hashed(values: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """xxhash64 of 64-bit values, as Spark's of a long on top of what came before: one seed for each value or for all."""
    out = np.empty(len(values), np.uint64)
    for at in range(0, len(values), STEP):
        out[at : at + STEP] = _hashed(values[at : at + STEP], seeds[at : at + STEP] if len(seeds) > 1 else seeds)
    return out


def _hashed(values: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    h = _turned((seeds + (_P5 + np.uint64(8))) ^ (_turned(values * _P2, 31) * _P1), 27) * _P1 + _P4
    h ^= h >> np.uint64(33)
    h *= _P2
    h ^= h >> np.uint64(29)
    h *= _P3
    h ^= h >> np.uint64(32)
    return h


def _phrase_hash():
    """Of a language and a phrase, in Spark; `hashed` chains to the same."""
    words = F.transform(F.split("phrase", " "), lambda w: F.xxhash64(w))
    return F.xxhash64(F.concat(F.array(F.xxhash64("lang")), words))


def _kinds() -> np.ndarray:
    kinds = np.zeros(256, np.uint8)
    kinds[list(BLANKS)], kinds[list(BREAKS)] = 1, 2
    return kinds


KINDS = _kinds()


def _ahead(words: int):
    one = b"[^" + _SEPARATORS + b"]+"
    return re.compile(b"(?:[" + re.escape(BLANKS) + b"]+" + one + b"){0,%d}" % words)


def segments(text: bytes, limit: int, words: int) -> Iterator[tuple[bytes, int]]:
    """The text in parts of about ``limit`` bytes, each with how many bytes at its end belong to the next part.

    Cuts lie between pieces; in a longer piece between words, with ``words`` words of the next part added.
    """
    ahead, at = _ahead(words), 0
    while len(text) - at > limit:
        cut = max(text.rfind(bytes([sign]), at, at + limit) for sign in BREAKS)
        if cut > at:
            yield text[at:cut], 0
        else:
            cut = max(text.rfind(bytes([sign]), at + 1, at + limit) for sign in BLANKS)
            if cut < 0:
                found = _SEPARATOR.search(text, at + limit)
                cut = found.start() if found else len(text)
            end = ahead.match(text, cut).end()
            yield text[at:end], end - cut
        at = cut
    yield text[at:], 0


class Bits:
    """Phrases by two bits of their hashes."""

    def __init__(self, size: int):
        self.mask, self.bytes, self.any = np.uint64(size - 1), np.zeros(size // 8, np.uint8), False

    def _at(self, place: np.ndarray) -> np.ndarray:
        place = place & self.mask
        return (self.bytes[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def hold(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), bool)
        for at in range(0, len(hashes) if self.any else 0, STEP):
            some = hashes[at : at + STEP]
            where = np.flatnonzero(self._at(some))
            out[at + where] = self._at(some[where] >> np.uint64(32))
        return out


def encode_block(parts: list[tuple[bytes, int]]) -> tuple[bytes, np.ndarray] | None:
    """The distinct words of a block, blank-joined, and a number for each word of it, in order.

    That is four times the word's place among the distinct, and 2 if phrases may start there, and 1 if it opens a piece.
    """
    whole = np.frombuffer(b"\n".join(p for p, _ in parts) + b"\n", np.uint8).copy()
    whole[(whole >= 65) & (whole <= 90)] += 32
    kind = KINDS[whole]
    word = kind == 0
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return None
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(whole[word])])
    encoded = words.dictionary_encode()
    piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
    begins = np.ones(len(starts), bool)
    at = 0
    for part, tail in parts:
        at += len(part) + 1
        if tail:
            begins[np.searchsorted(starts, at - 1 - tail) : np.searchsorted(starts, at - 1)] = False
    marks = encoded.indices.to_numpy().astype(np.int32) << 2
    marks |= begins.astype(np.int32) << 1
    marks |= np.diff(piece, prepend=-1) > 0
    distinct_words = pa.ListArray.from_arrays(pa.array([0, len(encoded.dictionary)], pa.int32()), encoded.dictionary)
    return pc.binary_join(distinct_words, b" ")[0].as_py(), marks


def hashes_of(vocabulary: bytes) -> np.ndarray:
    """xxhash64 of each word, as Spark's."""
    words = vocabulary.split(b" ")
    return np.fromiter((xxhash.xxh64_intdigest(t, SEED) for t in words), np.uint64, len(words))


class Block:
    """Words of one language, as `encode_block` gives them, with their hashes if those are known."""

    def __init__(self, lang: str, vocabulary: bytes, marks: bytes, hashes: bytes | None = None):
        self.lang, self.vocabulary = lang, vocabulary
        self.own = hashes_of(vocabulary) if hashes is None else np.frombuffer(hashes, "<u8")
        found = np.frombuffer(marks, "<i4")
        self.code, self.begins = found >> 2, found & 2 != 0
        edges = np.append(np.flatnonzero(found & 1), len(found))
        self.room = np.repeat(edges[1:], np.diff(edges)) - np.arange(len(found))  # words up to the piece's end

    @functools.cached_property
    def words(self) -> list[bytes]:
        return self.vocabulary.split(b" ")

    def phrases(self, sought: list[int], chosen: dict[int, list[Bits]]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(length, where they start, hashes, sought, open) of the phrases to be counted, for each length.

        Of a length sought that is all words, and longer phrases whose beginning and end have both reached the threshold, one
        of them lately; of every length the open phrases.
        """
        longest = max([*sought, *(n for n, bits in chosen.items() if bits[OPEN].any)], default=0)
        own = self.own
        first = np.array([xxhash.xxh64_intdigest(self.lang.encode(), SEED)], np.uint64)
        chain = before = None
        for length in range(1, longest + 1):
            count = len(self.code) - length + 1
            if count <= 0:
                return
            if length == 1:
                chain = hashed(own, hashed(first, np.array([SEED], np.uint64)))[self.code]
            else:
                before, chain = chain, hashed(own[self.code[length - 1 :]], chain[:count])
            opened = chosen[length][OPEN].hold(chain) if length in chosen else np.zeros(count, bool)
            if length == 1 and length in sought:
                wanted = np.ones(count, bool)
            elif length in sought:
                held, new = chosen[length - 1][REACHED], chosen[length - 1][RECENT].hold(before)
                if held is chosen[length - 1][RECENT]:
                    wanted = new[:-1] & new[1:]
                else:
                    wanted = new[:-1] | new[1:]
                    at = np.flatnonzero(wanted)
                    wanted[at] = held.hold(before[at]) & held.hold(before[at + 1])
            else:
                wanted = np.zeros(count, bool)
            where = np.flatnonzero((wanted | opened) & self.begins[:count] & (self.room[:count] >= length))
            if len(where):
                yield length, where, chain[where], wanted[where], opened[where]

    def counts(self, length: int, where: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The distinct phrases of that length that start there, and how often each does."""
        columns, counts = distinct([self.code[where + j] for j in range(length)], len(self.words))
        vocabulary = pa.array(self.words, pa.binary()).cast(pa.string())
        columns = [vocabulary.take(pa.array(c)) for c in columns]
        return columns[0] if length == 1 else pc.binary_join_element_wise(*columns, " "), counts


def runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a new value begins in an ordered array that isn't empty, and how often each occurs."""
    edges = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    return edges, np.diff(np.append(edges, len(ordered)))


def distinct(columns: list[np.ndarray], size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of columns of numbers below ``size``, and how often each occurs."""
    used = np.zeros(size, bool)
    for column in columns:
        used[column] = True
    numbers, new = np.flatnonzero(used), np.cumsum(used) - 1
    size, columns = len(numbers), [new[c] for c in columns]
    if size ** len(columns) < 1 << 62:
        key = columns[0]
        for column in columns[1:]:
            key = key * size + column
        key = np.sort(key)
        edges, counts = runs(key)
        key, out = key[edges], []
        for _ in columns:
            key, rest = np.divmod(key, size)
            out.append(numbers[rest])
        return out[::-1], counts
    order = np.lexsort(columns)
    columns = [c[order] for c in columns]
    edges = np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0)))
    return [numbers[c[edges]] for c in columns], np.diff(np.append(edges, len(order)))


def _encoding(longest: int, shards: int, block: int):
    """A task's texts as blocks, for each language and shard."""

    def encoded(key: tuple[str, int], parts: list[tuple[bytes, int]]) -> Iterator[pa.RecordBatch]:
        found = encode_block(parts)
        if found:
            packed = [found[0], found[1].astype("<i4").tobytes(), hashes_of(found[0]).astype("<u8").tobytes()]
            columns = [pa.array([key[0]]), *(pa.array([x], pa.binary()) for x in packed), pa.array([len(found[1])], pa.int32()), pa.array([key[1]], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "words", "marks", "hashes", "size", "shard"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list] = {}
        sizes: dict[tuple[str, int], int] = {}
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for row, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                for part in segments(texts[row].as_py(), block, longest - 1):
                    held.setdefault(key, []).append(part)
                    sizes[key] = sizes.get(key, 0) + len(part[0])
                    if sizes[key] >= block or sum(sizes.values()) >= 2 * block:
                        largest = max(sizes, key=sizes.get)
                        del sizes[largest]
                        yield from encoded(largest, held.pop(largest))
        while held:
            yield from encoded(*held.popitem())
        pa.default_memory_pool().release_unused()  # a worker outlives its stage

    return work


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for row in range(len(batch)):
            yield Block(*(column[row].as_py() for column in batch.columns))
    pa.default_memory_pool().release_unused()  # a worker outlives its stage


def _tallying(sought: list[int], chosen):
    """How often the hashes of phrases that are looked for occur in a task's blocks of one shard, in order of the hashes."""

    def tallied(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        hashes = np.concatenate(held)
        held.clear()
        hashes.sort()
        edges, counts = runs(hashes)
        yield pa.RecordBatch.from_arrays([pa.array(hashes[edges].view(np.int64)), pa.array(counts)], names=["hash", "now"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for block in _blocks(batches):
            for _, _, hashes, wanted, opened in block.phrases(sought, chosen.value):
                held.append(hashes[wanted & ~opened])
                size += len(held[-1])
            if size >= TALLY:
                yield from tallied(held)
                size = 0
        if size:
            yield from tallied(held)

    return work


def _dealing(tallies, groups: int):
    """What ``tallies`` gives, many hashes and their counts to a row, dealt by their first bits."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tallies(batches):
            hashes, counts = (column.to_numpy() for column in batch.columns)
            groups_of = ((hashes.view(np.uint64) >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)
            starts, _ = runs(groups_of)
            edges = np.append(starts, len(hashes)).astype(np.int32)
            packed = [
                pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(edges * wide), pa.py_buffer(values)])
                for values, wide in ((hashes.astype("<i8"), np.int32(8)), (counts.astype("<u4"), np.int32(4)))
            ]
            yield pa.RecordBatch.from_arrays([pa.array(groups_of[starts].astype(np.int32)), *packed], names=["dealt", "hashes", "counts"])

    return work


def _summing(share: int):
    """Of rows as `_dealing` gives them, the hashes that occur ``share`` times in all of them."""

    def work(rows: pa.Table) -> pa.Table:
        hashes, counts = (np.frombuffer(b"".join(rows.column(name).to_pylist()), kind) for name, kind in (("hashes", "<i8"), ("counts", "<u4")))
        order = np.argsort(hashes)
        hashes = hashes[order]
        edges, _ = runs(hashes)
        often = np.add.reduceat(counts[order], edges, dtype=np.int64) >= share
        return pa.table({"hash": pa.array(hashes[edges[often]])})

    return work


def _counting(sought: list[int], chosen):
    """A task's counts of one shard: what is looked for, of the lengths ``many`` only phrases whose hash occurs often, and open phrases."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps, often, many = chosen.value
        for block in _blocks(batches):
            if 1 in sought:
                yield batch_of(block.lang, 0, pa.array([""]), np.array([block.begins.sum()]), True)
            for length, where, hashes, wanted, opened in block.phrases(sought, bitmaps):
                opened |= wanted & often.hold(hashes) if length in many else wanted
                for new in (True, False):  # a phrase is either everywhere
                    some = where[opened & (wanted == new)]
                    if len(some):
                        phrases, counts = block.counts(length, some)
                        for at in range(0, len(phrases), ROWS):
                            yield batch_of(block.lang, length, phrases[at : at + ROWS], counts[at : at + ROWS], new)

    def batch_of(lang: str, length: int, phrases: pa.Array, counts: np.ndarray, new: bool) -> pa.RecordBatch:
        rows = len(phrases)
        columns = [pa.array([lang]).take(pa.array(np.zeros(rows, np.int8))), pa.array(np.full(rows, length, np.int32)), phrases, pa.array(counts), pa.array(np.full(rows, new))]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "n", "phrase", "now", "new"])

    return work


def _setting(sizes: dict[tuple[int, int], int]):
    """A task's bitmaps of the hashes of phrases (n, kinds, hash), in rows of `CHUNK_BITS`."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            lengths, kinds, hashes = (column.to_numpy() for column in batch.columns)
            for (n, kind), size in sizes.items():
                some = hashes[(lengths == n) & (kinds >> kind & 1 == 1)].view(np.uint64)
                if len(some):
                    bits = held.setdefault((n, kind), np.zeros(size // 8, np.uint8))
                    for half in (some, some >> np.uint64(32)):
                        place = half & np.uint64(size - 1)
                        np.bitwise_or.at(bits, place >> np.uint64(3), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))
        while held:
            (n, kind), bits = held.popitem()
            chunks = bits.reshape(-1, 1 << (CHUNK_BITS - 3))
            rows = np.flatnonzero(chunks.any(axis=1)).astype(np.int32)
            for at in range(0, len(rows), 1024):
                some = rows[at : at + 1024]
                columns = [pa.array(np.full(len(some), n, np.int32)), pa.array(np.full(len(some), kind, np.int32)), pa.array(some), pa.array([chunks[r].tobytes() for r in some], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["n", "kind", "row", "bits"])

    return work


def _filled(phrases: DataFrame, counted: dict[tuple[int, int], int]) -> dict[tuple[int, int], Bits]:
    """Bitmaps of the hashes of phrases (n, kinds, hash); ``kinds`` has bit k set if the phrase is of kind k, ``counted`` says how many each is to hold."""
    if not counted:
        return {}
    bits = {key: min(MAX_BITS, 1 << max(CHUNK_BITS, (BITS * count - 1).bit_length())) for key, count in counted.items()}
    rows = phrases.select("n", "kinds", "hash").mapInArrow(_setting(bits), "n int, kind int, row int, bits binary")
    rows = rows.groupBy("n", "kind", "row").agg(F.bitmap_or_agg("bits").alias("bits"))
    out = {key: Bits(size) for key, size in bits.items()}
    for n, kind, row, chunk in rows.collect():  # at most MAX_BITS for each
        some, at = np.frombuffer(chunk, np.uint8), row << (CHUNK_BITS - 3)
        out[n, kind].bytes[at : at + len(some)] |= some
        out[n, kind].any = True
    return out


def _bitmaps(state: DataFrame, shard: str, since: int) -> tuple[dict[int, list[Bits]], list[int]]:
    """For each length the bitmaps of phrases, by kind; and the lengths of which some phrase reached the threshold since ``since``.

    Those that reached it are left out where none did so since, as no longer phrase is looked for then; where all did so
    since, one bitmap is both kinds.
    """
    holds = [F.col("reached").isNotNull(), F.coalesce(F.col("reached") >= since, F.lit(False)), F.col(shard).isNull()]
    kinds = sum(F.when(of, 1 << kind).otherwise(0) for kind, of in enumerate(holds))
    phrases = state.where("n > 0").select("n", kinds.cast("int").alias("kinds"), "hash", holds[OPEN].alias("open"))
    rows = state.where("n > 0").groupBy("n").agg(*[F.count_if(of).alias(f"of_{kind}") for kind, of in enumerate(holds)]).collect()  # one a length
    counted = {(r["n"], kind): r[f"of_{kind}"] for r in rows for kind in range(3) if r[f"of_{kind}"]}
    lengths = sorted(n for n, kind in counted if kind == RECENT)
    wanted = {(n, kind): count for (n, kind), count in counted.items() if kind == OPEN or n in lengths}
    alike = [n for n in lengths if wanted[n, RECENT] == wanted[n, REACHED]]
    for n in alike:
        del wanted[n, RECENT]
    found = _filled(phrases.where(F.col("open") | F.col("n").isin(lengths) if lengths else F.col("open")), wanted)
    out = {n: [found.get((n, kind), Bits(8)) for kind in range(3)] for n in {n for n, _ in wanted}}
    for n in alike:
        out[n][RECENT] = out[n][REACHED]
    return out, lengths


def count_phrases(docs: DataFrame, threshold: int, longest: int = 4, shards: int = SHARDS, block: int = BLOCK) -> DataFrame:
    """(lang, n, phrase, total, reached): every phrase that occurs ``threshold`` times, and the scan by which it had come up to that.

    Where ``reached`` is null, phrases below the threshold that were kept, with their counts; n = 0 is the number of all words.
    """
    spark = docs.sparkSession
    corpus, counts = scratch_path(spark, "shards"), scratch_path(spark, "counts")
    texts = docs.select(
        F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"),
        (F.monotonically_increasing_id() % shards).cast("int").alias("shard"),
    )
    blocks = "lang string, words binary, marks binary, hashes binary, size int, shard int"
    texts.mapInArrow(_encoding(longest, shards, block), blocks).write.partitionBy("shard").parquet(corpus)
    words = dict(spark.read.schema(blocks).parquet(corpus).groupBy("shard").agg(F.sum("size")).collect())  # a row for each shard

    per_shard, keys = [f"in_{i}" for i in range(shards)], ["lang", "n", "phrase"]
    layout = f"lang string, n int, phrase string, hash long, {', '.join(f'{c} long' for c in per_shard)}, reached int, scan int, done boolean"
    total = sum(F.coalesce(c, F.lit(0)) for c in per_shard)
    done = F.expr(" AND ".join(f"{c} IS NOT NULL" for c in per_shard))
    state, live = (spark.createDataFrame([], layout) for _ in range(2))  # all phrases; those not known in every shard
    scan, before, share = 0, None, -(-threshold // shards)
    while True:
        shard = per_shard[scan % shards]
        chosen, recent = _bitmaps(state, shard, scan - shards)
        sought = ([1] if scan < shards else []) + [n + 1 for n in recent if n < longest]
        if sought or any(bits[OPEN].any for bits in chosen.values()):
            rows = spark.read.schema(blocks).parquet(corpus).where(F.col("shard") == scan % shards).select("lang", "words", "marks", "hashes")
            often = Bits(8)
            many = [n for n in sought if n == 1 or FEW * chosen[n - 1][RECENT].mask > chosen[n - 1][REACHED].mask]
            if many:
                shared = spark.sparkContext.broadcast(chosen)
                groups = max(1, -(-words.get(scan % shards, 0) * len(many) // GROUP))
                dealt = rows.mapInArrow(_dealing(_tallying(many, shared), groups), "dealt int, hashes binary, counts binary")
                sums = dealt.groupBy("dealt").applyInArrow(_summing(share), "hash long")
                hashes, path = written(sums.select(F.lit(0).alias("n"), F.lit(1).alias("kinds"), "hash"), "often")
                shared.destroy()  # the driver's copy goes too: there is one at a time
                size = hashes.count()
                often = _filled(hashes, {(0, 0): size} if size else {}).get((0, 0), often)
                removed(spark, path)
            shared = spark.sparkContext.broadcast((chosen, often, many))
            summed = rows.mapInArrow(_counting(sought, shared), "lang string, n int, phrase string, now long, new boolean").groupBy(*keys).agg(F.sum("now").alias("now"), F.max("new").alias("new"))
            kept = F.col("_live") | (F.col("new") & ((F.col("n") == 0) | (F.col("now") >= share)))
            both = live.withColumn("_live", F.lit(True)).join(summed, keys, "full").where(kept)
            both = both.withColumn(shard, F.coalesce(shard, "now", F.lit(0))).withColumn("hash", F.coalesce("hash", _phrase_hash()))
            both = both.withColumn("reached", F.coalesce("reached", F.when(total >= threshold, scan)))
            both = both.select(*keys, "hash", *per_shard, "reached", F.lit(scan).alias("scan"), done.alias("done"))
            both.write.partitionBy("scan", "done").mode("append").parquet(counts)
            if before is not None:
                removed(spark, f"{counts}/scan={before}/done=false")
            shared.destroy()
            shared = summed = both = None
            before = scan
            state = spark.read.schema(layout).parquet(counts)
            live = state.where((F.col("scan") == scan) & ~F.col("done"))
        elif scan >= shards and not live.where("n > 0").limit(1).count():
            break
        scan += 1
    removed(spark, corpus)
    # A bitmap may have let a phrase be counted again after it was put aside: the same counts then come twice.
    once = state.groupBy(*keys).agg(*[F.max(c).alias(c) for c in per_shard], F.min("reached").alias("reached"))
    return once.select(*keys, total.alias("total"), F.when(F.col("n") > 0, F.col("reached")).alias("reached"))


def _joined(start, size):
    return F.array_join(F.slice("_words", start, size), " ")


def collocations(
    docs: DataFrame, threshold: int = 30, longest: int = 4, top: int = 2000, scale: int = 2_000_000, cover: int = 80, shards: int = SHARDS, block: int = BLOCK
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language by how firmly their parts hold together.

    A phrase of a occurrences cut into parts of l and r scores floor(scale * a / (l + r)), its weakest cut
    counting. Those are left out that a longer phrase accounts for to ``cover`` hundredths.
    """
    counted = count_phrases(docs, threshold, longest, shards, block)
    sizes = counted.where("n = 0").select("lang", F.col("total").alias("n"))
    frequent = cut_lineage(counted.where("reached IS NOT NULL").select("lang", F.col("n").alias("size"), "phrase", "total"))
    phrases = frequent.where("size > 1").withColumn("_words", F.split("phrase", " ")).withColumnRenamed("total", "a")
    parts = phrases.select("lang", "phrase", "size", "a", "_words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    parts = parts.select("lang", "phrase", "a", "k", _joined(F.lit(1), F.col("k")).alias("left"), _joined(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        parts = parts.join(frequent.select("lang", F.col("phrase").alias(side), F.col("total").alias(name)), ["lang", side])
    score = F.expr(f"CAST(CAST({scale} AS DECIMAL(10, 0)) * CAST(a AS DECIMAL(19, 0)) div CAST(l + r AS DECIMAL(19, 0)) AS BIGINT)")
    weakest = parts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("_cut"))

    longer = phrases.where("size > 2").select("lang", "a", "size", "_words", F.explode(F.expr("sequence(2, size - 1)")).alias("_size"))
    inside = longer.select("lang", "a", "_words", "_size", F.explode(F.expr("sequence(1, size - _size + 1)")).alias("_from"))
    covers = inside.select("lang", _joined(F.col("_from"), F.col("_size")).alias("phrase"), F.col("a").alias("most"))
    covers = covers.groupBy("lang", "phrase").agg(F.max("most").alias("most"))
    covered = F.expr(f"CAST(100 AS DECIMAL(3, 0)) * CAST(most AS DECIMAL(19, 0)) >= CAST({cover} AS DECIMAL(3, 0)) * CAST(a AS DECIMAL(19, 0))")
    left = weakest.join(covers, ["lang", "phrase"], "left").where(F.coalesce(~covered, F.lit(True)))
    first = Window.partitionBy("lang").orderBy(F.desc("_cut.score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(first).cast("long")).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "_cut.l", "_cut.r", "n", "_cut.score")
