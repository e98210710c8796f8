"""N-gram Jaccard join by T-occurrence search.

A document's set holds the hashes of its shingles. Two sets of Jaccard similarity 0.8 share at least
T = ceil(4/9 (n1 + n2)) shingles. Exactly equal sets are one class from the start; then

1. Each class lists the least 3/10 of its hashes. If two sets link, more than a tenth of either's size must
   be shared within these lists (below the smaller of the two lists' ends at most 7/10 of a set is
   unseen), so a class with fewer listed shingles that others list too links with nothing and leaves.
2. The same again: as a link needs more than n/10 of a class's shared shingles, one of them is among the
   rarest s - n/10 of the s it has, on both sides. These join what is left to islands, and every link lies
   within an island; passages that many documents hold are not among the rarest and tie nothing. A shingle
   ties its classes to the least one, so a list of any length costs one row a class.
3. Whole sets of an island meet in one task, or, beyond ``TASK`` shingles, block by block. There each set
   searches the island's inverted lists: the short ones are merged with a heap that skips what can't
   reach the count, the long ones are probed by bisection (DivideSkip), and sets reaching T are links.
   A task reports what ties its sets together, never all pairs, and leaves out searches whose links could
   only lie within one component.

So every link is found or lies within a component that is already known, whatever the size of a group.

Defined results: a null or empty text, or one without words, has an empty set, links with nothing and is its
own component; fewer words than a shingle make one shingle; repeated rows and ids are separate rows with
equal sets; a component without any id has a null id; an empty table gives an empty result. Hashes have
64 bits.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelmark.llm import graph, pretokens
from reelmark.llm.frames import removed, written
from reelmark.session import cut_lineage

WORDS = 5
LISTED = 3  # tenths of a set
TASK = 1 << 20  # shingles
BLOCK_BYTES = 1 << 20
BITMAP = 1 << 23
SEEN = 1 << 20
HEAP = 512  # entries of short lists that a heap merges
MU = 0.0085  # DivideSkip's published constant for choosing how many long lists to probe


# ---- sets --------------------------------------------------------------------------------


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.array([b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256)])


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """xxhash64 of each word; worked out once a distinct word."""
    if not len(starts):
        return np.empty(0, np.uint64)
    which, words = pretokens.distinct(data, starts, ends)
    return np.fromiter(map(xxhash.xxh64_intdigest, words.to_pylist()), np.uint64, len(words))[which]


def _chained(so_far: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of the words so far and one more; not a polynomial, so no pattern of words cancels out."""
    return pretokens.mixed(so_far * np.uint64(0x9E3779B97F4A7C15) ^ word)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; text k is data[offsets[k]:offsets[k + 1]]."""
    base = offsets[0]
    data, offsets = data[base : offsets[-1]], offsets - base
    if not len(data):
        return [np.empty(0, np.uint64)] * (len(offsets) - 1)
    inside = IS_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    words = _word_hashes(LOWER[data], starts, ends)
    first = np.searchsorted(starts, offsets)
    grams = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        grams = _chained(grams, words[k : len(words) - WORDS + 1 + k])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= WORDS:
            out.append(np.unique(grams[a : b - WORDS + 1]))
        elif b > a:
            value = np.array([b - a], np.uint64)
            for w in words[a:b]:
                value = _chained(value, w)
            out.append(value)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row of the batch, set), text by text in bounded blocks."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + BLOCK_BYTES, side="right")) - 1)
        b = min(b, len(column))
        with np.errstate(over="ignore"):
            yield from enumerate(shingle_sets(data, offsets[a : b + 1]), a)
        a = b


def _print(shingles: np.ndarray) -> int:
    """A fingerprint of a whole set."""
    n = np.uint64(len(shingles))
    return int(pretokens.mixed(np.array([pretokens.mixed(shingles ^ n).sum(dtype=np.uint64) + n], np.uint64))[0].view(np.int64))


# ---- T-occurrence search -----------------------------------------------------------------


def merge_skip(lists: list[list[int]], need: int) -> Iterator[tuple[int, int]]:
    """(member, count) of those in at least ``need`` of the sorted lists, by a heap that skips."""
    heap = [(entries[0], k, 0) for k, entries in enumerate(lists)]
    heapq.heapify(heap)
    while len(heap) >= need:
        top = heap[0][0]
        popped = []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap))
        if len(popped) >= need:
            yield top, len(popped)
            target = top + 1
        else:
            while heap and len(popped) < need - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                return
            target = max(heap[0][0], top + 1)
        for _, k, at in popped:
            entries = lists[k]
            at = at + 1 if at + 1 < len(entries) and entries[at + 1] >= target else bisect_left(entries, target, at)
            if at < len(entries):
                heapq.heappush(heap, (entries[at], k, at))


def divide_skip(lists: list[np.ndarray], need: int) -> tuple[np.ndarray, np.ndarray]:
    """As `merge_skip`; the longest lists are probed instead of merged, for all members found so far at once.

    Where the short lists are long too, sorting their entries merges them: a heap step costs far more there.
    """
    lists = sorted(lists, key=len, reverse=True)
    probed = min(need - 1, int(need / (MU * math.log2(max(2, len(lists[0]))) + 1)))
    long, short, least = lists[:probed], lists[probed:], need - probed
    if sum(map(len, short)) <= HEAP:
        found = list(merge_skip([x.tolist() for x in short], least))
        member = np.array([m for m, _ in found], np.int64)
        count = np.array([c for _, c in found], np.int64)
    else:
        member, count = np.unique(np.concatenate(short), return_counts=True)
        member, count = member[count >= least], count[count >= least]
    for k, entries in enumerate(long):
        able = count + (len(long) - k) >= need
        if not able.all():
            member, count = member[able], count[able]
        if not len(member):
            break
        at = np.searchsorted(entries, member)
        count = count + (entries[np.minimum(at, len(entries) - 1)] == member)
    return member[count >= need], count[count >= need]


def links_of(n1, n2, shared):
    """100 * intersection >= 80 * union."""
    return 9 * shared >= 4 * (n1 + n2)


def ties(sets: list[np.ndarray], block: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that tie sets together to what all links would; with ``block``, only between blocks."""
    if len(sets) < 2:
        return []
    order = sorted(range(len(sets)), key=lambda k: len(sets[k]))
    parent = list(range(len(sets)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    token = np.concatenate([sets[k] for k in order])
    member = np.repeat(np.array(order), [len(sets[k]) for k in order])
    by = np.lexsort((member, token))
    token, member = token[by], member[by]
    change = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    size = np.diff(np.append(change, len(token)))
    lists = {
        int(t): (int(s), int(n)) for t, s, n in zip(token[change[size > 1]].tolist(), change[size > 1].tolist(), size[size > 1].tolist())
    }
    sizes = np.array([len(x) for x in sets])

    out = []
    open_ = Counter(range(len(sets)))  # sets not searched for yet, by component
    queue, wait = order, False
    while len(open_) > 1:
        later = []
        largest = max(open_, key=open_.__getitem__)
        for place, q in enumerate(queue):
            own = root(q)
            if wait and own == root(largest):  # the others' searches may leave this component alone
                later.append(q)
                continue
            open_[own] -= 1
            if not open_[own]:
                del open_[own]
            n = len(sets[q])
            need = -(-4 * n // 5)
            near = [member[s : s + e] for s, e in map(lists.get, filter(lists.__contains__, sets[q].tolist()))]
            if len(near) >= need:
                found, shared = divide_skip(near, need)
                for k in found[links_of(n, sizes[found], shared)].tolist():
                    if k != q and (block is None or block[k] != block[q]):
                        a, b = root(k), root(q)
                        if a != b:
                            out.append((k, q))
                            parent[a] = b
                            if open_.get(a):
                                open_[b] += open_.pop(a)
            if len(open_) <= 1:
                break
            if not wait:
                later = queue[place + 1 :]
                break
        wait = len(later) < len(queue)
        queue = later
    return out


# ---- the join ----------------------------------------------------------------------------


def _documents(docs: DataFrame, id_column: str, text: str, key: str | None) -> DataFrame:
    """row, id, key, n, print, and the listed hashes, which copies in a task leave out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            sizes, prints, listed = [], [], []
            for _, found in _sets(batch.column(3)):
                sizes.append(len(found))
                prints.append(_print(found) if len(found) else None)
                listed.append(found[: 0 if prints[-1] in seen else LISTED * len(found) // 10 + 1].view(np.int64))
                seen.add(prints[-1])
            if len(seen) > SEEN:
                seen.clear()
            ends = np.cumsum([0, *map(len, listed)]).astype(np.int32)
            flat = pa.array(np.concatenate(listed) if listed else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), batch.column(2), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), flat),
                ],
                names=["row", "id", "key", "n", "print", "listed"],
            )

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("id"),
        (F.col(key) if key else F.lit(None)).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    return rows.mapInArrow(work, "row long, id long, key long, n long, print long, listed array<long>")


def _whole_sets(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the wanted nodes, read from the texts again.

    A bitmap of fixed size says which prints may be wanted; the join after it decides. A task passes a
    print on once, so copies don't travel.
    """
    bit = F.pmod("node", F.lit(BITMAP)) + 1
    maps = wanted.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    wanted_bits = np.zeros(BITMAP, bool)
    for bucket, bits in maps.collect():  # at most BITMAP / 32768 rows
        at = (bucket - 1) * 32768
        wanted_bits[at : at + 32768] = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(wanted_bits))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may, seen = np.unpackbits(shared.value).view(bool), set()
        for batch in batches:
            nodes, whole = [], []
            for _, found in _sets(batch.column(0)):
                if len(found):
                    node = _print(found)
                    if may[node % BITMAP] and node not in seen:
                        seen.add(node)
                        nodes.append(node)
                        whole.append(found.tobytes())
            if len(seen) > SEEN:
                seen.clear()
            if nodes:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes, pa.int64()), pa.array(whole, pa.binary())], names=["node", "shingles"]
                )

    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    return texts.mapInArrow(work, "node long, shingles binary")


def _search(table: pa.Table) -> pa.Table:
    """Ties of all islands, or of the pair of blocks, in a group."""
    nodes, roots = table["node"].to_numpy(), table["root"].to_numpy()
    own, a, b = (table[c].to_numpy() for c in ("own", "a", "b"))
    raw = table["shingles"]
    order = np.lexsort((nodes, roots))
    order = order[np.append(True, nodes[order][1:] != nodes[order][:-1])]  # tasks may send copies
    out_u, out_v = [], []
    for at in np.split(order, np.flatnonzero(roots[order][1:] != roots[order][:-1]) + 1):
        sets = [np.frombuffer(raw[int(k)].as_py(), np.uint64) for k in at]
        cross = [int(own[k]) for k in at] if a[at[0]] != b[at[0]] else None
        for i, j in ties(sets, cross):
            out_u.append(nodes[at[i]])
            out_v.append(nodes[at[j]])
    return pa.table({"u": pa.array(out_u, pa.int64()), "v": pa.array(out_v, pa.int64())})


def jaccard_components(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", key: str | None = None) -> DataFrame:
    """(id, key, n_shingles, component_id, kept): kept is true of one row of each component.

    ``key`` names a column with a number for each row, by which a caller finds the rows again; without it, it is null.
    """
    spark = docs.sparkSession
    whole, path = written(_documents(docs, id_column, text, key), "listed")
    found = cut_lineage(whole.drop("listed"))
    classes = cut_lineage(
        found.where("n > 0").groupBy(F.col("print").alias("node")).agg(
            F.max("n").alias("n"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("least")
        )
    )
    listed = whole.where(F.size("listed") > 0).select(F.col("print").alias("node"), F.explode("listed").alias("shingle"))
    common = listed.groupBy("shingle").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("shingle")
    shared = listed.join(common, "shingle").groupBy("node").agg(F.array_distinct(F.collect_list("shingle")).alias("own"))
    able, able_path = written(shared.join(classes.select("node", "n"), "node").where(10 * F.size("own") > F.col("n")), "able")
    removed(spark, path)
    left = able.select("node", "n", F.explode("own").alias("shingle"))
    counts = left.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    per_node = Window.partitionBy("node")
    ranked = left.join(counts, "shingle").select(
        "node", "n", "shingle",
        F.row_number().over(per_node.orderBy("df", "shingle")).alias("rank"), F.count(F.lit(1)).over(per_node).alias("held"),
    )
    rare, rare_path = written(ranked.where("rank <= held - n div 10").select("node", "shingle"), "rare")
    removed(spark, able_path)
    hubs = rare.groupBy("shingle").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub < top").drop("top")
    edges = rare.join(hubs, "shingle").select(F.col("node").alias("u"), F.col("hub").alias("v")).where("u <> v")
    islands = cut_lineage(graph.components(edges).join(classes.select("node", "n"), "node"))
    removed(spark, rare_path)

    weights = islands.groupBy("root").agg(F.ceil(F.sum("n") / TASK).cast("int").alias("blocks"))
    total = islands.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    small = max(1, 4 * (total // TASK + 1))
    placed = islands.join(weights, "root").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(small))).otherwise(F.col("root"))
    placed = placed.select("node", "root", "own", task.alias("task"), "blocks", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
    sets = _whole_sets(docs, text, islands.select("node"))
    tied = placed.join(sets, "node").groupBy("blocks", "task", "a", "b").applyInArrow(_search, "u long, v long")
    joined = cut_lineage(graph.components(tied))

    named = classes.join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # Of a component, the row with the least id stays; without any id, the first row.
    best = named.groupBy("root").agg(F.min("least").alias("best"))
    by_class = named.join(best, "root").select("node", F.col("best.id").alias("component_id"), F.col("best.row").alias("best_row"))
    out = found.select("id", "key", "row", "n", "print").join(by_class, F.col("print") == F.col("node"), "left")
    empty = F.col("n") == 0
    return out.select(
        "id", "key", F.col("n").alias("n_shingles"),
        F.when(empty, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        (empty | F.coalesce(F.col("row") == F.col("best_row"), F.lit(False))).alias("kept"),
    )
