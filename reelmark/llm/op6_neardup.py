"""Embedding near-duplicates by NN-descent.

0. Equal vectors (by 128 bits of hash) are one class that stands for its copies, so a vector that a third of
   all rows hold is compared once; its copies link with each other and with whatever the class links with.
1. Start: vectors that share a random-hyperplane signature meet in groups of bounded size, in as many tables
   as let a pair at the threshold miss all of them with chance ``MISS``; each keeps its ``LIST`` nearest.
2. Descent: neighbours of a vector, taken both ways, are compared with each other and improve each
   other's lists, round by round, until at most ``SETTLED`` of the lists change.
3. Links of at least the threshold are joined to components. A list full of links is saturated: there may
   be more. Those inside its component are counted exactly, block by block, and no pair becomes a row. For
   those outside, vectors keep a second list, of the ``LIST`` nearest in other components, and steps 1 to 3 are
   done again with components as they are now, until no list is full of links: each time components join.
4. Audit, as a mean over vectors: the links of ``AUDIT`` vectors that have any, found by brute force against all
   rows (up to ``ASKED`` are asked), and ``AUDIT`` planted vectors, each just within the threshold of a row's.
   While less than ``RECALL`` of either was found, further tables are added; after ``ATTEMPTS`` the run fails.

Groups that exceed a task's share are cut by further hyperplanes, and by hash where these don't part them;
NN-descent does not need every pair of them, and steps 2 and 3 restore what the cut lost. Vectors travel by
join, nothing that grows is broadcast, and every step is a written table.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component link with
nothing and are their own component; vectors link only with those of as many components; repeated rows
and ids are separate rows that link if their vectors do; a null id has its component's least id, null if
there is none; an empty table gives an empty result.
"""

from __future__ import annotations

import logging
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelmark.llm import graph, vectors
from reelmark.session import cut_lineage

LIST, TABLES, MISS, SETTLED = 8, 8, 0.01, 0.01  # TABLES at the least
GROUP, NEAR, BLOCK = 256, 48, 1024  # rows of a signature aimed at; of a neighbourhood; of a component's block
FURTHER = 24  # hyperplanes for signatures that too many rows share
AUDIT, ASKED, RECALL, ATTEMPTS = 200, 12_800, 0.98, 8
HOT, SALTS = 2048, 32  # copies of a class that are looked up by one task; keys that the copies of larger ones have
LOG = logging.getLogger(__name__)


def _best(cos: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j, cosine) of each row's k nearest; those at -2 are none."""
    k = min(k, len(cos) - 1)
    if k < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    j = np.argpartition(-cos, k - 1, axis=1)[:, :k]
    i = np.repeat(np.arange(len(cos)), k)
    j = j.ravel()
    some = cos[i, j] > -2
    return i[some], j[some], cos[i[some], j[some]]


def _segments(table: pa.Table, *keys: str) -> list[np.ndarray]:
    """Row numbers of each run of equal keys."""
    columns = [table[k].to_numpy(zero_copy_only=False) for k in keys]
    order = np.lexsort(columns[::-1])
    change = np.zeros(len(order), bool)
    for c in columns:
        s = c[order]
        change[1:] |= s[1:] != s[:-1]
    return np.split(order, np.flatnonzero(change)) if len(order) else []


def _pairs(table: pa.Table, keys: tuple[str, ...], floors: bool) -> pa.Table:
    """(u, v, cos, away) of each group's nearest, among all and among those of other components (``away``)."""
    unit, rows, roots = vectors.unit(vectors.matrix(table["x"])), table["row"].to_numpy(), table["root"].to_numpy()
    out = []
    for at in _segments(table, *keys):
        cos = unit[at] @ unit[at].T
        np.fill_diagonal(cos, -2.0)
        cos[:, rows[at] < 0] = -2.0  # planted vectors are in no list
        found = [_best(cos, LIST)]
        root = roots[at]
        if len(np.unique(root)) < len(root):
            cos[root[:, None] == root] = -2.0
            found.append(_best(cos, LIST))
        i, j, near = (np.concatenate(c) for c in zip(*found))
        away = root[i] != root[j]
        if floors:
            floor = np.where(away, table["away_floor"].to_numpy()[at][i], table["floor"].to_numpy()[at][i])
            better = near > floor
            i, j, near, away = i[better], j[better], near[better], away[better]
        out.append((rows[at][i], rows[at][j], near, away))
    none = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, bool)]
    columns = [np.concatenate(c) for c in zip(*out)] if out else none
    return pa.table(dict(zip(("u", "v", "cos", "away"), columns)))


def equal_classes(every: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(row, x, dim, copies) of each class's first row; (row, id, a, b), the hashes of each row; (a, b, node, copies, least id).

    Vectors that link with nothing have no second hash, and so no class.
    """
    nonzero = F.col("ok") & F.exists("x", lambda x: x != 0)
    sound = F.coalesce(nonzero, F.lit(False))
    first, second = F.xxhash64(F.lit(1), "x"), F.xxhash64(F.lit(2), "x")
    named = cut_lineage(
        every.select("row", "id", F.when(sound, first).otherwise(F.col("row")).alias("a"), F.when(sound, second).alias("b"))
    )
    classes = cut_lineage(
        named.where(F.col("b").isNotNull()).groupBy("a", "b").agg(
            F.min("row").alias("node"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("least")
        )
    )
    firsts = classes.select(F.col("node").alias("row"), "copies")
    return cut_lineage(every.join(firsts, "row").select("row", "x", F.size("x").alias("dim"), "copies")), named, classes


def by_class(named: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, component_id, n_links) of every row; (a, b, copies, component_id, n_links) are the classes."""
    found = F.struct("component_id", "n_links")
    hot = classes.where(F.col("copies") > HOT).select(
        "a", "b", found.alias("hot"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    )
    few = classes.where(F.col("copies") <= HOT).select("a", "b", found.alias("few"))
    salted = named.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(hot, ["a", "b", "salt"], "left")
    # Rows that have their class already keep out of the way of the second look-up.
    spread = salted.withColumn("a", F.when(F.col("hot").isNull(), F.col("a")).otherwise(F.col("row")))
    own = F.struct(F.col("id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return spread.join(few, ["a", "b"], "left").select("id", F.coalesce("hot", "few", own).alias("found")).select("id", "found.*")


def _lists(pairs: DataFrame) -> DataFrame:
    """The LIST nearest of each vector (``nth`` up to LIST), and the LIST nearest in other components (``away``)."""
    order = Window.partitionBy("u").orderBy(F.desc("cos"), "v")
    apart = Window.partitionBy("u", "away").orderBy(F.desc("cos"), "v")
    once = pairs.groupBy("u", "v").agg(F.max("cos").alias("cos"), F.max("away").alias("away"))
    ranked = once.withColumns({"nth": F.row_number().over(order), "_n": F.row_number().over(apart)})
    return cut_lineage(ranked.where((F.col("nth") <= LIST) | (F.col("away") & (F.col("_n") <= LIST))).drop("_n"))


def _grouped(rows: DataFrame, group: list[str], most: int) -> DataFrame:
    """Adds ``sub``, so that (group, sub) holds about ``most`` rows at the most."""
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_size"))
    return rows.join(sizes, group).withColumn("sub", F.pmod(F.xxhash64("row", *group), F.ceil(F.col("_size") / most)).cast("int")).drop("_size")


def table_count(count: int, threshold: float) -> tuple[int, int]:
    """(bits of a signature, tables): a pair at the threshold misses all tables with chance MISS at the most."""
    bits = max(2, (max(1, count // GROUP)).bit_length())
    meet = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    return bits, TABLES if meet >= 1 else max(TABLES, math.ceil(math.log(MISS) / math.log1p(-max(meet, 1e-3))))


def start(placed: DataFrame, count: int, threshold: float, seed: int) -> DataFrame:
    """(u, v, cos, away) of vectors with the same signature."""
    bits, tables = table_count(count, threshold)
    wide = bits + FURTHER

    def sign(batches):
        for batch in batches:
            x = vectors.matrix(batch.column(1))
            draw = np.random.default_rng([seed, x.shape[1]])
            signatures = []
            for _ in range(tables):
                above = x @ draw.standard_normal((x.shape[1], wide)) > 0
                signatures.append(above @ (1 << np.arange(wide, dtype=np.int64)))
            signature = np.stack(signatures, axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(batch.column(0).to_numpy(), tables)),
                    pa.array(np.tile(np.arange(tables, dtype=np.int32), len(x))),
                    pa.array((signature & ((1 << bits) - 1)).ravel()),
                    pa.array((signature >> bits).ravel()),
                ],
                names=["row", "tab", "sig", "further"],
            )

    dims = [r[0] for r in placed.select("dim").distinct().collect()]  # kinds of vectors, a few
    signed = None
    for dim in dims:
        own = placed.where(F.col("dim") == dim).select("row", "x").mapInArrow(sign, "row long, tab int, sig long, further long")
        own = own.withColumn("dim", F.lit(dim))
        signed = own if signed is None else signed.unionByName(own)
    signed = cut_lineage(signed)
    group = ["dim", "tab", "sig"]
    sizes = signed.groupBy(*group).agg(F.count(F.lit(1)).alias("_size"))
    cuts = F.least(F.lit(FURTHER), F.greatest(F.lit(0), F.ceil(F.log2(F.col("_size") / (4 * GROUP))))).cast("int")
    parted = signed.join(sizes, group).withColumn("part", F.pmod("further", F.pow(F.lit(2.0), cuts).cast("long")))
    group = [*group, "part"]
    met = _grouped(parted.drop("_size", "further"), group, 4 * GROUP).join(placed.select("row", "x", "root"), "row")
    return met.groupBy(*group, "sub").applyInArrow(
        lambda t: _pairs(t, ("tab",), False), "u long, v long, cos double, away boolean"
    )


def descend(placed: DataFrame, lists: DataFrame) -> DataFrame:
    """One round: better pairs among the neighbours of each vector."""
    both = lists.select("u", F.col("v").alias("row")).unionByName(lists.select(F.col("v").alias("u"), F.col("u").alias("row")))
    both = both.unionByName(lists.select("u", F.col("u").alias("row"))).distinct()

    def least(listed):
        return F.when(F.count_if(listed) >= LIST, F.min(F.when(listed, F.col("cos")))).otherwise(F.lit(-2.0))

    # The nearest elsewhere are the LIST best that are away; some of them may be among the LIST best of all.
    floors = lists.groupBy(F.col("u").alias("row")).agg(
        least(F.col("nth") <= LIST).alias("floor"), least(F.col("away")).alias("away_floor")
    )
    known = placed.select("row", "dim", "x", "root").join(floors, "row", "left").withColumns(
        {c: F.coalesce(c, F.lit(-2.0)) for c in ("floor", "away_floor")}
    )
    near = _grouped(both, ["u"], NEAR)
    tasks = max(1, int(near.sparkSession.conf.get("spark.sql.shuffle.partitions"))) * 8
    hub = F.pmod(F.xxhash64("u", "sub"), F.lit(tasks))
    return near.join(known, "row").groupBy("dim", hub.alias("task")).applyInArrow(
        lambda t: _pairs(t, ("u", "sub"), True), "u long, v long, cos double, away boolean"
    )


def settle(placed: DataFrame, lists: DataFrame, count: int) -> DataFrame:
    """Rounds of descent until few lists change."""
    while True:
        now = _lists(lists.drop("nth").unionByName(descend(placed, lists)))
        changed = now.join(lists, ["u", "v"], "left_anti").select("u").distinct().count()
        lists = now
        if changed <= SETTLED * count:
            return lists


def place(probed: DataFrame, members: DataFrame | None) -> DataFrame:
    """Adds ``root``: a vector's component so far, at first itself."""
    if members is None:
        return cut_lineage(probed.withColumn("root", F.col("row")))
    return cut_lineage(probed.join(members, "row", "left").withColumn("root", F.coalesce("root", "row")))


def replaced(lists: DataFrame, placed: DataFrame) -> DataFrame:
    """(u, v, cos, away) under new components."""
    of = placed.select("row", "root")
    u, v = (of.select(F.col("row").alias(c), F.col("root").alias(f"_{c}")) for c in "uv")
    return lists.select("u", "v", "cos").join(u, "u").join(v, "v").select("u", "v", "cos", (F.col("_u") != F.col("_v")).alias("away"))


def saturated(lists: DataFrame, threshold: float) -> bool:
    """Whether some list of vectors in other components is full of links, so that there may be more."""
    links = lists.where(F.col("away") & (F.col("cos") >= threshold) & (F.col("u") >= 0))
    return not links.groupBy("u").count().where(F.col("count") >= LIST).isEmpty()


def exact_links(valid: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """(row, n_links) of the classes in components (row, root): every pair of a component once, in blocks."""
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("_size"))
    cut = members.join(sizes, "root").withColumn("blocks", F.ceil(F.col("_size") / BLOCK).cast("int"))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    cut = cut.withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other")})
    tasks = max(1, int(valid.sparkSession.conf.get("spark.sql.shuffle.partitions"))) * 8
    # Components of one block share groups; larger ones have a group for each pair of blocks.
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(tasks))).otherwise(F.xxhash64("root", "a", "b"))

    def count(table: pa.Table) -> pa.Table:
        unit, rows = vectors.unit(vectors.matrix(table["x"])), table["row"].to_numpy()
        own, a, b, copies = (table[c].to_numpy() for c in ("own", "a", "b", "copies"))
        found_rows, found = [], []
        for at in _segments(table, "root", "a", "b"):
            if a[at[0]] == b[at[0]]:
                hit = unit[at] @ unit[at].T >= threshold
                np.fill_diagonal(hit, True)  # copies link, whatever rounding makes of 1
                found_rows.append(rows[at])
                found.append(hit @ copies[at] - 1)
            else:
                left, right = at[own[at] == a[at[0]]], at[own[at] == b[at[0]]]
                hit = unit[left] @ unit[right].T >= threshold
                found_rows += [rows[left], rows[right]]
                found += [hit @ copies[right], copies[left] @ hit]
        return pa.table({"row": np.concatenate(found_rows), "n": np.concatenate(found).astype(np.int64)})

    joined = cut.withColumn("task", task).join(valid, "row")
    return joined.groupBy("dim", "task").applyInArrow(count, "row long, n long").groupBy("row").agg(F.sum("n").alias("n_links"))


def _asked(valid: DataFrame, count: int, most: int, seed: int) -> pa.Table:
    """About ``most`` vectors, by hash."""
    share = F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(1 << 30)) < int(min(1.0, most / count) * (1 << 30))
    return valid.where(share).select("row", "dim", "x").orderBy("row").toArrow()


def planted(valid: DataFrame, count: int, threshold: float, seed: int) -> DataFrame | None:
    """Vectors just within the threshold of some rows', as rows below 0 that stand for no copies."""
    asked = _asked(valid, count, AUDIT, seed + 1)
    cos, draw, rows = min(1.0, threshold + 1e-4), np.random.default_rng(seed), []
    for at in _segments(asked, "dim"):
        x = vectors.unit(vectors.matrix(asked["x"].take(pa.array(at))))
        if x.shape[1] < 2:
            continue
        other = draw.standard_normal(x.shape)
        other = vectors.unit(other - (other * x).sum(axis=1, keepdims=True) * x)
        rows += [(-1 - len(rows) - k, v.tolist(), x.shape[1], 0) for k, v in enumerate(cos * x + math.sqrt(1 - cos * cos) * other)]
    if not rows:
        return None
    made = valid.sparkSession.createDataFrame(rows, "row long, x array<double>, dim int, copies long")
    kind = valid.schema["x"].dataType.simpleString()
    return cut_lineage(made.withColumn("x", F.col("x").cast(kind)) if kind == "array<float>" else made)


def linked(valid: DataFrame, count: int, threshold: float, seed: int) -> DataFrame:
    """(row, copies, actual) of about AUDIT classes that link with others; ``actual`` counts their links, by brute force."""
    most = AUDIT
    while True:
        asked = _asked(valid, count, most, seed)
        units = {}
        for at in _segments(asked, "dim"):
            own = asked.take(pa.array(at))
            units[own["dim"][0].as_py()] = (own["row"].to_numpy(), vectors.unit(vectors.matrix(own["x"])))

        def tally(batches, units=units):
            for batch in batches:
                for at in _segments(pa.table({"dim": batch.column(2)}), "dim"):
                    dim = batch.column(2)[int(at[0])].as_py()
                    if dim not in units:
                        continue
                    rows, asking = units[dim]
                    given = vectors.unit(vectors.matrix(batch.column(1).take(pa.array(at)))).T
                    copies = batch.column(3).to_numpy()[at]
                    for k in range(0, len(rows), BLOCK):
                        found = (asking[k : k + BLOCK] @ given >= threshold) @ copies
                        some = found > 0
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(rows[k : k + BLOCK][some], pa.int64()), pa.array(found[some], pa.int64())], names=["row", "n"]
                        )

        sums = valid.select("row", "x", "dim", "copies").mapInArrow(tally, "row long, n long").groupBy("row").agg(F.sum("n").alias("n"))
        # Copies are no finding: only links with other classes count.
        true = cut_lineage(
            sums.join(valid.select("row", "copies"), "row").select("row", "copies", (F.col("n") - F.col("copies")).alias("actual")).where("actual > 0")
        )
        if most >= min(count, ASKED) or true.count() >= AUDIT:
            return true
        most *= 8


def audit(true: DataFrame, links: DataFrame) -> float:
    """The share of a vector's true links that were found, as a mean over vectors that have any; 1 if none has."""
    found = F.coalesce("n_links", F.col("copies") - 1) + 1 - F.col("copies")
    mean = true.join(links, "row", "left").agg(F.avg(F.least("actual", found) / F.col("actual"))).first()[0]
    return 1.0 if mean is None else mean


def near_duplicates(table: DataFrame, threshold: float = 0.95, *, id_column: str = "vec_id", vector: str = "embedding", seed: int = 41) -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    every = vectors.rows(table, id_column, vector)
    valid, named, classes = equal_classes(every)
    count = valid.count()
    links = members = lists = None
    if count:
        probes, true = planted(valid, count, threshold, seed), linked(valid, count, threshold, seed)
        probed = valid if probes is None else valid.unionByName(probes)
        probe_count = 0 if probes is None else probes.count()
        searches, attempts, recall = 0, 0, 0.0
        placed = place(probed, None)
        while recall < RECALL:
            found = start(placed, count, threshold, seed + searches)
            lists = settle(placed, _lists(found if lists is None else replaced(lists, placed).unionByName(found)), count)
            searches += 1
            near = lists.where((F.col("cos") >= threshold) & (F.col("u") >= 0)).select("u", "v")
            ties = near if members is None else near.unionByName(members.select(F.col("row").alias("u"), F.col("root").alias("v")))
            members = cut_lineage(graph.components(ties).withColumnRenamed("node", "row"))
            full = saturated(lists, threshold)
            placed = place(probed, members)
            if full:
                continue
            links = cut_lineage(exact_links(valid, members, threshold))
            seen = lists.where((F.col("u") < 0) & (F.col("cos") >= threshold - 1e-6)).select("u").distinct().count()
            natural, made = audit(true, links), seen / probe_count if probe_count else 1.0
            recall = min(natural, made)
            LOG.info("recall %.4f of %d vectors with links, %.4f of %d planted, after %d searches", natural, true.count(), made, probe_count, searches)
            attempts += 1
            if recall < RECALL and attempts == ATTEMPTS:
                raise RuntimeError(f"near duplicates: recall {recall:.4f} is below {RECALL} after {searches} searches")
    if links is None:
        judged = named.select("id", F.col("id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    else:
        ties = members.join(links, "row").withColumnRenamed("row", "node")
        rooted = cut_lineage(
            classes.join(ties, "node", "left").select(
                "a", "b", "copies", "least", F.coalesce("root", "node").alias("root"),
                F.coalesce("n_links", F.col("copies") - 1).cast("long").alias("n_links"),
            )
        )
        least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        judged = by_class(named, cut_lineage(rooted.join(least, "root").drop("root", "least")))
    return judged.select(
        F.col("id").alias(id_column), "n_links", "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )
