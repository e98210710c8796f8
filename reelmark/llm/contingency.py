"""Random count tables with fixed margins, by hypergeometric splits, in DataFrame functions only.

Rows of the table are leaves of a binary tree (shards or input partitions); its columns are the
entries of a vector (sources or shards). A node holds how much of each entry falls into its range of
leaves; splitting it draws the left child's vector from the multivariate hypergeometric distribution,
entry by entry, and gives the right child the rest. Every margin is met exactly, and the counts are
those of a uniform random permutation that was cut into leaves.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmark.llm.frames import uniform

SPREAD = 12  # standard deviations looked at; what lies beyond has a chance far below 2**-53
SPREAD_AFTER = 5  # levels after which the nodes are dealt out again


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once."""
    return F.transform(F.array(value), body)[0]


def _log_factorial(x: Column) -> Column:
    big = F.greatest(x, F.lit(1.0))
    series = (
        big * F.log(big) - big + 0.5 * F.log(2 * math.pi * big)
        + 1 / (12 * big) - 1 / (360 * big * big * big) + 1 / (1260 * big * big * big * big * big)
    )
    return F.when(x < 20, F.log(F.factorial(F.least(x, F.lit(20.0)).cast("int")).cast("double"))).otherwise(series)


def hypergeometric(population: Column, good: Column, draws: Column, u: Column) -> Column:
    """How many of ``good`` are among ``draws`` out of ``population``, by inversion at ``u``."""

    def sample(p: Column) -> Column:
        mean = p["n"] * p["k"] / p["t"]
        rest = p["t"] - p["k"]
        spread = SPREAD * F.sqrt(mean * (rest / p["t"]) * (p["t"] - p["n"]) / F.greatest(p["t"] - 1, F.lit(1.0))) + SPREAD
        low = F.greatest(F.lit(0.0), p["n"] - rest, F.floor(mean - spread).cast("double"))
        high = F.least(p["n"], p["k"], F.ceil(mean + spread).cast("double"))
        return _let(
            F.struct(p["t"].alias("t"), p["k"].alias("k"), p["n"].alias("n"), p["u"].alias("u"), low.alias("low"), high.alias("high"), F.round(mean).alias("mid")),
            choose,
        )

    def choose(q: Column) -> Column:
        def weight(x: Column) -> Column:
            return -(
                _log_factorial(x) + _log_factorial(q["k"] - x) + _log_factorial(q["n"] - x)
                + _log_factorial(q["t"] - q["k"] - q["n"] + x)
            )

        top = F.least(q["high"], F.greatest(q["low"], q["mid"]))
        weights = _let(
            weight(top),
            lambda peak: F.transform(
                F.sequence(q["low"].cast("bigint"), q["high"].cast("bigint")),
                lambda x: F.exp(weight(x.cast("double")) - peak),
            ),
        )
        return _let(weights, lambda w: pick(q, w))

    def pick(q: Column, w: Column) -> Column:
        total = F.aggregate(w, F.lit(0.0), lambda s, x: s + x)
        found = _let(
            total * q["u"],
            lambda target: F.aggregate(
                w,
                F.struct(F.lit(0.0).alias("sum"), q["low"].alias("x")),
                lambda a, x: F.struct(
                    (a["sum"] + x).alias("sum"),
                    (a["x"] + F.when(a["sum"] + x <= target, 1.0).otherwise(0.0)).alias("x"),
                ),
            )["x"],
        )
        return F.least(found, q["high"])

    given = F.struct(
        population.cast("double").alias("t"), good.cast("double").alias("k"), draws.cast("double").alias("n"), u.alias("u")
    )
    return (
        F.when((draws <= 0) | (good <= 0), F.lit(0).cast("bigint"))
        .when(good >= population, draws)
        .when(draws >= population, good)
        .otherwise(_let(given, sample).cast("bigint"))
    )


def multivariate(vector: Column, draws: Column, *seed: Column) -> Column:
    """An array like ``vector`` that sums to ``draws``: what a uniform draw without replacement holds of each entry."""
    total = F.aggregate(vector, F.lit(0).cast("bigint"), lambda s, x: s + x)
    entries = F.transform(vector, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    start = F.struct(total.alias("t"), draws.cast("bigint").alias("n"), F.array().cast("array<bigint>").alias("out"))

    def step(a: Column, e: Column) -> Column:
        taken = hypergeometric(a["t"], e["x"], a["n"], uniform(*seed, e["i"]))
        return _let(
            taken,
            lambda k: F.struct(
                (a["t"] - e["x"]).alias("t"), (a["n"] - k).alias("n"), F.concat(a["out"], F.array(k)).alias("out")
            ),
        )

    return F.aggregate(entries, start, step)["out"]


def split_tree(vector: DataFrame, sums: DataFrame, leaves: int, seed: int) -> DataFrame:
    """(leaf, entry, n): a random table with the entries' totals and the leaves' totals.

    ``vector``: one row with an array ``vec`` of totals. Its length, the number of sources or shards,
    is a setting of the job, not data. ``sums``: (pos, sum) for pos 0 to ``leaves``, the leaves' totals
    before each position.
    """
    nodes = vector.select(F.lit(0).cast("bigint").alias("lo"), F.lit(leaves).cast("bigint").alias("hi"), "vec")
    first = sums.select(F.col("pos").alias("lo"), F.col("sum").alias("at_lo"))
    middle = sums.select(F.col("pos").alias("mid"), F.col("sum").alias("at_mid"))
    for level in range(max(0, (leaves - 1).bit_length())):
        drawn = (
            nodes.withColumn("mid", F.floor((F.col("lo") + F.col("hi")) / 2).cast("bigint"))
            .join(first, "lo")
            .join(middle, "mid")
            .withColumn("left", multivariate(F.col("vec"), F.col("at_mid") - F.col("at_lo"), F.lit(seed), F.col("lo"), F.col("hi")))
        )
        one = F.array(F.struct("lo", "hi", "vec"))
        two = F.array(
            F.struct("lo", F.col("mid").alias("hi"), F.col("left").alias("vec")),
            F.struct(F.col("mid").alias("lo"), "hi", F.zip_with("vec", "left", lambda a, b: a - b).alias("vec")),
        )
        nodes = drawn.select(F.explode(F.when(F.col("hi") - F.col("lo") > 1, two).otherwise(one)).alias("s")).select("s.*")
        if (level + 1) % SPREAD_AFTER == 0:
            nodes = nodes.repartition("lo")
    return nodes.select(F.col("lo").alias("leaf"), F.posexplode("vec").alias("entry", "n"))
