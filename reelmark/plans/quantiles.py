"""Exact order statistics by narrowing: no values are sorted, gathered or listed."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPLITS = 4096  # cells that a range is cut into; no task or window holds more rows of a range


def exact_quantiles(counted: DataFrame, probabilities: list[float]) -> DataFrame:
    """Linear-interpolation quantiles per metric: (metric, probability, quantile).

    ``counted`` has (metric, value, n), n rows of that value, in any number of rows; it is read once a round. A
    round cuts the range in which a wanted rank lies into equal cells and counts them, combined on the map side; the
    rank's cell, from its least to its greatest value, is the next range. It ends with a range of one value, so
    the answer is exact. Metrics and probabilities are few: what comes to the driver is a row for each.
    """
    spark = counted.sparkSession
    values = counted.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.col("n") > 0))
    totals = values.groupBy("metric").agg(F.sum("n").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).collect()
    asked = [(t["metric"], p, p * (t["n"] - 1)) for t in totals for p in probabilities]
    whole = {t["metric"]: (t["low"], t["high"], 0) for t in totals}
    ranges = {(m, rank): whole[m] for m, _, at in asked for rank in (math.floor(at), math.ceil(at))}
    while open_ := {target: r for target, r in ranges.items() if r[0] < r[1]}:
        cells = sorted({(m, *r) for (m, _), r in open_.items()})
        wanted = {i: [rank - c[3] for (m, rank), r in open_.items() if (m, *r) == c] for i, c in enumerate(cells)}
        value, places = F.col("value"), []
        for i, (metric, low, high, _) in enumerate(cells):
            share = (value / 2 - F.lit(low / 2)) / F.lit(high / 2 - low / 2)  # halves: the range itself may be too large a number
            cell = F.least(F.floor(share * SPLITS), F.lit(SPLITS - 1)).cast("int")
            inside = (F.col("metric") == metric) & value.between(low, high)
            places.append(F.when(inside, F.struct(F.lit(i).alias("range"), cell.alias("cell"))))
        placed = values.select("value", "n", F.explode(F.array_compact(F.array(*places))).alias("_p"))
        counts = placed.groupBy("_p.range", "_p.cell").agg(F.sum("n").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        so_far = Window.partitionBy("range").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        before = counts.withColumn("before", F.sum("n").over(so_far) - F.col("n"))
        ranks = F.create_map(*[x for i, of in wanted.items() for x in (F.lit(i), F.array(*map(F.lit, of)))])[F.col("range")]
        holds = F.exists(ranks, lambda r: (F.col("before") <= r) & (r < F.col("before") + F.col("n")))
        found = before.where(holds).collect()
        for (metric, rank), held in open_.items():
            place = cells.index((metric, *held))
            for row in found:
                if row["range"] == place and row["before"] <= rank - held[2] < row["before"] + row["n"]:
                    ranges[metric, rank] = (row["low"], row["high"], held[2] + row["before"])
    out = []
    for metric, p, at in asked:
        low, high = (ranges[metric, rank][0] for rank in (math.floor(at), math.ceil(at)))
        out.append((metric, float(p), low + (high - low) * (at - math.floor(at))))
    return spark.createDataFrame(out, "metric string, probability double, quantile double")
