"""Count, mean and exact quantiles of few large groups.

The built-in median keeps a map of a group's distinct values in memory, which suits many small groups. Here values are
counted by key and value first, which spreads a group over all tasks. Counts are then summed by ranges of values: 256 of
them between any number and its double. A running sum over these few ranges tells where a rank lies, and only the ranges
that hold a wanted rank are ranked value by value. So a group may have any number of values, and no task sees all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 256


def value_range(v: Column) -> Column:
    """Number of the range that a value lies in, in order of the values; one of its own for 0, infinities, nan and null."""

    def of(x: Column) -> Column:
        # From 1 up: the least positive double has a logarithm above -1100.
        return (F.floor(F.log2(x) * RANGES) + 1200 * RANGES).cast("long")

    far = F.lit(10_000 * RANGES).cast("long")
    plain = F.when(v > 0, of(F.when(v > 0, v))).when(v < 0, -of(F.when(v < 0, -v))).otherwise(F.lit(0).cast("long"))
    # Never null, and seen to be: a test for null would make this plan's two uses of the counts differ, and count twice.
    return F.coalesce(F.when(v.isNull(), -2 * far).when(F.isnan(v), 2 * far).when(v == float("inf"), far).when(v == float("-inf"), -far).otherwise(plain), F.lit(0).cast("long"))


def describe(rows: DataFrame, keys: list[str], value: Column, quantiles: list[float]) -> DataFrame:
    """keys, n (values that aren't null), mean, q (an interpolated value for each quantile); a row per group, nulls if it has no value."""
    counts = rows.select(*keys, value.cast("double").alias("v")).groupBy(*keys, "v").agg(F.count("v").alias("c")).withColumn("b", value_range(F.col("v")))
    ranges = counts.groupBy(*keys, "b").agg(F.sum("c").alias("c"), F.sum(F.col("v") * F.col("c")).alias("s"))
    group = Window.partitionBy(*keys)
    ranges = ranges.withColumn("n", F.sum("c").over(group)).withColumn("before", F.sum("c").over(group.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c"))
    ranks = []
    for p in quantiles:
        place = (F.col("n").cast("double") - 1) * p
        ranks.append((place, F.floor(place), F.ceil(place)))
    holds = F.lit(False)
    for _, low, high in ranks:
        for at in (low, high):
            holds = holds | ((F.col("before") <= at) & (at < F.col("before") + F.col("c")))
    # At most two rows a quantile and group.
    wanted = ranges.filter(holds).select(*[F.col(k).alias(f"w_{k}") for k in keys], F.col("b").alias("w_b"), "n", "before")
    same = F.col("b") == F.col("w_b")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"w_{k}"))
    inside = Window.partitionBy(*keys, "b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    picked = counts.join(wanted, same).withColumn("upto", F.col("before") + F.sum("c").over(inside))
    ends = [F.min(F.when(F.col("upto") > at, F.col("v"))).alias(f"{name}{i}") for i, (_, low, high) in enumerate(ranks) for name, at in (("low", low), ("high", high))]
    picked = picked.groupBy(*keys).agg(F.max("n").alias("p_n"), *ends).withColumnsRenamed({k: f"p_{k}" for k in keys})
    out = ranges.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum("s").alias("s"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"p_{k}"))
    out = out.join(picked, same, "left") if keys else out.crossJoin(picked)  # one row each
    values = []
    for i, (place, low, _) in enumerate(ranks):
        share = place - low
        values.append(F.when(share == 0, F.col(f"low{i}")).otherwise(F.col(f"low{i}") * (1 - share) + F.col(f"high{i}") * share))
    n = F.coalesce("n", F.lit(0)).cast("long")
    return out.select(*keys, n.alias("n"), F.when(F.col("n") > 0, F.col("s") / F.col("n")).alias("mean"), F.when(F.col("n") > 0, F.array(*values)).alias("q"))
