"""Exact quantiles of hot groups in two rounds of counting.

Round one counts values by (group, bucket), a bucket being a monotone step function of the value that is some 0.2 %
wide; counts combine before the shuffle, so a group with a third of all rows costs no task more than its buckets.
Round two looks only at the buckets that hold the wanted positions, counts their distinct values and picks the exact
order statistics. Nothing holds all values of a group, as the built-in exact percentile does.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

STEPS = 512  # buckets per e-fold of magnitude
BROADCAST_ROWS = 100_000  # wanted buckets that may be sent to all tasks, some 50 bytes each
TINY = 1e-12  # magnitudes below this share the buckets next to zero


def bucket(x: Column) -> Column:
    """A long that never falls as the finite double x rises."""
    return (F.signum(x) * F.floor(STEPS * (F.ln(F.abs(x) + TINY) - math.log(TINY)))).cast("long")


def exact_quantiles(df: DataFrame, group: str | None, values: dict[str, Column], at: list[float]) -> DataFrame:
    """grp, q, p, n, x: per group, entry of `values` and p of `at` the linearly interpolated quantile x.

    Only finite, non-null values count (n of them); groups without any don't come out. A null group is a group like any
    other; without `group` all rows are one (grp is null). grp has the type of the group column."""
    g = F.lit(None).cast("string") if group is None else F.col(group)
    q = F.explode(F.array(*[F.struct(F.lit(k).alias("q"), v.cast("double").alias("x")) for k, v in values.items()]))
    long = df.select(g.alias("g"), q.alias("v")).select("g", "v.q", "v.x")
    long = long.filter(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") != float("inf"))).withColumn("b", bucket(F.col("x")))
    counts = long.groupBy("g", "q", "b").count()
    up = Window.partitionBy("g", "q").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("upto", F.sum("count").over(up)).withColumn("n", F.sum("count").over(Window.partitionBy("g", "q")))
    tries = counts.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in at]))).withColumn("pos", F.col("p") * (F.col("n") - 1))
    tries = tries.withColumn("lo", F.floor(F.col("pos") + 1e-9).cast("long")).withColumn("first", F.col("upto") - F.col("count"))
    tries = tries.withColumn("hi", F.least(F.col("lo") + 1, F.col("n") - 1)).withColumn("frac", F.greatest(F.col("pos") - F.col("lo"), F.lit(0.0)))
    holds = lambda p: (F.col(p) >= F.col("first")) & (F.col(p) < F.col("upto"))
    # A few rows a group: sent to all tasks if they are few, else the values meet them in a shuffle.
    wanted = cut(tries.filter(holds("lo") | holds("hi")).select(F.col("g").alias("wg"), F.col("q").alias("wq"), F.col("b").alias("wb"), "first", "p", "lo", "hi", "frac", "n"))
    small = wanted.count() <= BROADCAST_ROWS
    buckets = wanted.select("wg", "wq", "wb", "first").distinct()
    inside = long.join(F.broadcast(buckets) if small else buckets, F.col("g").eqNullSafe(F.col("wg")) & (F.col("q") == F.col("wq")) & (F.col("b") == F.col("wb")))
    inside = inside.groupBy("g", "q", "b", "x", "first").count()
    w = Window.partitionBy("g", "q", "b").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("end", F.col("first") + F.sum("count").over(w)).withColumn("start", F.col("end") - F.col("count")).drop("first")
    both = inside.join(wanted.drop("first"), F.col("g").eqNullSafe(F.col("wg")) & (F.col("q") == F.col("wq")) & (F.col("b") == F.col("wb")))
    has = lambda p: (F.col(p) >= F.col("start")) & (F.col(p) < F.col("end"))
    part = F.when(has("lo"), F.col("x") * (1 - F.col("frac"))).otherwise(0.0) + F.when(has("hi") & (F.col("frac") > 0), F.col("x") * F.col("frac")).otherwise(0.0)
    return both.filter(has("lo") | (has("hi") & (F.col("frac") > 0))).groupBy(F.col("g").alias("grp"), "q", "p", "n").agg(F.sum(part).alias("x"))


def exact_medians(df: DataFrame, group: str, values: dict[str, Column]) -> DataFrame:
    """One row per value of `group`, one double column per entry of `values`: its exact median, null without values."""
    got = exact_quantiles(df, group, values, [0.5])
    return got.groupBy(F.col("grp").alias(group)).agg(*[F.max(F.when(F.col("q") == k, F.col("x"))).alias(k) for k in values])
