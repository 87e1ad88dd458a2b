"""Joins along time: as of, onto grids and calendars, onto folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000_000


def asof_backward(left: DataFrame, right: DataFrame, by: str, left_us: str, right_us: str, values: list[str], chunk: int = DAY) -> DataFrame:
    """left with, of right, the values of the last row of the same `by` at or before its time; null without one.

    Times are microseconds. Each right row holds until the next; these validity intervals are cut at chunk borders and
    met by equality of (by, chunk), so a hot key spreads over its chunks. Of right rows at one time the one with the
    largest values counts; null times on the right don't count, on the left they match nothing."""
    r = right.filter(F.col(right_us).isNotNull() & F.col(by).isNotNull()).groupBy(by, right_us).agg(F.max(F.struct(*values)).alias("_v"))
    ends = left.groupBy(by).agg(F.max(left_us).alias("_end"))
    r = r.join(ends, by).withColumn("_until", F.lead(right_us).over(Window.partitionBy(by).orderBy(right_us)))
    r = r.withColumn("_until", F.coalesce("_until", F.col("_end") + 1)).filter(F.col("_until") > F.col(right_us))
    r = r.withColumn("_chunk", F.explode(F.sequence(F.floor(F.col(right_us) / chunk).cast("long"), F.floor((F.col("_until") - 1) / chunk).cast("long"))))
    r = r.select(F.col(by).alias("_by"), F.col("_chunk").alias("_rc"), F.col(right_us).alias("_from"), "_until", "_v")
    keyed = left.withColumn("_chunk", F.floor(F.col(left_us) / chunk).cast("long"))
    on = (F.col(by) == F.col("_by")) & (F.col("_chunk") == F.col("_rc")) & (F.col(left_us) >= F.col("_from")) & (F.col(left_us) < F.col("_until"))
    out = keyed.join(r, on, "left")
    return out.select(*left.columns, *[F.col("_v")[v].alias(v) for v in values])


def filled_from(left: DataFrame, right: DataFrame, on: list[str], values: list[str], fill: float = 0.0) -> DataFrame:
    """left with the values of right at the same keys, `fill` where right has no such key; right's nulls stay null.

    right should be unique in its keys."""
    r = right.select(*on, *values, F.lit(True).alias("_there"))
    out = left.join(r, on, "left")
    return out.select(*left.columns, *[F.when(F.col("_there"), F.col(v)).otherwise(F.lit(fill)).alias(v) for v in values])


def calendar_filled(daily: DataFrame, day: str, values: list[str], by: list[str] | None = None) -> DataFrame:
    """daily (one row per by and day) with a row for every day between each group's first and last, values 0 there."""
    by = by or []
    span = daily.groupBy(*by).agg(F.min(day).alias("_a"), F.max(day).alias("_z")).filter(F.col("_a").isNotNull())
    days = span.select(*by, F.explode(F.sequence("_a", "_z")).alias(day))
    out = days.join(daily, [*by, day], "left")
    return out.select(*by, day, *[F.coalesce(v, F.lit(0.0)).alias(v) for v in values])


def folds(first: int, last: int, window: int, step: int) -> list[tuple[int, int, int]]:
    """(fold, train start, test start) in the unit of the bounds while train start + window < last."""
    return [(k, first + k * step, first + k * step + window) for k in range(max(0, -(-(last - first - window) // step)))]


def fold_rows(df: DataFrame, at: str, first: int, last: int, window: int, step: int) -> DataFrame:
    """Rows once per fold and part that they belong to: adds fold and part ('train' or 'test').

    A row's folds follow from arithmetic on its time, so no join is needed."""
    x = F.col(at) - F.lit(first)
    count = len(folds(first, last, window, step))
    # fold k trains on [k step, k step + window) and tests on [k step + window, (k + 1) step + window)
    k_last = F.floor(x / step).cast("long")
    k_first = F.greatest((F.floor((x - window) / step) + 1).cast("long"), F.lit(0))
    train = F.filter(F.when(k_last >= k_first, F.sequence(k_first, k_last)).otherwise(F.array().cast("array<long>")), lambda k: k < count)
    k_test = F.floor((x - window) / step).cast("long")
    test = F.when((x >= window) & (k_test < count), F.array(k_test)).otherwise(F.array().cast("array<long>"))
    parts = F.concat(F.transform(train, lambda k: F.struct(k.alias("fold"), F.lit("train").alias("part"))), F.transform(test, lambda k: F.struct(k.alias("fold"), F.lit("test").alias("part"))))
    return df.filter(F.col(at).isNotNull()).withColumn("_f", F.explode(parts)).select(*df.columns, "_f.fold", "_f.part")
