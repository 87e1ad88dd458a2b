"""Joins in which one key may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

HEAVY = 1_000_000  # rows of one key from which they are dealt out over several tasks


def crowded(df: DataFrame, on: str, heavy: int | None = None) -> DataFrame | None:
    """_k, _lots: the keys of more than `heavy` rows and how many lots they are dealt into; None if there are none.

    At most one key per `heavy` rows of df, some 12 bytes each, so it may be sent to all tasks. Rows are counted with
    partial counts before the shuffle."""
    heavy = heavy or HEAVY
    keys = cut(df.groupBy(F.col(on).alias("_k")).count().filter(F.col("count") > heavy).select("_k", F.ceil(F.col("count") / heavy).cast("int").alias("_lots")))
    return None if keys.isEmpty() else keys


def spread_join(many: DataFrame, few: DataFrame, on: str, how: str = "inner", keys: DataFrame | None = None, rows: int | None = None, heavy: int | None = None) -> DataFrame:
    """many.join(few, on, how), how being inner or left, with the crowded keys of `many` dealt out in lots.

    A crowded key's rows of `few`, which should be few, are repeated once per lot. keys: from `crowded`, where the
    caller knows them; rows: how many `many` has, if known: too few for any key to be crowded aren't counted. Null keys match nothing; equal rows may fall into one lot; empty sides give what join gives."""
    if keys is None and (rows is None or rows > (heavy or HEAVY)):
        keys = crowded(many, on, heavy)
    if keys is None:
        return many.join(few, on, how)
    known = F.broadcast(keys)
    lot = F.pmod(F.xxhash64(*many.columns, F.spark_partition_id()), F.coalesce("_lots", F.lit(1))).cast("int")
    left = many.join(known, F.col(on).eqNullSafe(F.col("_k")), "left").withColumn("_lot", lot).select(*many.columns, "_lot")
    right = few.join(known, F.col(on) == F.col("_k"), "left").withColumn("_lot", F.explode(F.sequence(F.lit(0), F.coalesce("_lots", F.lit(1)) - 1))).select(*few.columns, "_lot")
    return left.join(right, [on, "_lot"], how).drop("_lot")
