"""Problem 3: exact percentiles of hot groups by one distributed sort, and summaries that can be combined.

The values are sorted over all partitions by (group, value, id). Counting per partition gives each group's offsets;
the wanted positions are then looked up where they lie and neighbouring order statistics are interpolated. The error
of a direct result is 0. `rank_summary` keeps order statistics at m + 1 even steps of every part (a month, a file);
merging summaries of any number of parts gives percentiles whose rank is off by at most 1/m of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.order_stats import bucket
from ..session import cut, sized_partitions
from .topn import _changes, finite, whole


HELD = 8_000_000  # values that a task holds at once, 8 bytes each


def _runs(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Starts of the runs of equal keys, with the row count as last entry."""
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for k in keys:
        new[1:] |= _changes(t[k].combine_chunks())
    return np.append(np.flatnonzero(new), t.num_rows)


def _whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    own = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(own).combine_chunks() if own else None


def order_statistics(df: DataFrame, keys: list[str], value: str, unique: str, at: list[float]) -> DataFrame:
    """For every group of `keys` and every p of `at` the linearly interpolated percentile of `value`.

    Returns keys, p, n (values counted), x (double). Null, NaN and infinite values don't count; groups without a
    value don't come out; a null key is a group. `unique` breaks ties so that one repeated value can be split too.

    What is kept of the sort is only its values, packed by runs of one group. Only the groups at either end of a
    partition may go on elsewhere: at most two a partition. Their counts, bounded by the partition count, pass
    through the driver; every other group is whole in its partition and done there."""
    kinds = {f.name: f for f in df.schema.fields}
    x = F.col(value).cast("double")
    rows = df.select(*keys, x.alias("_x"), F.col(unique).alias("_u")).filter(F.col("_x").isNotNull() & ~F.isnan("_x") & (F.abs("_x") != float("inf")))
    order = [F.col(k).asc_nulls_first() for k in [*keys, "_x", "_u"]]
    key_fields = [kinds[k] for k in keys]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            cuts = _runs(t, keys)
            xs = t["_x"].to_numpy()
            out = t.select(keys).take(cuts[:-1]).append_column("_xs", pa.array([xs[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()))
            yield from out.combine_chunks().to_batches()

    packed = T.StructType([*key_fields, T.StructField("_xs", T.BinaryType())])
    ordered = cut(rows.repartitionByRange(sized_partitions(rows, HELD), *order).sortWithinPartitions(*order).mapInArrow(pack, packed))

    def unpacked(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray, np.ndarray] | None:
        """Keys of each run, starts of the runs with the count as last entry, all values."""
        t = _whole(batches)
        if t is None:
            return None
        chunks = t["_xs"].to_pylist()
        cuts = _runs(t, keys)
        sizes = np.append(0, np.cumsum([len(c) // 8 for c in chunks]))
        return t.select(keys).take(cuts[:-1]), sizes[cuts], np.frombuffer(b"".join(chunks))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (got := unpacked(batches)) is None:
            return
        names, cuts, _ = got
        runs = [0] if len(cuts) == 2 else [0, len(cuts) - 2]
        out = names.take(runs).append_column("_pid", pa.array([TaskContext.get().partitionId()] * len(runs), pa.int32()))
        yield from out.append_column("_n", pa.array([int(cuts[r + 1] - cuts[r]) for r in runs], pa.int64())).combine_chunks().to_batches()

    spec = T.StructType([*key_fields, T.StructField("_pid", T.IntegerType()), T.StructField("_n", T.LongType())])
    total: dict[tuple, int] = {}
    before: dict[tuple, int] = {}
    for row in sorted(ordered.mapInArrow(ends, spec).collect(), key=lambda r: r["_pid"]):
        k = tuple(row[c] for c in keys)
        before[(row["_pid"], *k)] = total.get(k, 0)
        total[k] = total.get(k, 0) + row["_n"]

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (got := unpacked(batches)) is None:
            return
        names, cuts, xs = got
        here = np.diff(cuts)
        n, first = here.copy(), np.zeros(len(here), np.int64)
        for r in {0, len(n) - 1}:
            k = tuple(names[c][r].as_py() for c in keys)
            first[r], n[r] = before[(TaskContext.get().partitionId(), *k)], total[k]
        group, ps, parts = [], [], []
        for p in at:
            pos = p * (n - 1)
            lo = np.floor(pos + 1e-9).astype(np.int64)
            frac = np.clip(pos - lo, 0, 1)
            for place, weight in ((lo, 1 - frac), (np.minimum(lo + 1, n - 1), frac)):
                g = np.flatnonzero((place >= first) & (place < first + here) & (weight > 0))
                group.append(g)
                ps.append(np.full(len(g), p))
                parts.append(xs[(cuts[:-1] + place - first)[g]] * weight[g])
        g = np.concatenate(group)
        out = names.take(g).append_column("p", pa.array(np.concatenate(ps))).append_column("n", pa.array(n[g])).append_column("_part", pa.array(np.concatenate(parts)))
        yield from out.combine_chunks().to_batches(max_chunksize=20000)

    spec = T.StructType([*key_fields, T.StructField("p", T.DoubleType()), T.StructField("n", T.LongType()), T.StructField("_part", T.DoubleType())])
    return ordered.mapInArrow(locate, spec).groupBy(*keys, "p", "n").agg(F.sum("_part").alias("x"))


def rank_summary(df: DataFrame, keys: list[str], value: str, unique: str, m: int = 100) -> DataFrame:
    """Order statistics of every group at p = 0, 1/m, ..., 1: keys, p, n, x. Any percentile of the group read from it
    has a rank error of at most 1/m."""
    return order_statistics(df, keys, value, unique, [i / m for i in range(m + 1)])


def combine(summaries: DataFrame, keys: list[str], m: int, at: list[float]) -> DataFrame:
    """Percentiles per group of `keys` from rank summaries of parts (any further key columns): keys, p, n, x.

    Each stored point stands for n/m rows of its part, its end points for half as many. A group has at most m + 1
    points a part. The rank error is at most 1/m of the rows (plus one row a part), whatever parts are merged."""
    w = F.col("n") / F.lit(m) * F.when((F.col("p") == 0) | (F.col("p") == 1), 0.5).otherwise(1.0)
    pts = summaries.groupBy(*keys, "x").agg(F.sum(w).alias("w"), F.sum(F.when(F.col("p") == 0, F.col("n")).otherwise(0)).alias("n")).withColumn("b", bucket(F.col("x")))
    # Buckets of values first, some thousands a group; then only the points of the few buckets that hold a percentile.
    every = Window.partitionBy(*keys)
    up = every.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    by = pts.groupBy(*keys, "b").agg(F.sum("w").alias("w"), F.sum("n").alias("n"))
    by = by.withColumns({"upto": F.sum("w").over(up), "n": F.sum("n").over(every), "last": F.max("b").over(every)}).withColumn("start", F.lag("upto", 1).over(every.orderBy("b")))
    tries = by.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in at]))).withColumn("goal", F.col("p") * F.col("n") - 1e-9)
    reached = (F.col("upto") >= F.col("goal")) & (F.col("start").isNull() | (F.col("start") < F.col("goal")))
    wanted = tries.filter(reached | (F.col("b") == F.col("last")) & (F.col("upto") < F.col("goal")))
    wanted = wanted.select(*[F.col(k).alias("_" + k) for k in keys], F.col("b").alias("_b"), "p", "n", "goal", F.coalesce("start", F.lit(0.0)).alias("start"))
    same = F.col("b") == F.col("_b")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col("_" + k))
    inside = pts.select(*keys, "x", "w", "b").join(wanted, same)
    upto = F.col("start") + F.sum("w").over(Window.partitionBy(*keys, "p").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    first = F.min(F.when(F.col("upto") >= F.col("goal"), F.col("x")))
    return inside.withColumn("upto", upto).groupBy(*keys, "p", "n").agg(F.coalesce(first, F.max("x")).alias("x"))


MEASURES = ("neural_conviction", "recovery_factor", "slot_15")
AT = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


def long_measures(signatures: DataFrame, **groups: Column) -> DataFrame:
    """The columns named by groups, sig_id, measure and value: one row per signature and measure."""
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in MEASURES])).alias("_m")
    rows = signatures.select(*[c.alias(k) for k, c in groups.items()], "sig_id", stack)
    return rows.select(*groups, "sig_id", "_m.measure", "_m.value")


def symbol_and_phylum(signatures: DataFrame) -> DataFrame:
    """kind ('symbol' or 'phylum'), grp, measure, value, sig_id: every row once for its symbol, once for its phylum."""
    both = F.array(F.struct(F.lit("symbol").alias("kind"), F.col("symbol").alias("grp")), F.struct(F.lit("phylum").alias("kind"), F.when(finite("slot_28"), whole("slot_28").cast("string")).alias("grp")))
    return long_measures(signatures.withColumn("_g", F.explode(both)), kind=F.col("_g.kind"), grp=F.col("_g.grp")).filter(F.col("grp").isNotNull())
