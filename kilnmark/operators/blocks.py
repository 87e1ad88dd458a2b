"""Long series in blocks with halos, so that window functions over one series run in many tasks.

Rows get their position within their series without a single-task window; a block is a range of positions, and each
block also receives the rows just before and after it that its frames look at. Frames that fit into the halo give the
same values as over the whole series, whatever the block size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordered import Ordered

BLOCK = 8_192  # rows of a series in one block
IDX, CORE = "bar_idx", "_core"


def positions(df: DataFrame, series: str, order: list[str], name: str = IDX) -> DataFrame:
    """df with each row's position (from 0) within its series, by `order`, which should end in a unique column.

    Only the first series of a partition can have begun in an earlier one, so the driver receives the row counts of
    two series per partition at most. A null series is a series of its own."""
    ordered = Ordered(df, [series, *order])

    def runs(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        c = b.column(b.schema.get_field_index(series)).dictionary_encode()
        code = np.asarray(c.indices.fill_null(-1))
        cuts = np.flatnonzero(np.diff(code, prepend=code[0] - 1))
        return cuts, np.diff(np.append(cuts, len(code)))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for b in batches:
            cuts, sizes = runs(b)
            for i, n in zip(cuts, sizes, strict=True):
                key = b.column(b.schema.get_field_index(series))[int(i)].as_py()
                if first is None:
                    first = [key, int(n)]
                elif last is None and first[0] == key:
                    first[1] += int(n)
                elif last is not None and last[0] == key:
                    last[1] += int(n)
                else:
                    last = [key, int(n)]
        got = [x for x in (first, last) if x]
        if got:
            pid = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([pid] * len(got), pa.int32()), pa.array([x[0] for x in got], kind), pa.array([x[1] for x in got], pa.int64())], names=["pid", "key", "n"])

    key_type = df.schema[series].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(key_type)
    total: dict = {}
    before: dict = {}
    for r in sorted(ordered.map(ends, T.StructType([T.StructField("pid", T.IntegerType()), T.StructField("key", key_type), T.StructField("n", T.LongType())])).collect(), key=lambda r: r["pid"]):
        before[(r["pid"], r["key"])] = total.get(r["key"], 0)
        total[r["key"]] = total.get(r["key"], 0) + r["n"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        key, at = object(), 0
        for b in batches:
            cuts, sizes = runs(b)
            out = np.empty(b.num_rows, np.int64)
            for i, n in zip(cuts, sizes, strict=True):
                k = b.column(b.schema.get_field_index(series))[int(i)].as_py()
                if k != key:
                    key, at = k, before.get((pid, k), 0)
                out[i : i + n] = np.arange(at, at + n)
                at += n
            yield b.append_column(name, pa.array(out))

    return ordered.map(number, T.StructType([*df.schema.fields, T.StructField(name, T.LongType())]))


def with_halo(df: DataFrame, back: int, ahead: int = 0, block: int = BLOCK) -> DataFrame:
    """Rows of df (with bar_idx) once per block that needs them: column block, and _core where the row is its own."""
    first = F.floor(F.greatest(F.col(IDX) - ahead, F.lit(0)) / block).cast("long")
    last = F.floor((F.col(IDX) + back) / block).cast("long")
    out = df.withColumn("block", F.explode(F.sequence(first, last)))
    return out.withColumn(CORE, F.floor(F.col(IDX) / block) == F.col("block"))


def core(df: DataFrame) -> DataFrame:
    """The blocks' own rows, without the helper columns."""
    return df.filter(CORE).drop(CORE, "block")


def along(series: str = "symbol") -> WindowSpec:
    """The window over one block of a series, in order."""
    return Window.partitionBy(series, "block").orderBy(IDX)


def cumulative(df: DataFrame, columns: dict[str, tuple[str, str]], series: str = "symbol", block: int = BLOCK) -> DataFrame:
    """Adds running sums, maxima or minima over a whole series: columns maps a new name to (column, 'sum'|'max'|'min').

    Blocks are summed up first; a block's start comes from the totals of the blocks before it, so only block totals,
    a fraction 1 / block of the rows, lie in one window per series. Nulls are skipped; needs bar_idx."""
    f = {"sum": F.sum, "max": F.max, "min": F.min}
    df = df.withColumn("block", F.floor(F.col(IDX) / block).cast("long"))
    totals = df.groupBy(series, "block").agg(*[f[how](c).alias(f"_t_{n}") for n, (c, how) in columns.items()])
    past = Window.partitionBy(series).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(series, "block", *[f[how](f"_t_{n}").over(past).alias(f"_p_{n}") for n, (_, how) in columns.items()])
    own = along(series).rowsBetween(Window.unboundedPreceding, 0)
    join = {"sum": lambda a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)), "max": F.greatest, "min": F.least}
    out = df.join(totals, [series, "block"])
    out = out.withColumns({n: join[how](f[how](c).over(own), F.col(f"_p_{n}")) for n, (c, how) in columns.items()})
    return out.drop("block", *[f"_p_{n}" for n in columns])


def time_blocks(df: DataFrame, series: str, seconds: str, reach: int, width: int) -> DataFrame:
    """Rows once per stretch of `width` seconds that needs them: their own, and the next within `reach` seconds.

    For windows over a range of time; adds block and _core. width should exceed reach."""
    first = F.floor(F.col(seconds) / width).cast("long")
    last = F.floor((F.col(seconds) + reach) / width).cast("long")
    return df.withColumn("block", F.explode(F.sequence(first, last))).withColumn(CORE, first == F.col("block"))
