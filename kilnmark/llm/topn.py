"""Problem 1: the N best rows of every group, by secondary sort.

Rows are sorted by (group, score, id) where they lie and each input partition keeps N rows per group, so what is
shuffled is at most N rows per group and input partition, however large a group is. Then the rows are hash-partitioned
by group, sorted again and streamed: a carry of one key and one counter is all the state, no group is ever buffered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _changes(col: pa.Array) -> np.ndarray:
    """Whether row i > 0 differs from row i - 1, nulls and NaNs being alike among themselves."""
    n = len(col)
    if n < 2:
        return np.zeros(max(0, n - 1), bool)
    a, b = col.slice(0, n - 1), col.slice(1)
    na, nb = np.asarray(a.is_null(nan_is_null=True)), np.asarray(b.is_null(nan_is_null=True))
    same = np.asarray(pc.fill_null(pc.equal(a, b), False))
    return ~(same | (na & nb))


def first_rows(keys: list[str], n: int, rank: str | None):
    """A mapInArrow function that keeps the first n rows of each run of equal keys, with their rank from 1 in a column
    of that name; state: the last key, a counter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[pa.Array] | None = None
        seen = 0
        for b in batches:
            m = b.num_rows
            if not m:
                continue
            cols = [b.column(b.schema.get_field_index(k)) for k in keys]
            new = np.zeros(m, bool)
            for c in cols:
                new[1:] |= _changes(c)
            new[0] = last is None or any(_changes(pa.concat_arrays([x, c.slice(0, 1)]))[0] for x, c in zip(last, cols, strict=True))
            at = np.arange(m)
            start = np.maximum.accumulate(np.where(new, at, -1))
            r = np.where(start >= 0, at - start, at + seen)
            seen = int(r[-1]) + 1
            last = [c.slice(m - 1, 1) for c in cols]
            keep = pa.array(r < n)
            out = b.filter(keep)
            if rank:
                out = out.append_column(rank, pa.array(r[r < n] + 1, pa.int32()))
            if out.num_rows:
                yield out

    return run


def top_n(df: DataFrame, groups: list[str], order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """The n rows of each group that come first by `order`, with all columns of df and optionally their rank from 1.

    groups: columns; null is a group of its own, as is NaN. order: sort expressions ending in a unique one, by which
    ties are always broken the same way (rows equal in all of them come in any order). Groups with fewer than n rows
    come out whole, an empty df as an empty one. A column of df that is called as `rank` is, is replaced."""
    fits = [*[F.col(g).asc_nulls_first() for g in groups], *order]
    if rank and rank in df.columns:
        df = df.drop(rank)
    near = df.sortWithinPartitions(*fits).mapInArrow(first_rows(groups, n, None), df.schema)
    last = near.repartition(*groups).sortWithinPartitions(*fits)
    if not rank:
        return last.mapInArrow(first_rows(groups, n, None), df.schema)
    return last.mapInArrow(first_rows(groups, n, rank), T.StructType([*df.schema.fields, T.StructField(rank, T.IntegerType())]))


def finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def whole(c: str) -> Column:
    """A finite number as a long; beyond the range of longs the nearest one."""
    x = F.col(c).cast("double")
    return F.when(x >= 2.0**63, F.lit(2**63 - 1)).when(x <= -(2.0**63), F.lit(-(2**63))).otherwise(F.when(F.abs(x) < 2.0**63, x).cast("long"))


def best_of_phylum(signatures: DataFrame, n: int = 5) -> DataFrame:
    """Per finite slot_28 the n rows of highest finite slot_31, ties by smaller sig_id: phylum, sig_id, slot_31, place."""
    rows = signatures.filter(finite("slot_28") & finite("slot_31"))
    rows = rows.select(whole("slot_28").alias("phylum"), "sig_id", "slot_31")
    return top_n(rows, ["phylum"], [F.col("slot_31").desc(), F.col("sig_id").asc()], n, "place")
