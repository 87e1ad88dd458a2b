"""Work along a total order that spans partitions.

A window over one key runs in one task, whatever the key's size. Here the rows are split by ranges of the whole
order instead, so that a key with a third of the rows spreads over many tasks, and each task is given the few
neighbouring rows of other partitions that its calculation looks at. The sorted partitions are kept as compressed
Arrow blocks in a reliable checkpoint: later passes see the same partitions, and a lost executor costs no more than
the partitions it was working on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, partitions


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for b in batches:
        if b.num_rows:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema, options=options) as w:
                w.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for block in b.column(0):
            with pa.ipc.open_stream(block.as_buffer()) as r:
                yield from r


class Ordered:
    """Rows sorted by keys over all partitions, kept in the shared folder."""

    def __init__(self, df: DataFrame, keys: list[str], parts: int | None = None):
        """keys should end in a unique column, otherwise the rows of a repeated key stay in one partition."""
        by = [F.col(k).asc_nulls_first() for k in keys]
        self.schema = df.schema
        parts = parts or partitions(df.sparkSession)
        self.blocks = cut(df.repartitionByRange(parts, *by).sortWithinPartitions(*by).mapInArrow(_blocks, "block binary"))

    def map(self, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
        return self.blocks.mapInArrow(lambda it: f(_rows(it)), schema)

    def edges(self, before: int, after: int) -> dict[int, tuple[pa.Table, pa.Table]]:
        """By partition, the last `before` rows that precede it and the first `after` rows that follow it.

        The driver receives at most before + after rows of each partition: bounded by the partition count, not by the
        data."""

        def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pid = TaskContext.get().partitionId()
            head, tail = None, None
            for b in batches:
                t = pa.Table.from_batches([b])
                if head is None or head.num_rows < after:
                    head = (t if head is None else pa.concat_tables([head, t])).slice(0, after)
                tail = t if tail is None else pa.concat_tables([tail.slice(max(0, tail.num_rows - before)), t])
                tail = tail.slice(max(0, tail.num_rows - before))
            for side, t in ((0, head), (1, tail)):
                if t is not None and t.num_rows:
                    t = t.append_column("_pid", pa.array([pid] * t.num_rows, pa.int32())).append_column("_side", pa.array([side] * t.num_rows, pa.int32()))
                    yield from t.combine_chunks().to_batches()

        got = self.map(ends, T.StructType([*self.schema.fields, T.StructField("_pid", T.IntegerType()), T.StructField("_side", T.IntegerType())])).toArrow()
        pid, side = got["_pid"], got["_side"]
        rows = got.drop_columns(["_pid", "_side"])
        part = {(p, s): rows.filter(pc.and_(pc.equal(pid, p), pc.equal(side, s))) for p in pid.unique().to_pylist() for s in (0, 1)}
        n = self.blocks.rdd.getNumPartitions()
        none = rows.slice(0, 0)
        tails, heads, tail, head = {}, {}, none, none
        for p in range(n):
            tails[p] = tail
            if (p, 1) in part:
                tail = pa.concat_tables([tail, part[p, 1]])
                tail = tail.slice(max(0, tail.num_rows - before))
        for p in reversed(range(n)):
            heads[p] = head
            if (p, 0) in part:
                head = pa.concat_tables([part[p, 0], head]).slice(0, after)
        return {p: (tails[p].combine_chunks(), heads[p].combine_chunks()) for p in range(n)}

    def with_neighbours(self, kernel: Callable[[pa.Table, int, int], pa.Table], schema: T.StructType | str, before: int, after: int) -> DataFrame:
        """kernel over each partition's rows together with `before` rows before and `after` rows behind them.

        kernel(rows, start, stop) gets one Arrow table, whose rows start..stop are the partition's own, and returns
        what it has on those. A partition is held whole; its size is set by the partition count."""
        near = self.edges(before, after)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = pa.Table.from_batches(own) if (own := list(batches)) else None
            if own is not None:
                prev, nxt = near[TaskContext.get().partitionId()]
                t = pa.concat_tables([prev.cast(own.schema), own, nxt.cast(own.schema)]).combine_chunks()
                yield from kernel(t, prev.num_rows, prev.num_rows + own.num_rows).combine_chunks().to_batches(max_chunksize=20000)

        return self.map(run, schema)
