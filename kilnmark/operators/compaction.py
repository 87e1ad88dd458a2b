"""Problem 4: many tiny Parquet files into few well-sized ones, by copying encoded column blocks.

Files of one directory and schema are packed into bins of a target size; a task per bin appends the files' column
chunks byte by byte to one larger file and writes a new footer with moved offsets, so that no value is decoded. Each
new file is opened again and its schema, row groups, column chunks and rows are compared with the sums of its sources.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.instants import instant
from ..session import cut, qualified, removed, work_path
from ..sources import footers

TARGET = 128 << 20  # bytes of a well-sized file
BROADCAST_IDS = 500_000  # ids of rows to leave out that may be sent to all tasks, some 30 bytes each


PIECE = 8 << 20  # bytes copied at a time


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a full URI, as Spark qualifies it (see session.qualified); what is no URI is refused,
    since each executor would take it for its own disk."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        raise ValueError(f"{uri} names no file system")
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def read_footer(f: pa.NativeFile) -> list:
    """The footer of an open Parquet file, from its end alone."""
    n = f.size()
    f.seek(max(n - 8, 0))
    tail = f.read(8)
    if tail[4:] != footers.MAGIC:
        raise ValueError("no Parquet file")
    k = int.from_bytes(tail[:4], "little")
    f.seek(n - 8 - k)
    return footers.Reader(f.read(k)).struct()


def copied(f: pa.NativeFile, out: pa.NativeFile, start: int, stop: int) -> None:
    f.seek(start)
    while start < stop:
        piece = f.read(min(PIECE, stop - start))
        if not piece:
            raise ValueError("the file ends within its blocks")
        out.write(piece)
        start += len(piece)


def merge_files(paths: list[str], target: str) -> dict:
    """Appends the blocks of all paths (URIs), which must share a schema, to a new file at target and checks it.

    A file is copied piece by piece, so its size doesn't matter. Written under a passing name and moved into place at the end, so a repeated task attempt leaves one whole file."""
    fs, out_path = _fs(target)
    fs.create_dir(out_path.rpartition("/")[0], recursive=True)
    passing = f"{out_path.rpartition('/')[0]}/_{uuid.uuid4().hex}.tmp"
    groups, rows, first, at = [], 0, None, 4
    with fs.open_output_stream(passing) as out:
        out.write(footers.MAGIC)
        for p in paths:
            src, name = _fs(p)
            with src.open_input_file(name) as f:
                meta = read_footer(f)
                if first is None:
                    first = meta
                elif footers.shape(meta) != footers.shape(first):
                    raise ValueError(f"{p} has another schema than {paths[0]}")
                end = footers.body_end(meta)
                rows += footers.field(meta, footers.FILE_ROWS)
                groups += footers.moved(meta, at - 4)
                copied(f, out, 4, end)
            at += end - 4
        new = [[f[0], f[1], rows if f[0] == footers.FILE_ROWS else (footers.STRUCT, groups) if f[0] == footers.FILE_GROUPS else f[2]] for f in first]
        tail = bytearray()
        footers.write_value(footers.STRUCT, new, tail)
        out.write(bytes(tail))
        out.write(len(tail).to_bytes(4, "little") + footers.MAGIC)
    with fs.open_input_file(passing) as f:
        got = pq.ParquetFile(f).metadata
        blocks = sum(got.row_group(g).num_columns for g in range(got.num_row_groups))
        in_groups = sum(got.row_group(g).num_rows for g in range(got.num_row_groups))
    wanted = sum(len(footers.field(g, footers.GROUP_CHUNKS)[1]) for g in groups)
    if (got.num_rows, in_groups, got.num_row_groups, blocks) != (rows, rows, len(groups), wanted):
        raise ValueError(f"{target}: rows, row groups or blocks differ from those of its sources")
    fs.move(passing, out_path)
    return {"path": target, "files": len(paths), "rows": rows, "row_groups": len(groups), "blocks": blocks, "bytes": at + len(tail) + 8}


def listing(spark: SparkSession, source: str) -> DataFrame:
    """path (URI) and length of all Parquet files below source, hidden ones left out.

    Folders are listed by tasks, level by level, so that names of files never gather on the driver, nor do those of
    folders but for one look a level whether there are more."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for uri in pdf["path"]:
                fs, name = _fs(uri)
                scheme = uri[: len(uri) - len(name)] if uri.endswith(name) else uri[: uri.index(":") + 1]
                found = [f for f in fs.get_file_info(pafs.FileSelector(name, allow_not_found=True)) if not f.base_name.startswith(("_", "."))]
                found = [f for f in found if f.type == pafs.FileType.Directory or f.base_name.endswith(".parquet")]
                yield pd.DataFrame({"path": [f"{scheme}{f.path}" for f in found], "length": [-1 if f.type == pafs.FileType.Directory else f.size for f in found]}).astype({"path": object, "length": "int64"})

    level = spark.createDataFrame([(source,)], "path string")
    files = None
    while True:
        seen = cut(level.repartition(max(1, spark.sparkContext.defaultParallelism)).mapInPandas(look, "path string, length long"))
        here = seen.filter("length >= 0")
        files = here if files is None else files.unionAll(here)
        level = seen.filter("length < 0").select("path")
        if level.isEmpty():
            return files


def footer_bounds(spark: SparkSession, files: list[str], column: str) -> DataFrame | None:
    """n, low, high: the rows of some Parquet files and the bounds of an instant column, read from footers alone.

    One task reads a few footers each. None if a row group with values keeps no statistics of the column; bounds are
    null where there are no values."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for uri in pdf["path"]:
                fs, name = _fs(unquote(uri))
                with fs.open_input_file(name) as f:
                    meta = pq.ParquetFile(f).metadata
                at = next(i for i in range(meta.num_columns) if meta.schema.column(i).path == column)
                for g in range(meta.num_row_groups):
                    own, seen = meta.row_group(g), meta.row_group(g).column(at).statistics
                    empty = seen is not None and seen.has_null_count and seen.null_count == own.num_rows
                    known = seen is not None and seen.has_min_max
                    rows.append((own.num_rows, known or empty or not own.num_rows, seen.min if known else None, seen.max if known else None))
            out = pd.DataFrame(rows, columns=["n", "known", "low", "high"])
            for c in ("low", "high"):
                out[c] = pd.to_datetime(out[c], utc=True)
            yield out

    paths = spark.createDataFrame([(f,) for f in files], "path string").repartition(max(1, min(len(files), spark.sparkContext.defaultParallelism)))
    seen = cut(paths.mapInPandas(look, "n long, known boolean, low timestamp, high timestamp"))
    if not seen.filter("not known").isEmpty():
        return None
    return seen.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def compact(spark: SparkSession, source: str, target: str, size: int = TARGET) -> DataFrame:
    """Merges all Parquet files below source into files of about `size` bytes below target, directory by directory.

    Returns the merged files: path, files (merged into it), rows, row_groups, blocks, bytes, checked as written. Files
    with different schemas in one directory go to different files; files without rows add their schema only. A single
    large file comes out as a file of its own. An empty source gives an empty result. Running it again writes the same
    files again. Only names and sizes of files pass through the plan, one row a file. Paths are resolved as Spark
    resolves them, and files are opened through that file system; one that this build of pyarrow can't reach is an
    error."""
    source, target = qualified(spark, source), qualified(spark, target)

    def shapes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for pdf in batches:
            kinds = []
            for p in pdf["path"]:
                fs, name = _fs(p)
                with fs.open_input_file(name) as f:
                    kinds.append(hashlib.sha256(footers.shape(read_footer(f))).hexdigest()[:16])
            yield pdf.assign(kind=kinds)

    files = listing(spark, source).repartition(max(1, spark.sparkContext.defaultParallelism)).mapInPandas(shapes, "path string, length long, kind string")
    files = files.withColumn("dir", F.regexp_replace("path", r"/[^/]*$", ""))
    upto = F.sum("length").over(Window.partitionBy("dir", "kind").orderBy("path").rowsBetween(Window.unboundedPreceding, -1))
    files = files.withColumn("bin", F.expr("0L") + F.floor(F.coalesce(upto, F.lit(0)) / F.lit(size)).cast("long"))
    base = "/" + _fs(source)[1].strip("/") + "/"

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        below = (_fs(key[0])[1] + "/")[len(base) :]
        return pd.DataFrame([merge_files(sorted(pdf["path"]), f"{target.rstrip('/')}/{below}part-{key[1]}-{key[2]:05d}.parquet")])

    return cut(files.groupBy("dir", "kind", "bin").applyInPandas(merge, "path string, files long, rows long, row_groups long, blocks long, bytes long"))


def duplicates(signatures: DataFrame) -> DataFrame:
    """sig_id, keeper of all stored rows that share symbol, interval and instant with another row.

    The keeper is the row ingested last, of those the one with the largest sig_id. A null or unreadable timestamp
    matches nothing, nor does a null symbol or interval."""
    key = ["symbol", "interval", "at"]
    narrow = signatures.select("sig_id", "symbol", "interval", instant(F.col("timestamp")).alias("at"), "ingested_at").dropna(subset=key)
    kinds = narrow.groupBy(*key).agg(F.max_by("sig_id", F.struct("ingested_at", "sig_id")).alias("keeper"), F.count("*").alias("n")).filter("n > 1")
    return narrow.join(kinds, key).select("sig_id", "keeper")


def compact_signatures(signatures: DataFrame, files: DataFrame, target: str, size: int = TARGET) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stores every signature once, in few files per year and month of its instant, below target.

    Returns what was merged (see compact), the duplicates left out (sig_id, keeper) and the stored table. Rows without
    an instant are all kept, under the year and month of their file's path, or else under unknown. The rows are
    written by the tasks that read them, without a shuffle, which leaves a small file per task and month; these are
    then merged by blocks. Raises if rows were lost or doubled."""
    spark = signatures.sparkSession
    doubles = cut(duplicates(signatures))
    left_out = doubles.filter("sig_id <> keeper").select("sig_id").distinct()
    lost = left_out.count()
    kept = signatures.drop("year", "month").join(F.broadcast(left_out) if lost <= BROADCAST_IDS else left_out, "sig_id", "left_anti")
    at = instant(F.col("timestamp"))
    timed = kept.filter(at.isNotNull()).withColumn("year", F.date_format(at, "yyyy")).withColumn("month", F.date_format(at, "MM"))
    of = lambda k: F.regexp_extract("path", rf"{k}=(\d+)", 1)
    named = files.groupBy("file_id").agg(F.min("path").alias("path")).select("file_id", of("year").alias("year"), of("month").alias("month"))
    untimed = kept.filter(at.isNull()).join(named, "file_id", "left")
    for c in ("year", "month"):
        untimed = untimed.withColumn(c, F.when(F.col(c) != "", F.col(c)).otherwise("unknown"))
    small = work_path(spark, "small-files")
    timed.unionByName(untimed).write.partitionBy("year", "month").parquet(small)
    merged = compact(spark, small, target, size)
    removed(spark, small)
    total = signatures.count()
    rows = merged.agg(F.sum("rows")).first()[0] or 0
    if rows != total - lost:
        raise ValueError(f"{total} rows, {lost} of them doubles, but {rows} were stored")
    schema = timed.schema
    stored = spark.read.schema(schema).option("basePath", target).parquet(target) if rows else spark.createDataFrame([], schema)
    return merged, doubles, stored


def stored_twice(signatures: DataFrame, files: DataFrame) -> DataFrame:
    """sig_id_a < sig_id_b: all pairs of rows of which compaction keeps at most one, their keeper being stored."""
    _, doubles, stored = compact_signatures(signatures, files, work_path(signatures.sparkSession, "compacted"))
    keepers = stored.select(F.col("sig_id").alias("keeper")).join(doubles.select("keeper").distinct(), "keeper", "left_semi")
    once = doubles.join(keepers.groupBy("keeper").count().filter("count = 1").select("keeper"), "keeper")
    a, b = once.select("keeper", F.col("sig_id").alias("sig_id_a")), once.select("keeper", F.col("sig_id").alias("sig_id_b"))
    return a.join(b, "keeper").filter("sig_id_a < sig_id_b").select("sig_id_a", "sig_id_b")
