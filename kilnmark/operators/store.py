"""The signature archive on disk: partitioned storing, one view over it, single-file form, labels, manifests, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def store_batch(df: DataFrame, path: str, quality: str = "quality", least: float = 0.0, ts: str = "ts", replace: bool = True) -> None:
    """Writes the rows of at least that quality below path by year, month and symbol.

    With replace, only the partitions that df has rows of are written anew, so storing the same shard again changes
    nothing; without, rows are added. Rows without instant or quality aren't stored."""
    rows = df.filter((F.col(quality) >= least) & F.col(ts).isNotNull()).withColumns({"year": F.date_format(ts, "yyyy"), "month": F.date_format(ts, "MM")})
    w = rows.write.partitionBy("year", "month", "symbol").mode("overwrite" if replace else "append")
    w.option("partitionOverwriteMode", "dynamic").option("compression", "snappy").parquet(path)


def archive_view(spark: SparkSession, name: str, tree: str, single: str | None = None) -> DataFrame:
    """A temporary view over the single-file form if there is one, else over the partitioned tree."""
    df = None
    if single:
        try:
            df = spark.read.parquet(single)
        except Exception as e:  # noqa: BLE001 - any unreadable path means that there is no single-file form
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
    df = spark.read.parquet(tree) if df is None else df
    df.createOrReplaceTempView(name)
    return df


def deduplicated(df: DataFrame, keys: list[str], newest: list[str]) -> DataFrame:
    """One row per key, the newest; combines before the shuffle, so that a hot key spreads."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*newest)).alias("_r")).select(*keys, "_r.*")


def to_files(df: DataFrame, path: str, files: int = 1, compression: str = "zstd") -> None:
    df.repartition(files).write.mode("overwrite").option("compression", compression).parquet(path)


def relabelled(archive: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """archive with `label` taken from labels where these have the key; all other rows and values stay."""
    new = labels.select(F.col(key).alias("_k"), F.col(label).alias("_l"), F.lit(True).alias("_has"))
    out = archive.join(new, F.col(key) == F.col("_k"), "left")
    return out.select(*[F.when(F.col("_has"), F.col("_l")).otherwise(F.col(c)).alias(c) if c == label else F.col(c) for c in archive.columns])


def shard_key(start: Column, end: Column) -> Column:
    f = "yyyy-MM-dd HH:mm:ss"
    return F.concat_ws("_", F.date_format(start, f), F.date_format(end, f))


def shard_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def pending(shards: DataFrame, manifest: DataFrame, key: str, digest: str) -> DataFrame:
    """Shards that the manifest doesn't have under the same key and hash: new ones and such whose inputs changed."""
    return shards.join(manifest.select(key, digest).distinct(), [key, digest], "left_anti")


def months(first: str, last: str, spark: SparkSession) -> DataFrame:
    """start, end of every month from first to last (dates), half-open."""
    s = spark.range(1).select(F.explode(F.sequence(F.date_trunc("month", F.lit(first).cast("timestamp")), F.date_trunc("month", F.lit(last).cast("timestamp")), F.expr("interval 1 month"))).alias("start"))
    return s.withColumn("end", F.col("start") + F.expr("interval 1 month"))


def markdown(title: str, df: DataFrame, most: int = 200) -> str:
    """A small result as a Markdown table; `most` bounds what reaches the driver, larger ones end with a note."""
    rows = df.limit(most + 1).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    body = "\n".join("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows[:most])
    return f"## {title}\n\n{head}\n{body}\n" + ("\nMore rows follow.\n" if len(rows) > most else "")
