"""Queries that write and read: partitioned archive, views, single files, text formats, manifests, hashes."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from .. import config
from ..operators import store
from ..operators.compaction import footer_bounds
from ..session import table, work_path
from ..sources.klines import KlineSource
from .common import Registry, bars, no_minus_zero, r6, sigs, sql, us
from .series import _US, unique_sigs

q = Registry()


def _stored(spark, sf_dir):
    path = work_path(spark, "archive")
    store.store_batch(unique_sigs(spark, sf_dir), path, least=0.0)
    return path


_GATED = "g as (select * from us where quality >= 0.0)"


@q("s12_partition_scan", sql("select sig_id from g where strftime(ts, '%Y') = '2015' and strftime(ts, '%m') = '08'", _US, _GATED))
def s12(spark, sf_dir):
    """One month of the partitioned archive; only its folders are read."""
    return spark.read.parquet(_stored(spark, sf_dir)).filter("year = 2015 and month = 8").select("sig_id")


@q("s13_archive_view", sql("select symbol, count(*) as n from g group by symbol", _US, _GATED))
def s13(spark, sf_dir):
    tree = _stored(spark, sf_dir)
    store.archive_view(spark, "signature_archive", tree, tree + "-single")
    return spark.sql("select symbol, count(*) as n from signature_archive group by symbol")


@q("s15_bounds", "select count(*) as n, epoch_us(min(datetime)) as first_us, epoch_us(max(datetime)) as last_us from ohlcv")
def s15(spark, sf_dir):
    """Row count and first and last instant from the files' footers; from the rows if a footer doesn't tell."""
    t = table(spark, sf_dir, "ohlcv")
    got = footer_bounds(spark, t.inputFiles(), "datetime")
    if got is None:
        return t.agg(F.count("*").alias("n"), us(F.min("datetime")).alias("first_us"), us(F.max("datetime")).alias("last_us"))
    return got.select("n", us("low").alias("first_us"), us("high").alias("last_us"))


@q("s16_projected_count", "select count(*) as n, count(\"timestamp\") as with_time from signatures")
def s16(spark, sf_dir):
    return table(spark, sf_dir, "signatures").agg(F.count("*").alias("n"), F.count("timestamp").alias("with_time"))


@q("s17_catalog", f"""select column_name as col_name, case column_type when 'BIGINT' then 'bigint' when 'VARCHAR' then 'string' when 'DOUBLE' then 'double' when 'BOOLEAN' then 'boolean' else lower(split_part(column_type, ' ', 1)) end as data_type
from (describe {sql('select * from sigs')})""")
def s17(spark, sf_dir):
    """Columns and types of the archive view, as the catalog describes them."""
    sigs(spark, sf_dir).createOrReplaceTempView("described_signatures")
    return spark.sql("describe described_signatures").select("col_name", "data_type")


@q("s18_partition_counts", sql("select cast(strftime(ts, '%Y') as integer) as year, cast(strftime(ts, '%m') as integer) as month, symbol, count(*) as n from g group by 1, 2, 3", _US, _GATED))
def s18(spark, sf_dir):
    """Stored twice over: the second time replaces the same partitions."""
    path = _stored(spark, sf_dir)
    store.store_batch(unique_sigs(spark, sf_dir), path, least=0.0)
    return spark.read.parquet(path).groupBy("year", "month", "symbol").agg(F.count("*").alias("n"))


@q("s20_appended_twice", sql("select 2 * count(*) as n from g", _US, _GATED))
def s20(spark, sf_dir):
    path = _stored(spark, sf_dir)
    store.store_batch(unique_sigs(spark, sf_dir), path, least=0.0, replace=False)
    return spark.read.parquet(path).agg(F.count("*").alias("n"))


@q("s21_single_file", sql("select sig_id, quality from us", _US))
def s21(spark, sf_dir):
    """All signatures once, in one zstd file."""
    path = work_path(spark, "single")
    s = sigs(spark, sf_dir).filter("ts is not null and symbol is not null and iv is not null")
    store.to_files(store.deduplicated(s, ["symbol", "iv", "ts"], ["ingested_at", "sig_id"]), path)
    return spark.read.parquet(path).select("sig_id", "quality")


@q("s22_relabelled", sql("select sig_id, case when symbol like 'A%' then cast(sig_id % 7 as double) else phylum end as phylum from us", _US))
def s22(spark, sf_dir):
    """Labels for some symbols' rows; the archive keeps all others."""
    s = unique_sigs(spark, sf_dir).select("sig_id", "symbol", "phylum")
    labels = s.filter("symbol like 'A%'").select("sig_id", (F.col("sig_id") % 7).cast("double").alias("phylum"))
    return store.relabelled(s, labels, "sig_id", "phylum").select("sig_id", "phylum")


@q("s23_csv", sql("select sig_id, symbol, round(quality, 6) as quality from us", _US))
def s23(spark, sf_dir):
    path = work_path(spark, "csv")
    unique_sigs(spark, sf_dir).select("sig_id", "symbol", "quality").write.csv(path, header=True)
    return spark.read.csv(path, header=True, schema="sig_id long, symbol string, quality double").withColumn("quality", r6("quality"))


@q("s24_json", sql("select symbol, count(*) as n, round(avg(rf), 4) as recovery from us group by symbol", _US))
def s24(spark, sf_dir):
    """Run metrics as JSON lines and back."""
    path = work_path(spark, "json")
    unique_sigs(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n"), F.avg("rf").alias("recovery")).write.json(path)
    return spark.read.json(path, schema="symbol string, n long, recovery double").withColumn("recovery", r6("recovery", 4))


@q("s25_prior_audit")
def s25(spark, sf_dir):
    """Derived priors with how they came about, one JSON object per symbol."""
    from .evaluation import m07p

    p = m07p(spark, sf_dir).groupBy("symbol").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("prior", "x")))).alias("priors"))
    return p.select("symbol", F.to_json(F.struct("priors", F.struct(F.lit("percentile").alias("method")).alias("_audit"))).alias("audit"))


_MONTHS = "mo as (select m as start, m + interval 1 month as stop from generate_series(timestamp '2015-01-01', timestamp '2016-02-01', interval 1 month) g(m))"


@q("s26_pending_months", sql("select epoch_us(start) as start_us from mo where not exists (select 1 from mining_shards s where s.status = 'done' and s.shard_end > start and s.shard_start < stop)", _MONTHS))
def s26(spark, sf_dir):
    """Months in which nothing was finished."""
    done = table(spark, sf_dir, "mining_shards").filter("status = 'done' and shard_end > shard_start")
    touched = done.select(F.explode(F.sequence(F.date_trunc("month", F.col("shard_start").cast("timestamp")), F.date_trunc("month", F.col("shard_end").cast("timestamp") - F.expr("interval 1 microsecond")), F.expr("interval 1 month"))).alias("start")).distinct()
    return store.months("2015-01-01", "2016-02-01", spark).join(touched, "start", "left_anti").select(us("start").alias("start_us"))


@q("j09_pending_shards", "select shard_id from mining_shards where status is distinct from 'done'")
def j09(spark, sf_dir):
    shards = table(spark, sf_dir, "mining_shards")
    return shards.join(shards.filter("status = 'done'").select("shard_id"), "shard_id", "left_anti").select("shard_id")


@q("j10_hash_checked", "select shard_id from mining_shards where not (shard_id % 3 = 0)")
def j10(spark, sf_dir):
    """Shards to mine again where the manifest's hash differs from what the inputs hash to now."""
    s = table(spark, sf_dir, "mining_shards").select("shard_id", store.shard_key(F.col("shard_start"), F.col("shard_end")).alias("k"), "symbol")
    s = s.withColumn("key", F.concat_ws("/", F.col("symbol"), F.col("k"), F.col("shard_id").cast("string"))).withColumn("digest", store.shard_hash(F.col("key"), F.lit("settings")))
    manifest = s.withColumn("digest", F.when(F.col("shard_id") % 3 == 0, F.col("digest")).otherwise(store.shard_hash(F.col("key"), F.lit("old settings"))))
    return store.pending(s, manifest, "key", "digest").select("shard_id")


@q("s27_report")
def s27(spark, sf_dir):
    """The archive's summary page, line by line."""
    from . import archive

    text = store.markdown("Quality tiers", archive.a07(spark, sf_dir).orderBy("tier")) + "\n" + store.markdown("Months", archive.a08(spark, sf_dir).orderBy("month"))
    return spark.createDataFrame([(i, line) for i, line in enumerate(text.split("\n"))], "line int, text string")


SAMPLE_CONFIG = """
features:
  interval: "5m"          # of the bars
  slots: ["slot_00", "slot_01"]
  slot_00: {lookback: 24, threshold: 0.05, kind: "absorb, signed"}
archive:
  partition_by:
    - year
    - month
  least_quality: 0.0
  note: null
"""


# What the sample says, by key, as JSON.
@q("s28_config", """select * from (values ('features.interval', '"5m"'), ('features.slots', '["slot_00", "slot_01"]'), ('features.slot_00.lookback', '24'), ('features.slot_00.threshold', '0.05'), ('features.slot_00.kind', '"absorb, signed"'),
('archive.partition_by', '["year", "month"]'), ('archive.least_quality', '0.0'), ('archive.note', 'null')) t(key, value)""")
def s28(spark, sf_dir):
    got = config.flat(config.parse(SAMPLE_CONFIG))
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in sorted(got.items())], "key string, value string")


@q("s29_row_hash", no_minus_zero("select bar_id, sha256(symbol || '|' || \"interval\" || '|' || cast(epoch_us(received_at) as varchar)) as digest from ohlcv"))
def s29(spark, sf_dir):
    return table(spark, sf_dir, "ohlcv").select("bar_id", store.shard_hash(F.col("symbol"), F.col("interval"), us("received_at").cast("string")).alias("digest"))


@q("s30_files", "select count(*) as rows_found from signature_files")
def s30(spark, sf_dir):
    """Rows of a table by way of its files' metadata."""
    t = table(spark, sf_dir, "signature_files")
    by = t.select("*", "_metadata.file_name", "_metadata.file_size").groupBy("file_name").agg(F.count("*").alias("n"), F.max("file_size").alias("bytes"))
    return by.filter("bytes > 0").agg(F.sum("n").alias("rows_found"))


@q("s04_kline_pages", "select symbol, cast(floor(epoch_us(datetime) / 1000) as bigint) as open_time, \"close\" from ohlcv where datetime is not null and \"close\" is not null and isfinite(\"close\")")
def s04(spark, sf_dir):
    """Candles written as pages of arrays, read back by the data source."""
    from pyspark.sql import Window

    t = table(spark, sf_dir, "ohlcv").filter("datetime is not null and close is not null and not isnan(close) and abs(close) < double('Infinity')")
    row = F.array(F.floor(us("datetime") / 1000).cast("string"), *[F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c).cast("string")) for c in ("open", "high", "low", "close", "volume")])
    page = t.select("symbol", F.floor(F.col("bar_id") / 1000).alias("page"), row.alias("r")).groupBy("symbol", "page").agg(F.collect_list("r").alias("rows"))
    path = work_path(spark, "pages")
    page.select(F.to_json(F.struct("symbol", "rows")).alias("value")).write.text(path)
    spark.dataSource.register(KlineSource)
    return spark.read.format("kline_pages").load(path).select("symbol", "open_time", "close")
