"""Small queries: trims, slices, conditional values, row-wise means, shard plans, single rows, funding pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import store
from ..operators.blocks import IDX, positions
from ..session import table, work_path
from ..sources import klines
from .common import Registry, bars, no_minus_zero, r6, sigs, sql, us
from .series import _US, RET, unique_sigs

q = Registry()


@q("pred11_date_window", sql("select sig_id from sigs where ts >= timestamp '2015-05-01' and ts < timestamp '2015-09-01'"))
def pred11(spark, sf_dir):
    s = sigs(spark, sf_dir)
    return s.filter((F.col("ts") >= F.lit("2015-05-01").cast("timestamp")) & (F.col("ts") < F.lit("2015-09-01").cast("timestamp"))).select("sig_id")


@q("pred12_end_trim", "select bar_id from ohlcv where datetime <= timestamptz '2015-08-01 00:00:00+00'")
def pred12(spark, sf_dir):
    return table(spark, sf_dir, "ohlcv").filter(F.col("datetime") <= F.lit("2015-08-01").cast("timestamp")).select("bar_id")


@q("pred14_conditional", sql('select symbol, ts_us, case when "close" >= "open" then volume else 0.0 end as up_volume from bars'))
def pred14(spark, sf_dir):
    return bars(spark, sf_dir).select("symbol", us("ts").alias("ts_us"), F.when(F.col("close") >= F.col("open"), F.col("volume")).otherwise(0.0).alias("up_volume"))


@q("pred19_positional_slice", sql("select symbol, ts_us, cast(idx as bigint) as bar_idx from b where idx >= 100 and idx < 200", RET))
def pred19(spark, sf_dir):
    return positions(bars(spark, sf_dir), "symbol", ["ts"]).filter(F.col(IDX).between(100, 199)).select("symbol", us("ts").alias("ts_us"), IDX)


@q("j11_row_means", sql("select sig_id, round((coalesce(slot_00, 0) + coalesce(slot_01, 0) + coalesce(slot_02, 0)) / nullif((slot_00 is not null)::int + (slot_01 is not null)::int + (slot_02 is not null)::int, 0), 6) as mean, least(slot_00, slot_01, slot_02) as least_slot from sigs where slot_00 is not null"))
def j11(spark, sf_dir):
    """Mean and least of columns of one row, nulls skipped."""
    held = F.filter(F.array("slot_00", "slot_01", "slot_02"), lambda x: x.isNotNull())
    mean = F.aggregate(held, F.lit(0.0), lambda a, x: a + x) / F.size(held)
    return sigs(spark, sf_dir).filter("slot_00 is not null").select("sig_id", r6(mean).alias("mean"), F.least("slot_00", "slot_01", "slot_02").alias("least_slot"))


@q("o01_sorted_series", sql('select symbol, ts_us, cast(row_number() over (partition by symbol order by ts) - 1 as bigint) as bar_idx from bars'))
def o01(spark, sf_dir):
    """A total order over all partitions, as positions."""
    return positions(bars(spark, sf_dir), "symbol", ["ts"]).select("symbol", us("ts").alias("ts_us"), IDX)


@q("o10_head", sql("select sig_id from sigs order by sig_id limit 50"))
def o10(spark, sf_dir):
    return sigs(spark, sf_dir).select("sig_id").orderBy("sig_id").limit(50)


@q("s03_last_day", "select cast(date '2016-01-31' as date) as day")
def s03(spark, sf_dir):
    """The configured end date; without one it is yesterday in UTC."""
    return spark.range(1).select(B.last_complete_day(F.lit("2016-01-31").cast("date")).alias("day"))


@q("s05_retry_after", "select header, greatest(0.0, coalesce(try_cast(header as double), epoch(try_strptime(header, '%a, %d %b %Y %H:%M:%S GMT')), 1.0)) as seconds from (values ('7'), ('2.5'), ('Thu, 01 Jan 1970 00:00:30 GMT'), ('soon'), ('-4')) t(header)")
def s05(spark, sf_dir):
    return spark.createDataFrame([(t, klines.retry_after(t, 0.0)) for t in ("7", "2.5", "Thu, 01 Jan 1970 00:00:30 GMT", "soon", "-4")], "header string, seconds double")


@q("s07_funding_pages", "select symbol, funding_time, funding_rate from funding where funding_time is not null and funding_rate is not null")
def s07(spark, sf_dir):
    """Funding rates by way of the page source: the rate in the place of the open."""
    f = table(spark, sf_dir, "funding").filter("funding_time is not null and funding_rate is not null")
    page = f.select("symbol", F.floor(F.col("funding_time") / 864_000_000_0).alias("page"), F.array(F.col("funding_time").cast("string"), F.col("funding_rate").cast("string")).alias("r"))
    path = work_path(spark, "funding-pages")
    page.groupBy("symbol", "page").agg(F.collect_list("r").alias("rows")).select(F.to_json(F.struct("symbol", "rows")).alias("value")).write.text(path)
    spark.dataSource.register(klines.KlineSource)
    return spark.read.format("kline_pages").load(path).select("symbol", F.col("open_time").alias("funding_time"), F.col("open").alias("funding_rate"))


@q("s11_many_files", sql("select symbol, count(*) as n from us group by symbol", _US))
def s11(spark, sf_dir):
    """A tree of files read as one table, whatever its folders are called."""
    path = work_path(spark, "tree")
    s = unique_sigs(spark, sf_dir).select("sig_id", "symbol", F.pmod(F.col("sig_id"), F.lit(3)).alias("k"))
    for k in range(3):
        s.filter(F.col("k") == k).drop("k").write.parquet(f"{path}/folder {k}/deeper")
    return spark.read.option("recursiveFileLookup", "true").parquet(path).groupBy("symbol").agg(F.count("*").alias("n"))


@q("s19_single_rows", sql("select max(sig_id) as sig_id from us where quality >= 0.0", _US))
def s19(spark, sf_dir):
    """The newest row stored by itself, the degenerate batch, through gate and partition fields."""
    path = work_path(spark, "single-row")
    s = unique_sigs(spark, sf_dir).filter("quality >= 0.0")
    newest = s.agg(F.max("sig_id")).first()[0]
    store.store_batch(s.filter(F.col("sig_id") == F.lit(newest)), path, replace=False)
    return spark.read.parquet(path).select("sig_id")


@q("x05_shard_plan", "select symbol, epoch_us(a) as start_us, epoch_us(least(a + interval 15 days, z)) as stop_us from (select symbol, unnest(generate_series(date_trunc('day', lo), hi, interval 15 days)) as a, hi as z from (select symbol, min(cast(datetime as timestamp)) as lo, max(cast(datetime as timestamp)) + interval 1 second as hi from ohlcv where datetime >= timestamptz '2014-01-01 00:00:00+00' group by symbol) t) u where a < z")
def x05(spark, sf_dir):
    """Fifteen-day shards over each symbol's span."""
    t = table(spark, sf_dir, "ohlcv").filter(F.col("datetime") >= F.lit("2014-01-01").cast("timestamp"))
    e = t.groupBy("symbol").agg(F.min("datetime").cast("timestamp").alias("lo"), (F.max("datetime").cast("timestamp") + F.expr("interval 1 second")).alias("z"))
    s = e.select("symbol", "z", F.explode(F.sequence(F.date_trunc("day", "lo"), F.col("z"), F.expr("interval 15 days"))).alias("a")).filter("a < z")
    return s.select("symbol", us("a").alias("start_us"), us(F.least(F.col("a") + F.expr("interval 15 days"), F.col("z"))).alias("stop_us"))
