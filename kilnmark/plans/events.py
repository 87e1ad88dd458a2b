"""Queries over ticks and streams, and of the conviction gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import slots as S
from ..operators import bars as B
from ..operators import conviction as C
from ..operators import windows as W
from ..operators.blocks import along, core, positions, with_halo
from ..session import table
from ..streaming import flows
from .common import Registry, bars, no_minus_zero, r6, sql, us
from .series import _US, RET, _gate, _r, _w, unique_sigs

q = Registry()

_TB = """tb as (select event_type as symbol, time_bucket(interval 1 hour, ts) as hour, arg_min("value", (ts, event_id)) as "open", max("value") as "high", min("value") as "low", arg_max("value", (ts, event_id)) as "close", count(*) as trades from events group by 1, 2)"""
_HOUR = "epoch_us(hour)"


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.tick_bars(table(spark, sf_dir, "events"), "event_type", "ts", "value", "event_id")


_TICK_BARS = """select symbol, epoch_us(hour) as ts_us, o as "open", h as "high", l as "low", c as "close", n as trades from (
 select event_type as symbol, date_trunc('hour', ts) as hour, max("value") as h, min("value") as l, count(*) as n,
  max(case when ka = 1 then "value" end) as o, max(case when kz = 1 then "value" end) as c from (
   select *, row_number() over (partition by event_type, date_trunc('hour', ts) order by ts, event_id) as ka, row_number() over (partition by event_type, date_trunc('hour', ts) order by ts desc, event_id desc) as kz from events) t group by 1, 2) u"""


@q("t02_tick_bars", _TICK_BARS)
def t02(spark, sf_dir):
    return event_bars(spark, sf_dir).select("symbol", us("ts").alias("ts_us"), "open", "high", "low", "close", "trades")


@q("t02_stream_bars", f"select * from ({_TICK_BARS}) b where ts_us + 3600000000 <= (select epoch_us(max(ts)) - 600000000 from events)")
def t02s(spark, sf_dir):
    """The same bars from a stream, without the hours that the watermark hasn't passed."""
    ticks = flows.stream_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    got = flows.drained(flows.tick_bars(ticks, "event_type", "ts", "value", "event_id"), "stream-bars")
    return got.select("symbol", us("ts").alias("ts_us"), "open", "high", "low", "close", "trades")


@q("t01_stream_once", "select symbol, count(distinct datetime) as n from ohlcv where datetime is not null group by symbol")
def t01(spark, sf_dir):
    """Bars of a stream, each symbol and instant once."""
    rows = flows.stream_table(spark, sf_dir, "ohlcv").withColumn("ts", F.col("datetime").cast("timestamp")).filter("ts is not null").select("symbol", "ts")
    return flows.drained(flows.once(rows, ["symbol", "ts"], "ts", "36500 days"), "once").groupBy("symbol").agg(F.count("*").alias("n"))


_SEEN = """
with e as (select event_type as key, epoch_us(ts) / 1e6 as seconds, value, row_number() over w as i, lag(epoch_us(ts) / 1e6) over w as before from events window w as (partition by event_type order by epoch_us(ts), value))
select a.key, a.seconds, count(b.i) as seen, round(coalesce(count(b.i) filter (b.value <= a.value) / nullif(count(b.i), 0)::double, any_value(a.value)), 6) + 0.0 as share
from e a left join e b on b.key = a.key and b.i < a.i and b.seconds >= a.before - 604800 group by a.key, a.seconds, a.i"""


@q("t03_stream_buffer", _SEEN)
def t03(spark, sf_dir):
    """Rank of every event's value in its type's week before, kept as state by type."""
    rows = flows.stream_table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), (us("ts") / 1e6).alias("seconds"), "value")
    return flows.drained(flows.buffer_ranks(rows, "key", "seconds", "value", C.WEEK), "buffer").select("key", "seconds", "seen", r6("share").alias("share"))


@q("t05_stream_once_each_batch", "select event_type, count(*) as n from events group by event_type")
def t05(spark, sf_dir):
    """Events by way of a sink that repeats a broken micro-batch without doubling it."""
    from ..session import work_path

    out, state = work_path(spark, "batches"), work_path(spark, "batches-state")
    stream = flows.stream_table(spark, sf_dir, "events")
    flows.into_folder(stream, out, state)
    flows.into_folder(stream, out, state)
    return spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"))


@q("t06_stream_outcomes", sql('select symbol, ts_us, top, bottom from (select *, count(*) over x as ahead, max("high") over x as top, min("low") over x as bottom from bars window x as (partition by symbol order by ts rows between 1 following and 24 following)) t where ahead = 24'))
def t06(spark, sf_dir):
    """Forward extremes of every bar that has 24 followers, sent once these have arrived."""
    from ..session import work_path

    path = work_path(spark, "bars")
    bars(spark, sf_dir).select("symbol", us("ts").alias("ts_us"), "high", "low").write.parquet(path)
    stream = spark.readStream.schema("symbol string, ts_us long, high double, low double").parquet(path)
    return flows.drained(flows.delayed_outcomes(stream, 24), "outcomes")


@q("t08_late_rows", "select count(*) filter (received_at <= datetime + interval 1 hour) as in_time, count(*) filter (received_at > datetime + interval 1 hour or datetime is null) as late from ohlcv")
def t08(spark, sf_dir):
    ok, late = flows.split_late(table(spark, sf_dir, "ohlcv"), "datetime", "received_at", "1 hour")
    a, b = ok.agg(F.count("*").alias("in_time")), late.agg(F.count("*").alias("late"))
    return a.join(b, F.lit(True))


@q("t10_sliding_windows", """select event_type, epoch_us(w) as from_us, count(*) as n, round(sum("value"), 4) as total from (select *, unnest(generate_series(date_trunc('hour', ts) - interval 1 hour, date_trunc('hour', ts), interval 1 hour)) as w from events) t group by 1, 2""")
def t10(spark, sf_dir):
    """Two-hour windows every hour."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type", F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n"), r6(F.sum("value"), 4).alias("total")).select("event_type", us("w.start").alias("from_us"), "n", "total")


@q("t11_sessions", """select user_id, epoch_us(min(ts)) as from_us, count(*) as n from (select *, sum(fresh) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as s from (
 select *, case when lag(ts) over (partition by user_id order by ts, event_id) is null or ts - lag(ts) over (partition by user_id order by ts, event_id) >= interval 6 hours then 1 else 0 end as fresh from events) t) u group by user_id, s""")
def t11(spark, sf_dir):
    """Sessions of users, ended by six quiet hours."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", us("w.start").alias("from_us"), "n")


# ---- The gate --------------------------------------------------------------------------------------------------

_BUF = """sg as (select *, epoch_us(ts) // 1000000 as sec, row_number() over (partition by symbol order by epoch_us(ts) // 1000000, sig_id) as rn from us where conviction is not null),
pv as (select c.symbol, c.sig_id, c.conviction, c.rn, p.sec as psec, c.sec from sg c left join sg p on p.symbol = c.symbol and p.rn = c.rn - 1),
bu as (select pv.symbol, pv.sig_id, any_value(pv.conviction) as conviction, count(b.sig_id) as seen, count(b.sig_id) filter (b.conviction <= pv.conviction) as below, quantile_cont(b.conviction, 0.5) as mid
  from pv left join sg b on b.symbol = pv.symbol and b.rn < pv.rn and b.sec >= pv.psec - 604800 and pv.sec - pv.psec <= 604800 group by pv.symbol, pv.sig_id)"""


def _buffered(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = unique_sigs(spark, sf_dir).filter("conviction is not null").select("symbol", "sig_id", F.floor(us("ts") / 1_000_000).cast("long").alias("sec"), "conviction")
    return C.buffered(s, "symbol", "sec", "conviction", "sig_id")


@q("w25_conviction_buffer", sql("select sig_id, seen from bu", _US, _BUF))
def w25(spark, sf_dir):
    return _buffered(spark, sf_dir).select("sig_id", F.size("_buffer").cast("long").alias("seen"))


@q("w26_rank_in_buffer", sql("select sig_id, round(case when seen > 0 then below / (seen + 1e-12) else conviction end, 6) as share from bu", _US, _BUF))
def w26(spark, sf_dir):
    return _buffered(spark, sf_dir).select("sig_id", r6(C.rank_in(F.col("_buffer"), F.col("conviction"))).alias("share"))


@q("w27_dynamic_threshold", sql("select sig_id, round(greatest(coalesce(mid * 1.1, 1e-12), 1e-12), 7) as threshold from bu", _US, _BUF))
def w27(spark, sf_dir):
    return _buffered(spark, sf_dir).select("sig_id", r6(C.threshold(F.col("_buffer")), 7).alias("threshold"))


@q("w28_volatility_levels", sql(f"select symbol, round(quantile_cont(v, 0.5), 7) as median, round(quantile_cont(v, 0.05), 7) as low, round(quantile_cont(v, 0.95), 7) as high from (select symbol, stddev_samp(r) over {_w(288)} as v from b) t where v is not null group by symbol", RET))
def w28(spark, sf_dir):
    from ..operators.order_stats import exact_quantiles

    df = core(S.staged(with_halo(positions(bars(spark, sf_dir), "symbol", ["ts"]), 290), [_r(along()), {"v": W.roll_std(F.col("r"), along(), 288, 2)}]))
    got = exact_quantiles(df, "symbol", {"v": F.col("v")}, [0.05, 0.5, 0.95])
    return got.groupBy(F.col("grp").alias("symbol")).agg(*[r6(F.max(F.when(F.abs(F.col("p") - p) < 1e-9, F.col("x"))), 7).alias(k) for k, p in (("median", 0.5), ("low", 0.05), ("high", 0.95))])


@q("m10_lp_norm", no_minus_zero("select vec_id, round(sqrt(list_sum([cast(x as double) * cast(x as double) for x in embedding])) + 1e-12, 6) as norm from embeddings"))
def m10(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", r6(C.lp_norm(F.col("embedding"))).alias("norm"))


@q("f16_embedding_columns", no_minus_zero("select vec_id, " + ", ".join(f"round(cast(embedding[{i + 1}] as double), 6) as slot_{16 + i}" for i in range(8)) + " from embeddings"))
def f16(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", *[r6(F.col("embedding")[i].cast("double")).alias(f"slot_{16 + i}") for i in range(8)])


@q("m09_gated_pooling", sql(f"select symbol, ts_us, round(case when v > 0.002 then greatest(0.0, least(1.0, 0.95 * 0.002 / (v + 1e-12))) else 0.95 end, 6) as decay from (select symbol, ts_us, {_gate('stddev_pop(r)', 'r', 48)} as v from b) t where v is not null", RET))
def m09(spark, sf_dir):
    """The decay that volatility-gated pooling applies at every bar, against a usual volatility of 0.002."""
    df = core(S.staged(with_halo(positions(bars(spark, sf_dir), "symbol", ["ts"]), 50), [_r(along()), {"v": W.rolling(F.stddev_pop("r"), F.col("r"), W.rows(along(), 48), 48)}])).filter("v is not null")
    return df.select("symbol", us("ts").alias("ts_us"), r6(C.pooled(F.array(F.lit(1.0)), F.col("v"), F.lit(0.002))[0]).alias("decay"))


@q("m11_embeddings")
def m11(spark, sf_dir):
    """A stand-in model over the 64 closes before each signature, and its conviction norm."""
    df = core(with_halo(positions(bars(spark, sf_dir), "symbol", ["ts"]), 64).withColumn("x", F.collect_list("close").over(W.rows(along(), 64))))
    s = unique_sigs(spark, sf_dir).select("symbol", us("ts").alias("ts_us"), "sig_id")
    rows = df.withColumn("ts_us", us("ts")).join(s, ["symbol", "ts_us"]).filter(F.size("x") == 64).select("sig_id", "x")
    return C.embedded(rows, "x").select("sig_id", r6(C.lp_norm(F.col("embedding"))).alias("norm"))


# ---- The flagship ----------------------------------------------------------------------------------------------


@q("flagship", f"""with hb as (select event_type as symbol, date_trunc('hour', ts) as hour, max("value") as h, min("value") as l, count(*) as n, max(case when kz = 1 then "value" end) as c from (
   select *, row_number() over (partition by event_type, date_trunc('hour', ts) order by ts desc, event_id desc) as kz from events) t group by 1, 2),
 x as (select *, avg(c) over p as mean, stddev_samp(c) over p as dev, max(h) over (partition by symbol order by hour rows between 1 following and 12 following) as ahead, count(*) over p as k from hb window p as (partition by symbol order by hour rows between 23 preceding and current row))
 select symbol, epoch_us(hour) as ts_us, round(c, 6) as "close", (round((c - mean) / dev, 5) + 0.0) as z, (round(ahead / c - 1, 9) + 0.0) as gain from x where k = 24 and dev > 0 and ahead is not null""")
def flagship(spark, sf_dir):
    """Ticks to hourly bars to rolling z-scores, with the best that the next twelve bars offered."""
    df = with_halo(positions(event_bars(spark, sf_dir), "symbol", ["ts"]), 24, 12)
    w = along()
    df = df.withColumns({"mean": W.roll_mean(F.col("close"), w, 24), "dev": W.roll_std(F.col("close"), w, 24), "ahead": W.forward_max(F.col("high"), w, 12)})
    df = core(df).filter("dev > 0 and mean is not null and ahead is not null")
    return df.select("symbol", us("ts").alias("ts_us"), r6("close").alias("close"), r6((F.col("close") - F.col("mean")) / F.col("dev"), 5).alias("z"), r6(F.col("ahead") / F.col("close") - 1, 9).alias("gain"))
