"""Bars: from ticks, from delivered candles, and pieces of their series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spikes import usable


def tick_bars(ticks: DataFrame, symbol: str, ts: str, price: str, tie: str, width: str = "1 hour", volume: Column | None = None) -> DataFrame:
    """Bars of a fixed width from single prices: symbol, ts (bar start), open, high, low, close, volume, trades.

    Open and close are the first and last price by (ts, tie). Rows without symbol, time or price don't count; spans
    without ticks give no bar. Partial results combine before the shuffle, so a hot symbol spreads."""
    t = ticks.filter(F.col(symbol).isNotNull() & F.col(ts).isNotNull() & F.col(price).isNotNull() & ~F.isnan(price))
    when = F.struct(F.col(ts), F.col(tie))
    return t.groupBy(F.col(symbol).alias("symbol"), F.window(ts, width).start.alias("ts")).agg(
        F.min_by(price, when).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, when).alias("close"),
        (F.sum(volume) if volume is not None else F.count("*").cast("double")).alias("volume"),
        F.count("*").alias("trades"),
    )


def clean_bars(ohlcv: DataFrame) -> DataFrame:
    """One usable bar per symbol and instant: symbol, interval, ts, open, high, low, close, volume.

    Bars without instant or with an unusable close are left out; of several at one instant the last received counts
    (then the larger bar_id). Unusable opens become the close, unusable highs and lows the body's ends, unusable
    volumes 0, so that no null or NaN is left."""
    rows = ohlcv.filter(F.col("datetime").isNotNull() & F.col("symbol").isNotNull() & usable("close"))
    last = rows.groupBy("symbol", F.col("datetime").alias("ts")).agg(F.max_by(F.struct("interval", "open", "high", "low", "close", "volume"), F.struct("received_at", "bar_id")).alias("b"))
    b = last.select("symbol", "ts", "b.*").withColumn("open", F.when(usable("open"), F.col("open")).otherwise(F.col("close")))
    return b.select(
        "symbol",
        "interval",
        "ts",
        "open",
        F.when(usable("high"), F.col("high")).otherwise(F.greatest("open", "close")).alias("high"),
        F.when(usable("low"), F.col("low")).otherwise(F.least("open", "close")).alias("low"),
        "close",
        F.when((F.col("volume") >= 0) & ~F.isnan("volume") & (F.col("volume") != float("inf")), F.col("volume")).otherwise(0.0).alias("volume"),
    )


def append_new(stored: DataFrame, fetched: DataFrame, keys: list[str], time: str, version: list[str]) -> DataFrame:
    """stored with those rows of fetched that are later than the series' last, each key once, the newest version.

    keys[0] is the series. With an empty store everything fetched comes in."""
    last = stored.groupBy(keys[0]).agg(F.max(time).alias("_last"))
    new = fetched.join(last, keys[0], "left").filter(F.col("_last").isNull() | (F.col(time) > F.col("_last"))).drop("_last")
    both = stored.unionByName(new)
    rest = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("_b")).select(*keys, "_b.*")


def shard_slice(positioned: DataFrame, start: str, end: str, warmup: int, ahead: int) -> DataFrame:
    """Of every series the bars from `warmup` before the first one at or after start to `ahead` behind the last one
    before end. Series without a bar in between don't come out. Needs bar_idx (see blocks.positions)."""
    ts = F.col("ts")
    inside = (ts >= F.lit(start).cast("timestamp")) & (ts < F.lit(end).cast("timestamp"))
    span = positioned.filter(inside).groupBy("symbol").agg(F.min("bar_idx").alias("_a"), F.max("bar_idx").alias("_z"))
    return positioned.join(span, "symbol").filter((F.col("bar_idx") >= F.col("_a") - warmup) & (F.col("bar_idx") <= F.col("_z") + ahead)).drop("_a", "_z")


def last_complete_day(end: Column | None = None) -> Column:
    """A given end date, or yesterday in UTC."""
    yesterday = F.date_sub(F.to_date(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())), 1)
    return yesterday if end is None else F.coalesce(end, yesterday)
