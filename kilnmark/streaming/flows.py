"""Structured Streaming forms of the batch operators."""

from __future__ import annotations

import os
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import work_path


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table as a stream, whether it is one file or a folder of files."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    first = spark.read.parquet(path).inputFiles()[0]
    r = spark.readStream.schema(schema)
    if os.path.basename(first) == f"{name}.parquet":
        return r.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return r.parquet(path)


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """What the stream gives until its source is used up, by way of a Parquet sink with a checkpoint.

    In append mode a window comes out once the watermark has passed its end."""
    spark = stream.sparkSession
    out, state = work_path(spark, name), work_path(spark, name + "-state")
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", state).option("path", out).format("parquet").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def tick_bars(ticks: DataFrame, symbol: str, ts: str, price: str, tie: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Streaming bars from ticks; ticks later than `late` behind the newest are dropped."""
    when = F.struct(F.col(ts), F.col(tie))
    g = ticks.withWatermark(ts, late).groupBy(F.col(symbol).alias("symbol"), F.window(ts, width).alias("w"))
    return g.agg(F.min_by(price, when).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, when).alias("close"), F.count("*").alias("trades")).select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "trades")


def once(rows: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """Each key once, the first that arrives; keys are remembered for `late`."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def buffer_ranks(rows: DataFrame, key: str, seconds: str, value: str, span: int) -> DataFrame:
    """Per row of a key its rank among the key's earlier values: key, seconds, value, seen, share.

    seen: earlier rows back to `span` seconds before the row that came last; share: how many of them are not above
    the value, or the value itself without any. State per key: the rows of the span, by time, and when the last one came. Rows of one micro-batch are put
    in order of time; rows older than those already seen are taken at the end."""
    schema = f"{key} string, {seconds} double, {value} double, seen long, share double"

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, values, last = (list(state.get[0]), list(state.get[1]), state.get[2]) if state.exists else ([], [], None)
        ranked = sorted(v for v in values if v == v)  # NaN is no value's equal or less
        pdf = pd.concat(list(batches)).sort_values([seconds, value])
        out = []
        for t, v in zip(pdf[seconds], pdf[value], strict=True):
            if last is not None and (old := bisect_left(times, last - span)):
                for x in values[:old]:
                    if x == x:
                        del ranked[bisect_left(ranked, x)]
                del times[:old], values[:old]
            n = len(values)
            out.append((k[0], t, v, n, (bisect_right(ranked, v) if v == v else 0) / n if n else v))
            at = bisect_right(times, t)
            times.insert(at, t)
            values.insert(at, v)
            if v == v:
                insort(ranked, v)
            last = t
        state.update((times, values, last))
        yield pd.DataFrame(out, columns=[key, seconds, value, "seen", "share"])

    return rows.select(key, seconds, value).groupBy(key).applyInPandasWithState(step, schema, "times array<double>, vals array<double>, last double", "append", GroupStateTimeout.NoTimeout)


def delayed_outcomes(bars: DataFrame, horizon: int) -> DataFrame:
    """Bars with the highest high and lowest low of the next `horizon` bars, each sent once those have arrived.

    State per symbol: the bars still waiting, at most `horizon`. Expects ts_us, high, low; bars of a micro-batch are
    put in order of time."""
    schema = "symbol string, ts_us long, top double, bottom double"

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = list(zip(*state.get, strict=True)) if state.exists else []
        pdf = pd.concat(list(batches)).sort_values("ts_us")
        rows = waiting + list(zip(pdf["ts_us"], pdf["high"], pdf["low"], strict=True))
        high, low = pd.Series([r[1] for r in rows]), pd.Series([r[2] for r in rows])
        top, bottom = high[::-1].rolling(horizon).max()[::-1].shift(-1), low[::-1].rolling(horizon).min()[::-1].shift(-1)
        done = max(0, len(rows) - horizon)
        rest = rows[done:]
        state.update(([int(r[0]) for r in rest], [float(r[1]) for r in rest], [float(r[2]) for r in rest]))
        yield pd.DataFrame({"symbol": [k[0]] * done, "ts_us": [int(r[0]) for r in rows[:done]], "top": top[:done].to_numpy(), "bottom": bottom[:done].to_numpy()})

    return bars.select("symbol", "ts_us", "high", "low").groupBy("symbol").applyInPandasWithState(step, schema, "t array<long>, h array<double>, l array<double>", "append", GroupStateTimeout.NoTimeout)


def into_folder(stream: DataFrame, path: str, state: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Writes every micro-batch to a folder of its own number, replacing what a broken attempt left: exactly once."""

    def write(df: DataFrame, batch: int) -> None:
        transform(df).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()


def split_late(rows: DataFrame, ts: str, received: str, late: str) -> tuple[DataFrame, DataFrame]:
    """Rows received within `late` of their time, and the others, which go to a table of their own."""
    ok = F.coalesce(F.col(received) <= F.col(ts) + F.expr(f"interval {late}"), F.lit(False))
    return rows.filter(ok), rows.filter(~ok)
