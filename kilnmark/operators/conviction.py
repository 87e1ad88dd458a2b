"""The conviction gate: a buffer of past scores, rank and threshold within it, norms, volatility-gated pooling."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import CORE, time_blocks
from .windows import EPS, clip

WEEK = 7 * 86_400
STRETCH = 28 * 86_400


def lp_norm(vector: Column, p: float = 2.0) -> Column:
    """Sum of |x| ** p to the power 1 / p, plus EPS; 0 for a null or empty vector."""
    total = F.aggregate(F.transform(vector, lambda x: F.pow(F.abs(x.cast("double")), F.lit(p))), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.coalesce(F.size(vector), F.lit(0)) <= 0, 0.0).otherwise(F.pow(total, F.lit(1 / p)) + EPS)


def buffered(df: DataFrame, series: str, seconds: str, value: str, tie: str, span: int = WEEK) -> DataFrame:
    """df with _buffer: the earlier values of the series back to `span` seconds before the row just before.

    The first row's buffer is empty. Stretches of time carry the rows they look back on, so a hot series spreads; the
    buffer of a row is as long as its span of rows. A row's predecessor must lie within `span`, else its buffer is
    empty, as nothing in it would be newer than that."""
    reach = 2 * span
    d = time_blocks(df.filter(F.col(seconds).isNotNull()), series, seconds, reach, max(STRETCH, 2 * reach))
    by = Window.partitionBy(series, "block").orderBy(seconds, tie)
    d = d.withColumn("_list", F.collect_list(value).over(Window.partitionBy(series, "block").orderBy(F.col(seconds).cast("long")).rangeBetween(-span, 0)))
    # Equal instants share a range; rows behind the present one in order are cut off by their number.
    d = d.withColumn("_rn", F.row_number().over(by)).withColumn("_same_after", F.count("*").over(Window.partitionBy(series, "block", seconds)) - F.row_number().over(Window.partitionBy(series, "block", seconds).orderBy(tie)))
    d = d.withColumn("_list", F.slice("_list", 1, F.greatest(F.size("_list") - F.col("_same_after").cast("int"), F.lit(0))))
    near = F.col(seconds) - F.lag(seconds).over(by) <= reach - span
    d = d.withColumn("_buffer", F.coalesce(F.when(near, F.lag("_list").over(by)), F.array().cast("array<double>")))
    return d.filter(CORE).drop(CORE, "block", "_list", "_rn", "_same_after")


def rank_in(buffer: Column, value: Column) -> Column:
    """Share of the buffer that isn't above the value; the value itself without a buffer."""
    n = F.size(buffer)
    return F.when(n > 0, F.size(F.filter(buffer, lambda x: x <= value)) / (n + EPS)).otherwise(value)


def median_of(values: Column) -> Column:
    s, n = F.array_sort(values), F.size(values)
    at = lambda i: F.try_element_at(s, i.cast("int"))
    return F.when(n > 0, (at(F.floor((n + 1) / 2)) + at(F.floor((n + 2) / 2))) / 2)


def threshold(buffer: Column, volatility: Column | None = None, multiplier: float = 1.1, baseline: float = 0.0035, low: float = 0.3, high: float = 3.0) -> Column:
    """Median of the buffer times a multiplier and the clipped ratio of volatility to its baseline; at least EPS."""
    factor = F.lit(1.0) if volatility is None or baseline <= 0 else F.coalesce(clip(volatility / (baseline + EPS), low, high), F.lit(1.0))
    return F.greatest(F.coalesce(median_of(buffer) * multiplier * factor, F.lit(EPS)), F.lit(EPS))


def pooled(vector: Column, realised: Column, usual: Column, decay: float = 0.95) -> Column:
    """vector times the decay, which is cut in proportion where realised volatility is above its usual level."""
    d = clip(F.when(realised > usual, decay * usual / (realised + EPS)).otherwise(decay), 0, 1)
    return F.transform(vector, lambda x: x * d)


def hashed_embedder(width: int = 8) -> Callable[[np.ndarray], np.ndarray]:
    """A stand-in for a model: fixed random projections of each window, of unit scale."""
    planes = np.random.default_rng(5).normal(size=(4096, width))

    def embed(windows: np.ndarray) -> np.ndarray:
        z = (windows - windows.mean(1, keepdims=True)) / (windows.std(1, keepdims=True) + 1e-5)
        return np.tanh(np.clip(z, -5, 5) @ planes[: windows.shape[1]] / np.sqrt(windows.shape[1]))

    return embed


def embedded(rows: DataFrame, window: str, make: Callable[[], Callable[[np.ndarray], np.ndarray]] = hashed_embedder) -> DataFrame:
    """rows with `embedding`, by a model that `make` loads once per task; null or short windows give a null one.

    window: an array column of equal lengths."""
    out = T.StructType([*rows.schema.fields, T.StructField("embedding", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in batches:
            size = max((len(x) for x in pdf[window] if x is not None), default=0)
            ok = np.array([x is not None and len(x) == size and size > 1 for x in pdf[window]], bool)
            e = [None] * len(pdf)
            if ok.any():
                for i, v in zip(np.flatnonzero(ok), model(np.stack([np.asarray(x, float) for x in pdf[window][ok]])), strict=True):
                    e[i] = v.tolist()
            yield pdf.assign(embedding=e)

    return rows.mapInPandas(run, out)
