"""What followed a bar, and signature rows built from bars: gate, auxiliary and metadata slots, outcomes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions import slots as S
from . import windows as W
from .blocks import CORE, along
from .windows import EPS


def excursions(w: WindowSpec, bars: int, bullish: Column, cap: float = 50.0) -> list[S.Columns]:
    """mfe, mae and recovery over the next `bars` bars from the next open, by direction; 0 where no bar follows."""
    ahead = w.rowsBetween(1, bars)
    up = (F.max("high").over(ahead) - F.col("entry")) / (F.col("entry") + EPS)
    down = (F.col("entry") - F.min("low").over(ahead)) / (F.col("entry") + EPS)
    known = F.col("entry").isNotNull()
    return [
        {"entry": F.lead("open").over(w), "bullish": bullish},
        {"gain": F.when(known, F.when(F.col("bullish"), up).otherwise(down)).otherwise(0.0), "pain": F.when(known, F.when(F.col("bullish"), down).otherwise(up)).otherwise(0.0)},
        {"mfe": F.greatest("gain", F.lit(0.0)), "mae": F.greatest("pain", F.lit(0.0)), "recovery": F.greatest(F.least(F.col("gain") / (F.col("pain") + EPS), F.lit(cap)), F.lit(0.0))},
    ]


def first_peaks(w: WindowSpec, bars: int) -> list[S.Columns]:
    """Bars until the highest high and the lowest low of the next `bars` bars are first reached."""
    ahead = w.rowsBetween(1, bars)
    return [
        {
            "to_top": F.min_by("bar_idx", F.struct(-F.col("high"), F.col("bar_idx"))).over(ahead) - F.col("bar_idx"),
            "to_bottom": F.min_by("bar_idx", F.struct(F.col("low"), F.col("bar_idx"))).over(ahead) - F.col("bar_idx"),
        }
    ]


def time_hash(text: Column) -> Column:
    """A number in [0, 1] from the first 8 hex digits of a text's SHA-256."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") / (2.0**32 - 1 + EPS)


def quality(veto: Column, conviction: Column, live: Column) -> Column:
    """The veto score, raised to the mean of veto and conviction where a neural path is live."""
    return F.when(live, F.greatest(veto, (veto + conviction) / 2)).otherwise(veto)


def gate(veto: Column, threshold: float, neural: Column | None = None, mode: str = "veto") -> Column:
    """Whether a bar is a signature: 'veto' by the composite alone, 'veto_and_neural' only if the neural gate agrees."""
    ok = veto >= threshold
    if mode == "veto":
        return ok
    if mode == "veto_and_neural":
        return ok & neural
    raise ValueError(f"no gate mode {mode}")


def signature_rows(bars: DataFrame, cfg: S.SlotConfig = S.SlotConfig(), veto_threshold: float = 0.0, floor: float = 0.05, warmup: int = 500, ahead: int = 288, min_quality: float = 0.0) -> DataFrame:
    """One row per bar after the warm-up that passes gate and quality: slots, conviction, outcomes, metadata.

    Without a model the neural path is at its floor: conviction `floor`, threshold 0, a zero embedding. Bars whose
    forward window is cut by the end of their series are left out, as their outcome isn't known."""
    w = along()
    df = S.all_slots(bars, cfg, ahead + 1)
    vol = lambda n: W.roll_std(F.col("r"), w, n, n)
    df = df.withColumns({"_vol48": vol(48), "_vol72": F.coalesce(W.roll_std(F.col("r"), w, 72, 1), F.lit(0.0)), "_left": F.count("*").over(w.rowsBetween(1, ahead))})
    df = df.withColumn("slot_24", F.coalesce(F.col("_vol48") - F.lag("_vol48").over(w), F.lit(0.0)))
    df = S.staged(df, excursions(w, ahead, F.col("slot_00") >= 0))
    df = df.filter(CORE).filter((F.col("bar_idx") >= warmup) & (F.col("_left") == ahead))
    c = F.lit(floor)
    out = df.withColumns(
        {
            **{f"slot_{i}": F.lit(0.0) for i in range(16, 24)},
            "neural_conviction": c,
            "conviction_threshold": F.lit(0.0),
            "signature_flag": gate(F.col("slot_15"), veto_threshold),
            "slot_25": F.col("slot_15") * (1 + F.col("_vol72") * math.sqrt(72)),
            "slot_26": c,
            "slot_27": F.abs(F.col("slot_15") - c),
            "slot_28": F.lit(0.0),
            "slot_29": time_hash(F.unix_micros(F.col("ts").cast("timestamp")).cast("string")),
            "slot_31": quality(F.col("slot_15"), c, F.lit(False)),
            "recovery_factor": F.col("recovery"),
            "slot_30": F.col("recovery"),
            "year": F.date_format("ts", "yyyy"),
            "month": F.date_format("ts", "MM"),
        }
    )
    keep = ["symbol", "interval", "ts", "year", "month", *[f"slot_{i:02d}" for i in range(32)], "signature_flag", "neural_conviction", "conviction_threshold", "mfe", "mae", "recovery_factor"]
    return out.filter(F.col("signature_flag") & (F.col("slot_31") >= min_quality)).select(*keep)
