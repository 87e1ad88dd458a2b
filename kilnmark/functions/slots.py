"""The structural features of a bar, slot_00 to slot_14, and their weighted composite slot_15.

Slots that windows can express are columns; those that need a transform of every window, or a recursion, are computed
by one Arrow kernel per block of a series. All look back only: a block with the halo BACK gives the same values as the
whole series, the regime slot with the highest volatility before its halo besides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import windows as W
from ..operators.blocks import BLOCK, CORE, IDX, along, positions, with_halo
from ..operators.windows import EPS

BACK = 1_728  # rows before a block: two times the longest stack of windows, and far beyond the memory of any average


@dataclass(frozen=True)
class SlotConfig:
    """Windows, thresholds and weights. The defaults are the fixed values of the archive's definition."""

    bvc_window: int = 20
    bvc_steepness: float = 1.5
    absorb_window: int = 24
    absorb_decay: float = 0.95
    absorb_threshold: float = 0.05
    vpin_window: int = 100
    spectral_window: int = 72
    variance_short: int = 12
    variance_long: int = 144
    hurst_window: int = 120
    lag_window: int = 48
    lags: tuple[int, ...] = (1, 2, 3, 4, 5)
    ribbon_spans: tuple[int, ...] = (8, 13, 21, 34, 55)
    ribbon_window: int = 12
    divergence_window: int = 24
    divergence_lag: int = 3
    regime_window: int = 288
    regime_count: int = 4
    vacuum_threshold: float = 0.85
    wick_limit: float = 100.0
    wick_body: float = 0.15
    wick_window: int = 288
    wick_quantile: float = 0.99
    pivot_lookback: int = 144
    pivot_strength: int = 3
    pivot_bandwidth: float = 0.005
    micro_coefficient: float = 0.65
    micro_window: int = 12
    entropy_window: int = 96
    entropy_bins: int = 10
    cycle_window: int = 200
    norm_window: int = 288
    weights: dict[str, float] = field(
        default_factory=lambda: {
            "slot_00": 0.08, "slot_01": 0.08, "slot_02": 0.08, "slot_03": 0.06, "slot_04": 0.08, "slot_05": 0.05, "slot_06": 0.08, "slot_07": 0.06,
            "slot_08": 0.10, "slot_09": 0.07, "slot_10": 0.05, "slot_11": 0.08, "slot_12": 0.05, "slot_13": 0.04, "slot_14": 0.04,
        }
    )
    bounds: dict[str, tuple[float, float]] = field(default_factory=lambda: {"slot_00": (-1.0, 1.0), "slot_03": (-5.0, 5.0), "slot_04": (0.0, 1.0), "slot_07": (-10.0, 10.0), "slot_12": (-5.0, 5.0)})


Columns = dict[str, Column]
REGISTRY: dict[str, Callable[[WindowSpec, SlotConfig], list[Columns]]] = {}


def slot(name: str):
    """Registers a builder: given window and config, stages of named columns, the last holding the slot itself."""

    def add(f):
        REGISTRY[name] = f
        return f

    return add


def base(w: WindowSpec, cfg: SlotConfig) -> list[Columns]:
    """Returns and the split of volume by the sign and size of price changes, from which slots start.

    The split is null for a series' first bar, whose change has no deviation yet."""
    c = F.col("close")
    f = W.rows(w, cfg.bvc_window)
    pct = F.col("pct")
    z = W.clip((pct - F.avg(pct).over(f)) / F.when(F.count(pct).over(f) > 1, F.greatest(F.stddev_samp(pct).over(f), F.lit(EPS))), -10, 10)
    return [
        {"r": W.log_return(c, w), "pct": F.coalesce(c / F.lag(c).over(w) - 1, F.lit(0.0))},
        {"buy": F.col("volume") / (1 + F.exp(-cfg.bvc_steepness * z))},
        {"sell": F.col("volume") - F.col("buy")},
    ]


def _imbalance() -> Column:
    return F.abs(F.col("buy") - F.col("sell")) / F.greatest(F.col("buy") + F.col("sell"), F.lit(EPS))


def hash_split(volume: Column, text: Column) -> tuple[Column, Column]:
    """Buy and sell volume by a share drawn from the SHA-256 of a text: 16 leading hex digits over 16 ** 16."""
    share = F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)
    return volume * share, volume * (1 - share)


@slot("slot_00")
def absorption(w: WindowSpec, cfg: SlotConfig) -> list[Columns]:
    """Inputs of the absorption score: volume bought near the low, sold near the high of the window."""
    n = cfg.absorb_window
    low, high = W.roll_min(F.col("low"), w, n), W.roll_max(F.col("high"), w, n)
    span = F.greatest(high - low, F.lit(EPS))
    near = lambda x, v: F.when(low.isNotNull() & (x / span < cfg.absorb_threshold), v).otherwise(0.0)
    return [{"at_low": near(F.col("low") - low, F.col("buy")), "at_high": near(high - F.col("high"), F.col("sell"))}]


@slot("slot_01")
def toxicity(w: WindowSpec, cfg: SlotConfig) -> list[Columns]:
    return [{"imbalance": F.when(F.col("buy").isNotNull(), _imbalance())}, {"slot_01": F.coalesce(W.roll_mean(F.col("imbalance"), w, cfg.vpin_window), F.lit(0.0))}]


@slot("slot_03")
def variance_ratio(w: WindowSpec, cfg: SlotConfig) -> list[Columns]:
    r = F.col("r")
    return [{"slot_03": F.coalesce(F.ln((W.roll_var(r, w, cfg.variance_short) + EPS) / (W.roll_var(r, w, cfg.variance_long) + EPS)), F.lit(0.0))}]


@slot("slot_05")
def persistence(w: WindowSpec, cfg: SlotConfig) -> list[Columns]:
    full = F.count("r").over(W.rows(w, cfg.lag_window)) >= cfg.lag_window
    lagged = {f"r{k}": F.lag("r", k).over(w) for k in cfg.lags}
    each = [F.when(full, F.abs(W.autocorrelation(F.col("r"), F.col(f"r{k}"), w, cfg.lag_window, k))) for k in cfg.lags]
    held = F.filter(F.array(*[F.col(f"ac{k}") for k in cfg.lags]), lambda x: x.isNotNull())
    mean = F.when(F.size(held) > 0, F.aggregate(held, F.lit(0.0), lambda a, x: a + x) / F.size(held))
    return [lagged, {f"ac{k}": e for k, e in zip(cfg.lags, each, strict=True)}, {"slot_05": F.coalesce(mean, F.lit(0.0))}]


@slot("slot_07")
def divergence(w: WindowSpec, cfg: SlotConfig) -> list[Columns]:
    k, n = cfg.divergence_lag, cfg.divergence_window
    vol = F.col("buy") + F.col("sell")
    return [
        {"accel": F.col("r") - F.lag("r", k).over(w), "vchg": F.coalesce(F.ln((vol + EPS) / (F.lag(vol, k).over(w) + EPS)), F.lit(0.0))},
        {"apart": F.abs("accel") - F.abs("vchg")},
        {"diverged": W.roll_mean(F.col("apart"), w, n)},
        {"slot_07": W.zscore(F.col("diverged"), w, n)},
    ]


@slot("slot_08")
def regime_volatility(w: WindowSpec, cfg: SlotConfig) -> list[Columns]:
    """The volatility that the regime slot cuts; see regimes."""
    return [{"r0": F.coalesce("r", F.lit(0.0))}, {"volatility": F.coalesce(W.roll_std(F.col("r0"), w, cfg.regime_window), F.lit(0.0))}]


@slot("slot_09")
def vacuum(w: WindowSpec, cfg: SlotConfig) -> list[Columns]:
    t = cfg.vacuum_threshold
    return [{"slot_09": F.coalesce(W.clip(F.when(F.col("buy").isNotNull(), _imbalance() - t) / (1 - t + EPS), 0, 1), F.lit(0.0))}]


@slot("slot_10")
def wicks(w: WindowSpec, cfg: SlotConfig) -> list[Columns]:
    span = F.greatest(F.col("high") - F.col("low"), F.lit(EPS))
    body = F.greatest(F.abs(F.col("close") - F.col("open")), F.lit(EPS))
    return [
        {"wick": F.least(span / body, F.lit(cfg.wick_limit)), "doji": (body / span < cfg.wick_body).cast("double")},
        {"wick_q": W.roll_quantile(F.col("wick"), w, cfg.wick_window, cfg.wick_quantile, 1)},
        {"wick_s": F.least(F.col("wick") * F.col("doji"), F.col("wick_q"))},
        {"slot_10": W.clip(F.col("wick_s") / F.greatest(W.roll_max(F.col("wick_s"), w, cfg.wick_window, 1), F.lit(EPS)), 0, 1)},
    ]


@slot("slot_11")
def pivots(w: WindowSpec, cfg: SlotConfig) -> list[Columns]:
    """Closeness to the last pivots. A pivot is known only pivot_strength bars later, which the frame allows for."""
    s, reach = cfg.pivot_strength, max(cfg.pivot_lookback - cfg.pivot_strength, 1)
    around = w.rowsBetween(-s, s)
    past = w.rowsBetween(-(reach - 1) - s, -s)
    whole = F.count("high").over(around) >= 2 * s + 1
    unit = F.col("close") * cfg.pivot_bandwidth + EPS
    return [
        {"pivot_high": F.when(whole & (F.col("high") == F.max("high").over(around)), F.col("high")), "pivot_low": F.when(whole & (F.col("low") == F.min("low").over(around)), F.col("low"))},
        {"resist": F.max("pivot_high").over(past), "support": F.min("pivot_low").over(past)},
        {"slot_11": F.coalesce(F.exp(-W.clip(F.least(F.abs(F.col("resist") - F.col("close")) / unit, F.abs(F.col("close") - F.col("support")) / unit), None, 10)), F.lit(0.0))},
    ]


@slot("slot_12")
def microprice(w: WindowSpec, cfg: SlotConfig) -> list[Columns]:
    tilt = (F.col("buy") - F.col("sell")) / F.greatest(F.col("buy") + F.col("sell"), F.lit(EPS))
    return [{"micro": F.col("close") * (1 + cfg.micro_coefficient * tilt) - F.col("close")}, {"slot_12": W.zscore(F.col("micro"), w, cfg.micro_window)}]


def seen_before(first: DataFrame, cfg: SlotConfig) -> DataFrame:
    """symbol, block, vol_before: the highest volatility of a series' bars that precede a block's halo.

    first: core rows with their volatility. The halo's first bars, whose own windows it cuts, count as preceding."""
    at = F.floor((F.col(IDX) + (BACK - cfg.regime_window - 1)) / BLOCK).alias("block")
    tops = first.groupBy("symbol", at).agg(F.max("volatility").alias("_top"))
    w = Window.partitionBy("symbol").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return tops.select("symbol", "block", F.max("_top").over(w).alias("vol_before"))


def regimes(w: WindowSpec, cfg: SlotConfig) -> list[Columns]:
    """1 where volatility lies in the highest of regime_count equal-width classes up to its highest value so far.

    The lowest value so far is 0, that of a series' first bars. Needs vol_before (see seen_before)."""
    top = F.greatest(F.coalesce("vol_before", F.lit(0.0)), F.max("volatility").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return [{"vol_high": top}, {"slot_08": (F.col("volatility") > F.col("vol_high") * ((cfg.regime_count - 1) / cfg.regime_count)).cast("double")}]


# ---- Kernels over whole windows --------------------------------------------------------------------------------


def _windows(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All full windows of n values without gaps, and the rows at which they end."""
    if len(x) < n:
        return np.empty((0, n)), np.empty(0, np.int64)
    v = np.lib.stride_tricks.sliding_window_view(x, n)
    ends = np.arange(n - 1, len(x))
    gaps = np.cumsum(np.append(0, np.isnan(x)))
    whole = gaps[n:] == gaps[:-n]
    return v[whole], ends[whole]


def per_window(x: np.ndarray, n: int, f: Callable[[np.ndarray], np.ndarray], chunk: int = 4096) -> np.ndarray:
    """f of every full window, NaN where there is none."""
    out = np.full(len(x), np.nan)
    v, ends = _windows(x, n)
    for a in range(0, len(v), chunk):
        out[ends[a : a + chunk]] = f(v[a : a + chunk])
    return out


def spectral_entropy(v: np.ndarray) -> np.ndarray:
    power = np.abs(np.fft.rfft(v - v.mean(1, keepdims=True), axis=1)) ** 2
    total = power.sum(1, keepdims=True)
    p = power / np.maximum(total, EPS)
    p = np.where(p > EPS, p, 1.0)
    return np.where(total[:, 0] < EPS, 0.0, -(p * np.log(p)).sum(1))


def hurst_gap(v: np.ndarray) -> np.ndarray:
    """One half less the Hurst exponent by rescaled range; 0 where the window doesn't move."""
    dev = np.cumsum(v - v.mean(1, keepdims=True), axis=1)
    r, s = dev.max(1) - dev.min(1), v.std(1)
    rs = r / (s + EPS)
    flat = (s < EPS) | (rs < EPS)
    return np.where(flat, 0.0, 0.5 - np.log(np.where(flat, 1.0, rs)) / np.log(v.shape[1]))


def shannon_entropy(v: np.ndarray, bins: int) -> np.ndarray:
    """Entropy of the window's values in equal-width bins between its extremes, the last bin closed."""
    low, high = v.min(1, keepdims=True), v.max(1, keepdims=True)
    flat = high == low
    low, high = np.where(flat, low - 0.5, low), np.where(flat, high + 0.5, high)
    width = (high - low) / bins
    i = np.clip(((v - low) / (high - low) * bins).astype(np.int64), 0, bins - 1)
    # A value at a border belongs above it; division alone may put it on the wrong side.
    i = np.where(v < low + i * width, i - 1, i)
    i = np.where((v >= low + (i + 1) * width) & (i < bins - 1), i + 1, i).clip(0, bins - 1)
    counts = np.stack([(i == b).sum(1) for b in range(bins)], 1)
    p = counts / v.shape[1]
    return -np.where(counts > 0, p * np.log(p + EPS), 0.0).sum(1)


def phase_speed(v: np.ndarray) -> np.ndarray:
    """Mean absolute change of the analytic signal's unwrapped phase."""
    n = v.shape[1]
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    phase = np.unwrap(np.angle(np.fft.ifft(np.fft.fft(v - v.mean(1, keepdims=True), axis=1) * gain, axis=1)), axis=1)
    return np.abs(np.diff(phase, axis=1)).mean(1)


def ewm(x: np.ndarray, span: float) -> np.ndarray:
    return pd.Series(x).ewm(span=span, adjust=False).mean().to_numpy()


def mean_autocorrelation(v: np.ndarray, lags: tuple[int, ...]) -> np.ndarray:
    """Mean absolute autocorrelation of every window over the lags at which it varies; 0 without any."""
    total, count = np.zeros(len(v)), np.zeros(len(v))
    for k in lags:
        a, b = v[:, k:], v[:, :-k]
        a, b = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
        d = np.sqrt((a * a).sum(1) * (b * b).sum(1))
        total += np.where(d > 0, np.abs((a * b).sum(1)) / np.where(d > 0, d, 1), 0)
        count += d > 0
    return total / np.maximum(count, 1)


def wick_scores(o: np.ndarray, h: np.ndarray, low: np.ndarray, c: np.ndarray, cfg: SlotConfig) -> np.ndarray:
    span, body = np.maximum(h - low, EPS), np.maximum(np.abs(c - o), EPS)
    wick = pd.Series(np.minimum(span / body, cfg.wick_limit))
    q = wick.rolling(cfg.wick_window, min_periods=1).quantile(cfg.wick_quantile)
    s = np.minimum(wick * (body / span < cfg.wick_body), q)
    return np.clip(s / s.rolling(cfg.wick_window, min_periods=1).max().clip(lower=EPS), 0, 1).to_numpy()


KERNEL_SLOTS = ("slot_00", "slot_02", "slot_04", "slot_06", "slot_13", "slot_14")
# Windows can express these two as well, but sliding frames rebuild their state for every row.
BULK_SLOTS = (*KERNEL_SLOTS, "slot_05", "slot_10")


def block_slots(t: pa.Table, cfg: SlotConfig, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    """The kernel slots of one block whose rows are in order."""
    get = lambda c: t[c].to_pandas().to_numpy(dtype=float, na_value=np.nan)
    r = get("r")

    def absorbed() -> np.ndarray:
        span = max(cfg.absorb_window * (1 - cfg.absorb_decay), 1.0)
        bought, sold = ewm(get("at_low"), span), ewm(get("at_high"), span)
        return np.clip((bought - sold) / (bought + sold + EPS), -1, 1)

    def ribbon() -> np.ndarray:
        close = get("close")
        x = pd.Series(np.mean([np.abs(close - ewm(close, s)) for s in cfg.ribbon_spans], axis=0))
        roll = x.rolling(cfg.ribbon_window, min_periods=1)
        return ((x - roll.mean()) / roll.std().clip(lower=EPS)).clip(-10, 10).to_numpy()

    def cycle() -> np.ndarray:
        raw = np.nan_to_num(per_window(np.nan_to_num(r), cfg.cycle_window, phase_speed))
        return np.clip(raw / np.maximum(pd.Series(raw).rolling(cfg.cycle_window).max().to_numpy(), EPS), 0, 1)

    kernels = {
        "slot_00": absorbed,
        "slot_02": lambda: per_window(r, cfg.spectral_window, spectral_entropy),
        "slot_04": lambda: per_window(r, cfg.hurst_window, hurst_gap),
        "slot_05": lambda: per_window(r, cfg.lag_window, lambda v: mean_autocorrelation(v, cfg.lags)),
        "slot_06": ribbon,
        "slot_10": lambda: wick_scores(get("open"), get("high"), get("low"), get("close"), cfg),
        "slot_13": lambda: per_window(r, cfg.entropy_window, lambda v: shannon_entropy(v, cfg.entropy_bins)),
        "slot_14": cycle,
    }
    return {k: np.nan_to_num(kernels[k]()) for k in names}


def composite_values(slots: dict[str, np.ndarray], cfg: SlotConfig) -> np.ndarray:
    """slot_15 of one block, as `composite` has it."""
    total = 0.0
    for s, weight in cfg.weights.items():
        x = pd.Series(slots[s])
        if s in cfg.bounds:
            low, high = cfg.bounds[s]
            y = (x.abs().clip(upper=high) if low < 0 else x.clip(low, high) - low) / (high - max(low, 0.0) + EPS)
        else:
            roll = x.rolling(cfg.norm_window, min_periods=1)
            y = (x - roll.min()) / (roll.max() - roll.min()).clip(lower=EPS)
        total = total + y.clip(0, 1).fillna(0.0) * weight
    return np.clip(np.asarray(total, float), 0, 1)


def with_kernel_slots(df: DataFrame, cfg: SlotConfig, names: tuple[str, ...], total: bool = False) -> DataFrame:
    """Adds kernel slots, and slot_15 if `total`, to haloed rows; the blocks lie together already, so nothing moves."""
    schema = T.StructType([*df.schema.fields, *[T.StructField(s, T.DoubleType()) for s in (*names, *["slot_15"] * total)]])

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by(IDX)
        for name, x in block_slots(t, cfg, names).items():
            t = t.append_column(name, pa.array(x))
        if total:
            t = t.append_column("slot_15", pa.array(composite_values({s: t[s].to_numpy() for s in cfg.weights}, cfg)))
        return t

    return df.groupBy("symbol", "block").applyInArrow(run, schema)


def checked(cfg: SlotConfig) -> SlotConfig:
    if abs(sum(cfg.weights.values()) - 1) > 1e-9:
        raise ValueError(f"weights sum to {sum(cfg.weights.values())}, not 1")
    unknown = set(cfg.weights) - {f"slot_{i:02d}" for i in range(15)}
    if unknown:
        raise KeyError(f"no such slots: {sorted(unknown)}")
    return cfg


def staged(df: DataFrame, stages: list[Columns]) -> DataFrame:
    for s in stages:
        df = df.withColumns(s)
    return df


def composite(w: WindowSpec, cfg: SlotConfig) -> list[Columns]:
    """slot_15: weighted sum of the slots scaled to [0, 1] by static bounds or a rolling range. Weights must sum to 1."""
    cfg = checked(cfg)
    total = F.lit(0.0)
    for s, weight in cfg.weights.items():
        x = F.col(s)
        if s in cfg.bounds:
            low, high = cfg.bounds[s]
            y = W.clip((F.least(F.abs(x), F.lit(high)) if low < 0 else W.clip(x, low, high) - low) / (high - max(low, 0.0) + EPS), 0, 1)
        else:
            f = W.rows(w, cfg.norm_window)
            lo = F.min(x).over(f)
            y = W.clip((x - lo) / F.greatest(F.max(x).over(f) - lo, F.lit(EPS)), 0, 1)
        total = total + F.coalesce(y, F.lit(0.0)) * weight
    return [{"slot_15": W.clip(total, 0, 1)}]


def haloed(bars: DataFrame, back: int = BACK, ahead: int = 0) -> DataFrame:
    return with_halo(positions(bars, "symbol", ["ts"]), back, ahead, BLOCK)


def single_slot(bars: DataFrame, name: str, cfg: SlotConfig = SlotConfig()) -> DataFrame:
    """symbol, ts and one slot; an unknown name is an error."""
    if name not in REGISTRY and name not in KERNEL_SLOTS:
        raise ValueError(f"no implementation of {name}")
    df = staged(haloed(bars), base(along(), cfg))
    if name in KERNEL_SLOTS:
        df = with_kernel_slots(staged(df, absorption(along(), cfg)), cfg, (name,))
    else:
        df = staged(df, REGISTRY[name](along(), cfg))
    if name == "slot_08":
        df = with_regimes(df, df.filter(CORE), cfg)
    return df.filter(CORE).select("symbol", "ts", name)


def with_regimes(df: DataFrame, first: DataFrame, cfg: SlotConfig) -> DataFrame:
    """df with slot_08; first: core rows with their volatility."""
    return staged(df.join(seen_before(first, cfg), ["symbol", "block"], "left"), regimes(along(), cfg))


def all_slots(bars: DataFrame, cfg: SlotConfig = SlotConfig(), ahead: int = 0) -> DataFrame:
    """Haloed rows with slot_00 to slot_15; filter on the core column for each bar once.

    The regime slot needs the highest volatility before each block, which a first pass gathers."""
    w = along()
    df = haloed(bars, BACK, ahead)
    native = [base(w, cfg), *[f(w, cfg) for k, f in REGISTRY.items() if k not in BULK_SLOTS or k == "slot_00"]]
    first = staged(staged(df, base(w, cfg)[:1]), regime_volatility(w, cfg)).filter(CORE)
    for stages in native:
        df = staged(df, stages)
    df = with_regimes(df, first, cfg)
    keep = ["symbol", "interval", "ts", "open", "high", "low", "close", "volume", IDX, "block", CORE, "r", "at_low", "at_high"]
    names = [f"slot_{i:02d}" for i in range(15)]
    df = df.select(*keep, *[n for n in names if n not in BULK_SLOTS])
    return with_kernel_slots(df, checked(cfg), BULK_SLOTS, total=True).drop("at_low", "at_high")
