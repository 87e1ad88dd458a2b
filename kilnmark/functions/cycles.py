"""Priors of a series: its dominant cycle and what windows and thresholds follow from it; NumPy kernels."""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np

from .hidden import best_states
from .slots import SlotConfig

LOW_CYCLE, HIGH_CYCLE, USUAL_CYCLE, LEAST_BARS, MOST_BARS = 24, 1_000, 288, 64, 2_000
_EPS = 1e-12


def dominant_cycle(r: np.ndarray, steps: int = 64) -> int:
    """Period of the Ricker wavelet scale that carries the most mean power, within [24, 1000]; 288 for short series."""
    if len(r) < LEAST_BARS:
        return USUAL_CYCLE
    x = np.nan_to_num(r[-MOST_BARS:], posinf=0, neginf=0)
    n = len(x)
    high, low = min(n // 2, HIGH_CYCLE), LOW_CYCLE // 2
    if high <= low:
        return USUAL_CYCLE
    scales = np.unique(np.round(np.geomspace(low, high, min(steps, high - low + 1)))).astype(float)
    size = 1 << int(np.ceil(np.log2(2 * n + 2)))
    spectrum = np.fft.rfft(x, size)
    power = []
    for s in scales:
        half = int(min(round(5 * s), n // 2))
        u = np.arange(-half, half + 1) / s
        k = (1 - u * u) * np.exp(-u * u / 2)
        k /= np.linalg.norm(k) + _EPS
        full = np.fft.irfft(spectrum * np.fft.rfft(k, size), size)[: n + 2 * half]
        power.append(np.mean(full[half : half + n] ** 2))
    period = scales[int(np.argmax(power))] * math.sqrt(2 * math.pi / 5)
    return int(np.clip(round(period), LOW_CYCLE, HIGH_CYCLE))


def change_distance(r: np.ndarray, cycle: int, ratio: float = 2.0, most: int = 6) -> int:
    """Bars since the variance last changed by at least `ratio`, in [cycle, most cycles]; cycle if it didn't."""
    x = np.nan_to_num(r[-MOST_BARS:], posinf=0, neginf=0)
    n = len(x)
    if n < 2 * cycle or n - cycle <= cycle:
        return cycle
    s = np.abs(np.cumsum(x * x - np.mean(x * x)))[cycle : n - cycle]
    at = int(np.argmax(s)) + cycle
    a, b = x[:at].var(), x[at:].var()
    if max(a, b) / (min(a, b) + _EPS) < ratio:
        return cycle
    return int(np.clip(n - at, cycle, most * cycle))


def mutual_information(x: np.ndarray, y: np.ndarray, bins: int) -> float:
    return information(np.histogram2d(x, y, bins)[0])


def information(h: np.ndarray) -> float:
    """Mutual information of the counts h, in nats."""
    p = h / max(h.sum(), 1)
    a, b = p.sum(1, keepdims=True), p.sum(0, keepdims=True)
    ok = p > 0
    return float((p[ok] * np.log(p[ok] / (a @ b)[ok])).sum())


def trailing_sum(r: np.ndarray, w: int) -> np.ndarray:
    c = np.cumsum(np.append(0.0, np.nan_to_num(r)))
    out = np.full(len(r), np.nan)
    out[w - 1 :] = c[w:] - c[:-w]
    return out


RATIO_BINS, RATIOS = 12, np.linspace(0.5, 1.5, 11)


def cycle_ratio(r: np.ndarray, cycle: int, bins: int = RATIO_BINS) -> float:
    """The window length, in cycles, whose summed return tells most about the cycle's return; 1 if none does."""
    y = trailing_sum(r, cycle)[cycle - 1 :]
    best, ratio = 0.0, 1.0
    for m in RATIOS:
        w = max(int(cycle * m), 2)
        x = trailing_sum(r, w)[w - 1 :]
        k = min(len(x), len(y)) - cycle
        if k > 2 * bins and (v := mutual_information(x[-k - cycle : -cycle], y[-k - cycle : -cycle], bins)) > best:
            best, ratio = v, float(m)
    return ratio


def acf(r: np.ndarray, lags: int) -> np.ndarray:
    x = np.nan_to_num(r) - np.mean(np.nan_to_num(r))
    v = (x * x).sum() + _EPS
    return np.array([(x[k:] * x[:-k]).sum() / v for k in range(1, lags + 1)])


NOISE_BARS, NOISE_LAGS = 200, 20


def noise(r: np.ndarray) -> float:
    """The autocorrelation that 95 % of the first lags of the latest returns stay below."""
    return float(np.percentile(np.abs(acf(r[-NOISE_BARS:], NOISE_LAGS)), 95)) if len(r) >= NOISE_BARS + NOISE_LAGS else math.inf


def most_lags(n: int, cycle: int) -> int:
    """How many lags of autocorrelation n returns need."""
    return max(min(cycle, n // 3), NOISE_LAGS if n >= NOISE_BARS + NOISE_LAGS else 0)


def significant_lags(a: np.ndarray, least: float) -> tuple[int, ...]:
    """3 to 8 of the lags 1 to 20 whose autocorrelation a stands out against recent noise, else 1 to 5."""
    found = [k + 1 for k, v in enumerate(np.abs(a[:NOISE_LAGS])) if v > least]
    return tuple(found[:8]) if len(found) >= 3 else (1, 2, 3, 4, 5)


def ribbon_spans(a: np.ndarray, n: int, cycle: int) -> tuple[int, ...]:
    """Lags of the strongest local maxima of the autocorrelation a of n returns beyond 2 / sqrt(n), else a geometric row up to the cycle."""
    lags = min(cycle, n // 3)
    if lags >= 5:
        a = np.abs(a[:lags])
        peaks = [k for k in range(1, lags - 1) if a[k] > a[k - 1] and a[k] >= a[k + 1] and a[k] > 2 / math.sqrt(n)]
        if len(peaks) >= 3:
            return tuple(sorted(k + 1 for k in sorted(peaks, key=lambda k: -a[k])[:5]))
    return tuple(sorted({max(2, round(cycle * f)) for f in (1 / 24, 1 / 12, 1 / 6, 1 / 3, 2 / 3)}))


VOLATILITY_CYCLES, LEAST_STATES_BARS = 30, 128
AT = {"proximity": (5,), "imbalance": (85,), "body": (20,), "wick": (99,), "rv": (5, 25, 50, 75, 95)}  # percentiles that priors need


def realised(x: np.ndarray, w: int) -> np.ndarray:
    """Standard deviation of the latest w values, or of as many as there are; NaN for the first."""
    n = len(x)
    t = np.arange(1, n + 1)
    k = np.minimum(t, w)
    m = x.mean() if n else 0.0
    total = lambda z: (lambda c: c[t] - c[t - k])(np.append(0.0, np.cumsum(z)))
    a, b = total(x - m), total((x - m) ** 2)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(k > 1, np.sqrt(np.maximum(b - a * a / k, 0) / (k - 1)), np.nan)


def by_bar(o: np.ndarray, h: np.ndarray, low: np.ndarray, c: np.ndarray, d: int) -> dict[str, np.ndarray]:
    """What percentiles and volatility levels are taken of, per bar; x is the return, 0 at the first bar."""
    span, body, w = np.maximum(h - low, _EPS), np.abs(c - o), max(d // 12, 2)
    proximity = np.full(len(c), np.nan)
    if len(c) >= w:
        lo = np.lib.stride_tricks.sliding_window_view(low, w).min(1)
        hi = np.lib.stride_tricks.sliding_window_view(h, w).max(1)
        proximity[w - 1 :] = (low[w - 1 :] - lo) / np.maximum(hi - lo, _EPS)
    x = np.diff(np.log(c), prepend=np.log(c[:1]))
    signed = (2 * (c - low) / span - 1).clip(-1, 1)
    return {"proximity": proximity, "signed": signed, "imbalance": np.abs(signed), "body": body / span, "wick": np.minimum(span / np.maximum(body, _EPS), 100), "rv": realised(x, VOLATILITY_CYCLES * d), "x": x}


def fence(q1: float, q3: float) -> float:
    return q3 + 1.5 * (q3 - q1)


def derive(o: np.ndarray, h: np.ndarray, low: np.ndarray, c: np.ndarray, v: np.ndarray, states: bool = True) -> dict[str, float]:
    """All priors of one series, from all its bars, by name; lists are numbered. The query m07_all_priors gives the same in many tasks."""
    r = np.diff(np.log(c)) if len(c) > 1 else np.zeros(0)
    d = dominant_cycle(r)
    b = by_bar(o, h, low, c, d)
    f: dict = {(k, p): float(np.percentile(z, p)) for k, ps in AT.items() if len(z := b[k][~np.isnan(b[k])]) for p in ps}
    f["wick_top"] = float(b["wick"].max()) if len(c) else 0.0
    rv = b["rv"][~np.isnan(b["rv"])]
    f["inside"] = float(np.mean(rv <= fence(f["rv", 25], f["rv", 75]))) if len(rv) else 1.0
    u = b["signed"][:-1]
    f["corr"] = float(np.corrcoef(u, r)[0, 1]) if len(r) > 2 and u.std() > 0 and r.std() > 0 else None
    f["states"] = best_states(np.stack([b["x"], np.nan_to_num(b["rv"])], 1)) if states and len(c) >= LEAST_STATES_BARS else 4
    return assemble(d, len(c), f, acf(r, most_lags(len(r), d)), noise(r), change_distance(r, d), cycle_ratio(r, d))


def assemble(d: int, bars: int, f: dict, a: np.ndarray, least: float, distance: float, ratio: float) -> dict[str, float]:
    """Priors from the cycle d, the number of bars, facts f of all bars (percentiles by (name, p)), autocorrelations a and the noise they must pass."""
    w = max(d // 12, 2)
    clipped = lambda k, p, lo, hi: float(np.clip(f[k, p], lo, hi)) if (k, p) in f else lo
    base = f.get(("rv", 50), 0.0035) or 0.0035
    out = {
        "dominant_cycle": d, "warmup_bars": min(max(2 * d, 500), max(bars // 2, 1)),
        "slot_00.window": w, "slot_00.decay": float(np.clip(math.exp(-1 / d), 0.5, 0.9999)), "slot_00.threshold": clipped("proximity", 5, 1e-6, 0.5),
        "slot_01.bucket": max(d // 6, 2), "slot_01.window": 4 * d, "slot_01.decay": math.exp(-1 / (2 * d)),
        "slot_02.window": d, "slot_03.short": max(d // 24, 2), "slot_03.long": max(2 * d, d // 24 + 1), "slot_04.window": max(2 * d, 50),
        "slot_06.window": max(d // 24, 5), "slot_07.window": max(d // 12, 2), "slot_07.lag": max(d // 96, 1),
        "slot_08.window": max(d, 128), "slot_08.refit": d, "slot_08.states": f["states"],
        "slot_09.threshold": clipped("imbalance", 85, 0.5, 0.99),
        "slot_10.body": clipped("body", 20, 0.05, 0.5), "slot_10.window": d, "slot_10.quantile": float(np.clip(f["wick", 99] / max(f["wick_top"], _EPS), 0.9, 0.999)) if ("wick", 99) in f else 0.99,
        "slot_11.lookback": d, "slot_11.strength": max(d // 96, 1), "slot_12.coefficient": float(np.clip(abs(f["corr"]) if f["corr"] is not None else 0.65, 0.3, 0.9)), "slot_12.window": max(d // 24, 5),
        "slot_13.window": d, "slot_13.bins": int(np.clip(math.ceil(1 + math.log2(d)), 5, 20)), "slot_14.window": 2 * d,
        "gate.baseline": base, "gate.low": float(np.clip(f.get(("rv", 5), base) / base, 0.1, 1.0)), "gate.high": float(np.clip(f.get(("rv", 95), base) / base, 1.0, 10.0)),
        "pooling.decay": math.exp(-1 / d), "pooling.percentile": float(np.clip(100 * f["inside"], 50, 98)),
        "aux.volatility": max(d // 12, 2), "aux.horizon": d, "forward_bars": d, "change_distance": distance, "cycle_ratio": ratio,
    }
    out |= {f"slot_05.lag{i}": k for i, k in enumerate(significant_lags(a, least))}
    out |= {f"slot_06.span{i}": k for i, k in enumerate(ribbon_spans(a, bars - 1, d))}
    return {k: float(x) for k, x in out.items()}


def patched(cfg: SlotConfig, p: dict[str, float]) -> SlotConfig:
    """A configuration with the derived priors in place of its values."""
    n = lambda k, old: int(p.get(k, old))
    lags = tuple(int(v) for k, v in sorted(p.items()) if k.startswith("slot_05.lag"))
    spans = tuple(int(v) for k, v in sorted(p.items()) if k.startswith("slot_06.span"))
    return replace(
        cfg,
        absorb_window=n("slot_00.window", cfg.absorb_window), absorb_decay=p.get("slot_00.decay", cfg.absorb_decay), absorb_threshold=p.get("slot_00.threshold", cfg.absorb_threshold),
        vpin_window=n("slot_01.window", cfg.vpin_window), spectral_window=n("slot_02.window", cfg.spectral_window), variance_short=n("slot_03.short", cfg.variance_short), variance_long=n("slot_03.long", cfg.variance_long),
        hurst_window=n("slot_04.window", cfg.hurst_window), lags=lags or cfg.lags, ribbon_spans=spans or cfg.ribbon_spans, ribbon_window=n("slot_06.window", cfg.ribbon_window),
        divergence_window=n("slot_07.window", cfg.divergence_window), divergence_lag=n("slot_07.lag", cfg.divergence_lag), regime_window=n("slot_08.window", cfg.regime_window), regime_count=n("slot_08.states", cfg.regime_count),
        vacuum_threshold=p.get("slot_09.threshold", cfg.vacuum_threshold), wick_body=p.get("slot_10.body", cfg.wick_body), wick_window=n("slot_10.window", cfg.wick_window), wick_quantile=p.get("slot_10.quantile", cfg.wick_quantile),
        pivot_lookback=n("slot_11.lookback", cfg.pivot_lookback), pivot_strength=n("slot_11.strength", cfg.pivot_strength), micro_coefficient=p.get("slot_12.coefficient", cfg.micro_coefficient), micro_window=n("slot_12.window", cfg.micro_window),
        entropy_window=n("slot_13.window", cfg.entropy_window), entropy_bins=n("slot_13.bins", cfg.entropy_bins), cycle_window=n("slot_14.window", cfg.cycle_window),
    )


def spearman(x: np.ndarray, y: np.ndarray) -> float:
    """Rank correlation with ranks by position among equals; 0 without spread."""
    if len(x) < 3 or np.ptp(x) == 0 or np.ptp(y) == 0:
        return 0.0
    a, b = (np.argsort(np.argsort(z, kind="stable"), kind="stable").astype(float) for z in (x, y))
    return float(np.corrcoef(a, b)[0, 1])


def pearson(x: np.ndarray, y: np.ndarray) -> float:
    return float(np.corrcoef(x, y)[0, 1]) if len(x) > 2 and x.std() > 0 and y.std() > 0 else 0.0


RELEVANCE = {"spearman": spearman, "pearson": pearson, "mutual_info": lambda x, y: mutual_information(x, y, max(2, math.ceil(1 + math.log2(max(len(x), 2)))))}


def adaptive_weights(x: dict[str, np.ndarray], y: np.ndarray, static: dict[str, float], metric: str = "spearman", short: int = 2_000, shrink: float = 0.65, stability: float = 1.0, previous: dict[str, float] | None = None, step: float = 0.3, low: float = 0.02, high: float = 0.18, whole: dict[str, float] | None = None) -> dict[str, float]:
    """Weights between the static ones and shares of relevance for y, the more so the surer the relevance is.

    Relevance is the mean absolute value over all rows (`whole`, where x and y hold only the last ones) and over the last
    `short`. Weights stay within bounds and within
    `step` of the previous ones and are then scaled to sum to 1, which may carry one over its bound."""
    f = RELEVANCE[metric]
    rel = {k: (abs(f(v, y) if whole is None else whole.get(k, 0.0)) + abs(f(v[-short:], y[-short:]))) / 2 for k, v in x.items()}
    noise = 7.0 / math.sqrt(max(min(short, len(y)) - 1, 1))
    beta = shrink * min(1.0, float(np.mean(sorted(rel.values(), reverse=True)[:3])) / noise) * stability
    total = sum(rel.values()) + _EPS
    w = {k: float(np.clip(beta * rel.get(k, 0.0) / total + (1 - beta) * s, low, high)) for k, s in static.items()}
    if previous:
        w = {k: float(np.clip(v, previous.get(k, static[k]) * (1 - step), previous.get(k, static[k]) * (1 + step))) for k, v in w.items()}
    total = sum(w.values())
    return {k: v / total for k, v in w.items()}
