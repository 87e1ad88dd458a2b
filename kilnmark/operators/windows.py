"""Rolling calculations with a least number of values, over blocks (see blocks) or any ordered window.

NaN never enters: callers turn it into null, which all of these skip, as a rolling calculation skips missing values.
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

EPS = 1e-12


def rows(w: WindowSpec, n: int) -> WindowSpec:
    """The last n rows, the present one included."""
    return w.rowsBetween(-(n - 1), 0)


def rolling(f: Column, x: Column, frame: WindowSpec, least: int) -> Column:
    """f over the frame if that holds at least `least` non-null values of x, else null."""
    return F.when(F.count(x).over(frame) >= least, f.over(frame))


def roll_mean(x: Column, w: WindowSpec, n: int, least: int | None = None) -> Column:
    return rolling(F.avg(x), x, rows(w, n), n if least is None else least)


def roll_std(x: Column, w: WindowSpec, n: int, least: int | None = None) -> Column:
    return rolling(F.stddev_samp(x), x, rows(w, n), n if least is None else least)


def roll_var(x: Column, w: WindowSpec, n: int, least: int | None = None) -> Column:
    return rolling(F.var_samp(x), x, rows(w, n), n if least is None else least)


def roll_min(x: Column, w: WindowSpec, n: int, least: int | None = None) -> Column:
    return rolling(F.min(x), x, rows(w, n), n if least is None else least)


def roll_max(x: Column, w: WindowSpec, n: int, least: int | None = None) -> Column:
    return rolling(F.max(x), x, rows(w, n), n if least is None else least)


def roll_quantile(x: Column, w: WindowSpec, n: int, q: float, least: int | None = None) -> Column:
    """Exact quantile with linear interpolation. Spark rebuilds the frame for every row: for n up to some hundreds."""
    return rolling(F.percentile(x, q), x, rows(w, n), n if least is None else least)


def clip(x: Column, low: float | None, high: float | None) -> Column:
    """x within bounds; null stays null, which greatest and least alone would lose."""
    y = x
    if low is not None:
        y = F.greatest(y, F.lit(float(low)))
    if high is not None:
        y = F.least(y, F.lit(float(high)))
    return F.when(x.isNotNull(), y)


def zscore(x: Column, w: WindowSpec, n: int, bound: float = 10.0) -> Column:
    """(x - rolling mean) / rolling deviation, the latter at least EPS, clipped to +-bound; null becomes 0."""
    f = rows(w, n)
    dev = F.greatest(F.coalesce(F.stddev_samp(x).over(f), F.lit(EPS)), F.lit(EPS))
    return F.coalesce(clip((x - F.avg(x).over(f)) / dev, -bound, bound), F.lit(0.0))


def minmax(x: Column, w: WindowSpec, n: int) -> Column:
    """Place of x between the rolling extremes, in [0, 1]."""
    f = rows(w, n)
    low, high = F.min(x).over(f), F.max(x).over(f)
    return clip((x - low) / (high - low + EPS), 0, 1)


def bound_norm(x: Column, low: float, high: float) -> Column:
    """Static bounds to [0, 1]: |x| / high where low is negative, else (x - low) / (high - low)."""
    if low < 0:
        return clip(F.abs(x), 0, high) / high
    return clip((x - low) / (high - low), 0, 1)


def log_return(c: Column, w: WindowSpec, k: int = 1) -> Column:
    """ln(c / c k rows before + EPS)."""
    return F.ln(c / F.lag(c, k).over(w) + EPS)


def corr(x: Column, y: Column, frame: WindowSpec | None = None) -> Column:
    """Pearson correlation of the pairs without nulls; null where either doesn't vary, which the built-in form takes
    for a division by zero."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    over = lambda c: c if frame is None else c.over(frame)
    d = over(F.stddev_pop(x)) * over(F.stddev_pop(y))
    return F.when(d > 0, over(F.covar_pop(x, y)) / d)


def autocorrelation(x: Column, lagged: Column, w: WindowSpec, n: int, k: int) -> Column:
    """Correlation of x with itself k rows before, over the n - k pairs in a window of n rows.

    lagged: a column that holds x of k rows before. Null without variance or with missing pairs."""
    f = w.rowsBetween(-(n - 1) + k, 0)
    full = F.count(F.when(x.isNotNull() & lagged.isNotNull(), 1)).over(f) >= n - k
    return F.when(full, corr(x, lagged, f))


def forward_max(x: Column, w: WindowSpec, n: int, least: int = 1) -> Column:
    return rolling(F.max(x), x, w.rowsBetween(1, n), least)


def forward_min(x: Column, w: WindowSpec, n: int, least: int = 1) -> Column:
    return rolling(F.min(x), x, w.rowsBetween(1, n), least)
