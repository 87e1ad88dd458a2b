"""Queries over series of bars: windows, joins along time, features, outcomes."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import slots as S
from ..functions.slots import SlotConfig
from ..operators import bars as B
from ..operators import joins, outcomes
from ..operators import windows as W
from ..operators.blocks import CORE, IDX, along, core, cumulative, positions, with_halo
from ..session import table
from .common import Registry, bars, r6, sigs, sql, us

q = Registry()
CFG = SlotConfig()
RET = 'b as (select *, ln("close" / lag("close") over w + 1e-12) as r, coalesce("close" / lag("close") over w - 1, 0.0) as pct, row_number() over w - 1 as idx from bars window w as (partition by symbol order by ts))'


def windowed(spark: SparkSession, sf_dir: str, stages, out: dict[str, Column], back: int, ahead: int = 0, prepare=None) -> DataFrame:
    df = with_halo(positions(bars(spark, sf_dir), "symbol", ["ts"]), back, ahead)
    df = S.staged(df, [*(stages(along()) if stages else [])])
    return core(df).select("symbol", us("ts").alias("ts_us"), *[c.alias(k) for k, c in out.items()])


def _w(n: int) -> str:
    return f"(partition by symbol order by ts rows between {n - 1} preceding and current row)"


def _gate(expr: str, x: str, n: int, least: int | None = None) -> str:
    return f"case when count({x}) over {_w(n)} >= {n if least is None else least} then {expr} over {_w(n)} end"


def _plain(select: str, *more: str) -> str:
    return sql(f"select symbol, ts_us, {select} from b", RET, *more)


R = {"r": lambda w: W.log_return(F.col("close"), w)}


def _r(w):
    return {"r": W.log_return(F.col("close"), w), "pct": F.coalesce(F.col("close") / F.lag("close").over(w) - 1, F.lit(0.0))}


@q("w01_returns", _plain('round(lag("close") over (partition by symbol order by ts), 6) as previous, round(pct, 8) as change, round(r, 8) as log_return'))
def w01(spark, sf_dir):
    return windowed(spark, sf_dir, lambda w: [{**_r(w), "previous": F.lag("close").over(w)}], {"previous": r6("previous"), "change": r6("pct", 8), "log_return": r6("r", 8)}, 1)


@q("w02_rolling_extremes", _plain(f'{_gate("min(low)", "low", 24)} as lowest, {_gate("max(high)", "high", 24)} as highest'))
def w02(spark, sf_dir):
    return windowed(spark, sf_dir, lambda w: [{"lowest": W.roll_min(F.col("low"), w, 24), "highest": W.roll_max(F.col("high"), w, 24)}], {"lowest": F.col("lowest"), "highest": F.col("highest")}, 24)


@q("w03_rolling_mean", _plain(f'round({_gate("avg(close)", "close", 24)} / "close", 9) as mean_ratio'))
def w03(spark, sf_dir):
    return windowed(spark, sf_dir, lambda w: [{"mean": W.roll_mean(F.col("close"), w, 24)}], {"mean_ratio": r6(F.col("mean") / F.col("close"), 9)}, 24)


@q("w04_rolling_variance", _plain(f'round({_gate("var_samp(r)", "r", 12)}, 9) as variance, round({_gate("stddev_samp(r)", "r", 144)}, 7) as deviation'))
def w04(spark, sf_dir):
    return windowed(spark, sf_dir, lambda w: [_r(w), {"v": W.roll_var(F.col("r"), w, 12), "d": W.roll_std(F.col("r"), w, 144)}], {"variance": r6("v", 9), "deviation": r6("d", 7)}, 146)


def _zscore(x: str, n: int) -> str:
    return f"coalesce(case when {x} is not null then greatest(-10.0, least(10.0, ({x} - avg({x}) over {_w(n)}) / greatest(coalesce(stddev_samp({x}) over {_w(n)}, 1e-12), 1e-12))) end, 0.0)"


@q("w05_zscore", _plain(f"round({_zscore('pct', 12)}, 4) as z"))
def w05(spark, sf_dir):
    return windowed(spark, sf_dir, lambda w: [_r(w), {"z": W.zscore(F.col("pct"), w, 12)}], {"z": r6("z", 4)}, 14)


@q("w06_minmax", _plain(f'round(greatest(0.0, least(1.0, ("close" - min("close") over {_w(288)}) / (max("close") over {_w(288)} - min("close") over {_w(288)} + 1e-12))), 6) as place'))
def w06(spark, sf_dir):
    return windowed(spark, sf_dir, lambda w: [{"place": W.minmax(F.col("close"), w, 288)}], {"place": r6("place")}, 288)


@q("w07_bound_norm", _plain("round(least(abs(pct * 100), 5.0) / 5.0, 6) as signed_norm, round(greatest(0.0, least(1.0, (pct * 100 + 0.0) / 2.0)), 6) as unsigned_norm"))
def w07(spark, sf_dir):
    return windowed(spark, sf_dir, lambda w: [_r(w)], {"signed_norm": r6(W.bound_norm(F.col("pct") * 100, -5, 5)), "unsigned_norm": r6(W.bound_norm(F.col("pct") * 100, 0, 2))}, 1)


@q("w08_rolling_quantile", _plain(f'round(quantile_cont("close", 0.99) over {_w(48)} / "close", 9) as q99_ratio'))
def w08(spark, sf_dir):
    return windowed(spark, sf_dir, lambda w: [{"q99": W.roll_quantile(F.col("close"), w, 48, 0.99, 1)}], {"q99_ratio": r6(F.col("q99") / F.col("close"), 9)}, 48)


_AROUND = "(partition by symbol order by ts rows between 3 preceding and 3 following)"
_PIVOTS = f"""pv as (select *, case when count("high") over {_AROUND} >= 7 and "high" = max("high") over {_AROUND} then "high" end as pivot_high,
  case when count("high") over {_AROUND} >= 7 and "low" = min("low") over {_AROUND} then "low" end as pivot_low from b)"""
_LEVEL = "(partition by symbol order by ts rows between 143 preceding and 3 preceding)"


@q("w09_pivots", sql("select symbol, ts_us, pivot_high, pivot_low from pv where pivot_high is not null or pivot_low is not null", RET, _PIVOTS))
def w09(spark, sf_dir):
    got = windowed(spark, sf_dir, lambda w: S.pivots(w, CFG)[:1], {"pivot_high": F.col("pivot_high"), "pivot_low": F.col("pivot_low")}, 4, 4)
    return got.filter("pivot_high is not null or pivot_low is not null")


@q("w10_levels", sql(f"select symbol, ts_us, max(pivot_high) over {_LEVEL} as resist, min(pivot_low) over {_LEVEL} as support from pv", RET, _PIVOTS))
def w10(spark, sf_dir):
    return windowed(spark, sf_dir, lambda w: S.pivots(w, CFG)[:2], {"resist": F.col("resist"), "support": F.col("support")}, 150, 4)


_DECAY = "pow(1 - {a}::double, b.idx - f.idx) * case when f.idx = 0 then 1.0 else {a}::double end"


@q("w11_ewm", sql(f"""select b.symbol, b.ts_us, round(sum({_DECAY.format(a='(2.0::double / 22)')} * f."close"), 4) as ewm from b join b f on f.symbol = b.symbol and f.idx > b.idx - 450 and f.idx <= b.idx group by b.symbol, b.ts_us""", RET))
def w11(spark, sf_dir):
    """Exponentially weighted mean of the close, span 21: a block kernel; its halo is far longer than its memory."""
    import pyarrow as pa

    df = with_halo(positions(bars(spark, sf_dir), "symbol", ["ts"]), S.BACK)
    keep = df.select("symbol", "block", IDX, CORE, us("ts").alias("ts_us"), "close")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by(IDX)
        return t.append_column("ewm", pa.array(S.ewm(t["close"].to_numpy(), 21)))

    got = keep.groupBy("symbol", "block").applyInArrow(run, f"symbol string, block long, {IDX} long, {CORE} boolean, ts_us long, close double, ewm double")
    return got.filter(CORE).select("symbol", "ts_us", r6("ewm", 4).alias("ewm"))


@q("w17_rolling_max", _plain(f'max(volume) over {_w(288)} as peak'))
def w17(spark, sf_dir):
    return windowed(spark, sf_dir, lambda w: [{"peak": W.roll_max(F.col("volume"), w, 288, 1)}], {"peak": F.col("peak")}, 288)


@q("w18_volatility_change", sql("select symbol, ts_us, round(d - lag(d) over (partition by symbol order by ts), 8) as change from d", RET, f"d as (select *, {_gate('stddev_samp(r)', 'r', 48)} as d from b)"))
def w18(spark, sf_dir):
    return windowed(spark, sf_dir, lambda w: [_r(w), {"d": W.roll_std(F.col("r"), w, 48)}, {"change": F.col("d") - F.lag("d").over(w)}], {"change": r6("change", 8)}, 51)


@q("w19_horizon_volatility", _plain(f"round(coalesce(stddev_samp(r) over {_w(72)}, 0.0) * sqrt(72.0), 7) as volatility"))
def w19(spark, sf_dir):
    return windowed(spark, sf_dir, lambda w: [_r(w), {"v": F.coalesce(W.roll_std(F.col("r"), w, 72, 1), F.lit(0.0)) * math.sqrt(72)}], {"volatility": r6("v", 7)}, 73)


_NEXT = lambda n: f"(partition by symbol order by ts rows between 1 following and {n} following)"
_OUTCOME = f"""f as (select *, lead("open") over (partition by symbol order by ts) as entry, max("high") over {_NEXT(288)} as top, min("low") over {_NEXT(288)} as bottom, coalesce(r, 0) >= 0 as up from b),
o as (select *, case when entry is null then 0.0 when up then (top - entry) / (entry + 1e-12) else (entry - bottom) / (entry + 1e-12) end as gain,
  case when entry is null then 0.0 when up then (entry - bottom) / (entry + 1e-12) else (top - entry) / (entry + 1e-12) end as pain from f)"""


@q("w20_forward_outcomes", sql("select symbol, ts_us, round(greatest(gain, 0.0), 4) as mfe, round(greatest(pain, 0.0), 4) as mae, round(greatest(least(gain / (pain + 1e-12), 50.0), 0.0), 4) as recovery from o", RET, _OUTCOME))
def w20(spark, sf_dir):
    got = windowed(spark, sf_dir, lambda w: [_r(w), *outcomes.excursions(w, 288, F.coalesce("r", F.lit(0.0)) >= 0)], {"mfe": r6("mfe", 4), "mae": r6("mae", 4), "recovery": r6("recovery", 4)}, 2, 289)
    return got


@q("w21_forward_returns", _plain(f"""round(lead("close", 12) over (partition by symbol order by ts) / "close" - 1, 8) as ret, case when count("high") over {_NEXT(12)} >= 12 then max("high") over {_NEXT(12)} end as top,
  case when count("low") over {_NEXT(12)} >= 12 then min("low") over {_NEXT(12)} end as bottom"""))
def w21(spark, sf_dir):
    stages = lambda w: [{"ret": F.lead("close", 12).over(w) / F.col("close") - 1, "top": W.forward_max(F.col("high"), w, 12, 12), "bottom": W.forward_min(F.col("low"), w, 12, 12)}]
    return windowed(spark, sf_dir, stages, {"ret": r6("ret", 8), "top": F.col("top"), "bottom": F.col("bottom")}, 0, 13)


@q("w22_bars_to_peak", sql(f"""select symbol, ts_us, min(case when f."high" = t.top then f.idx - t.idx end) as to_top, min(case when f."low" = t.bottom then f.idx - t.idx end) as to_bottom from t
  join (select symbol as s, idx, "high", "low" from b) f on f.s = t.symbol and f.idx > t.idx and f.idx <= t.idx + 24 group by symbol, ts_us""", RET, f't as (select symbol, ts_us, idx, max("high") over {_NEXT(24)} as top, min("low") over {_NEXT(24)} as bottom from b)'))
def w22(spark, sf_dir):
    got = windowed(spark, sf_dir, lambda w: outcomes.first_peaks(w, 24), {"to_top": F.col("to_top"), "to_bottom": F.col("to_bottom")}, 0, 25)
    return got.filter("to_top is not null")


@q("w23_forward_volatility", _plain(f'round(stddev_pop(ln("close")) over {_NEXT(72)}, 7) as volatility'))
def w23(spark, sf_dir):
    return windowed(spark, sf_dir, lambda w: [{"v": F.stddev_pop(F.ln("close")).over(w.rowsBetween(1, 72))}], {"volatility": r6("v", 7)}, 0, 73)


@q("w24_expanding_volatility", sql("select symbol, ts_us, round(stddev_pop(coalesce(r, 0.0)) over (partition by symbol order by ts rows between unbounded preceding and current row), 7) as volatility from b", RET))
def w24(spark, sf_dir):
    df = core(S.staged(with_halo(positions(bars(spark, sf_dir), "symbol", ["ts"]), 1), [_r(along()), {"x": F.coalesce("r", F.lit(0.0))}]))
    df = cumulative(df.withColumns({"x2": F.col("x") * F.col("x"), "one": F.lit(1.0)}), {"sx": ("x", "sum"), "sxx": ("x2", "sum"), "n": ("one", "sum")})
    v = F.greatest(F.col("sxx") / F.col("n") - (F.col("sx") / F.col("n")) * (F.col("sx") / F.col("n")), F.lit(0.0))
    return df.select("symbol", us("ts").alias("ts_us"), r6(F.sqrt(v), 7).alias("volatility"))


@q("w29_cusum", sql("""select symbol, ts_us, round(distance, 4) as distance from (
  select symbol, ts_us, abs(s) as distance, row_number() over (partition by symbol order by abs(s) desc, ts) as k from (
    select *, sum(x - m) over (partition by symbol order by ts rows between unbounded preceding and current row) as s, count(*) over (partition by symbol) as n from (
      select *, 1e6 * r * r as x, avg(1e6 * r * r) over (partition by symbol) as m from b where r is not null) t) u
  where idx >= 0.1 * n and idx <= 0.9 * n) v where k = 1""", RET))
def w29(spark, sf_dir):
    """Where each symbol's variance changed most: the largest cumulated deviation of squared returns, margins aside."""
    df = core(S.staged(with_halo(positions(bars(spark, sf_dir), "symbol", ["ts"]), 1), [_r(along())])).filter("r is not null").withColumn("x", 1e6 * F.col("r") * F.col("r"))
    mean = df.groupBy("symbol").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    df = cumulative(df.join(mean, "symbol").withColumn("d", F.col("x") - F.col("m")), {"s": ("d", "sum")})
    inside = df.filter((F.col(IDX) >= 0.1 * F.col("n")) & (F.col(IDX) <= 0.9 * F.col("n")))
    best = inside.groupBy("symbol").agg(F.max(F.struct(F.abs("s").alias("distance"), (-us("ts")).alias("t"))).alias("b"))
    return best.select("symbol", (-F.col("b.t")).alias("ts_us"), r6("b.distance", 4).alias("distance"))


@q("w30_gaps", sql("""select symbol, from_us, to_us, steps from (select symbol, ts_us as to_us, lag(ts_us) over (partition by symbol order by ts) as from_us,
  (ts_us - lag(ts_us) over (partition by symbol order by ts)) // (cast(s as bigint) * 1000000) as steps from bars join (values ('1m', 60), ('5m', 300), ('15m', 900), ('1h', 3600)) x(i, s) on i = iv) t
  where steps > 1 order by steps desc, symbol, to_us limit 20"""))
def w30(spark, sf_dir):
    """The 20 longest gaps of all symbols, in grid steps."""
    from ..functions.instants import interval_seconds

    df = with_halo(positions(bars(spark, sf_dir), "symbol", ["ts"]), 1).withColumn("to_us", us("ts"))
    df = core(df.withColumn("from_us", F.lag("to_us").over(along())))
    df = df.withColumn("steps", F.expr("(to_us - from_us)") / (interval_seconds(F.col("interval")) * 1_000_000)).withColumn("steps", F.floor("steps").cast("long"))
    return df.filter("steps > 1").orderBy(F.desc("steps"), "symbol", "to_us").limit(20).select("symbol", "from_us", "to_us", "steps")


@q("w31_running", sql('select symbol, ts_us, round(sum(pct) over x, 8) as total, max("close") over x as peak, round(max("close") over x - "close", 6) as below from b window x as (partition by symbol order by ts rows between unbounded preceding and current row)', RET))
def w31(spark, sf_dir):
    df = core(S.staged(with_halo(positions(bars(spark, sf_dir), "symbol", ["ts"]), 1), [_r(along())]))
    df = cumulative(df, {"total": ("pct", "sum"), "peak": ("close", "max")})
    return df.select("symbol", us("ts").alias("ts_us"), r6("total", 8).alias("total"), "peak", r6(F.col("peak") - F.col("close")).alias("below"))


@q("w33_value_ranks", sql('select symbol, ts_us, cast(row_number() over (partition by symbol order by volume, ts) - 1 as bigint) as place from bars'))
def w33(spark, sf_dir):
    """Rank by value, ties by time: positions in an order over all partitions, not a window per symbol."""
    df = bars(spark, sf_dir).select("symbol", "volume", us("ts").alias("ts_us"))
    return positions(df, "symbol", ["volume", "ts_us"], "place").select("symbol", "ts_us", "place")


@q("w34_spearman", sql("""select symbol, round(corr(ra, rb), 6) as rho from (
  select symbol, rank() over (partition by symbol order by volume) + (count(*) over (partition by symbol, volume) - 1) / 2.0 as ra,
   rank() over (partition by symbol order by span) + (count(*) over (partition by symbol, span) - 1) / 2.0 as rb
  from (select symbol, volume, "high" - "low" as span from bars) t) u group by symbol"""))
def w34(spark, sf_dir):
    """Rank correlation of volume and range, ties at their mean rank."""
    df = bars(spark, sf_dir).select("symbol", us("ts").alias("t"), "volume", (F.col("high") - F.col("low")).alias("span"))
    for c, name in (("volume", "ra"), ("span", "rb")):
        df = mean_ranks(df, "symbol", c, "t", name)
    return df.groupBy("symbol").agg(r6(W.corr(F.col("ra"), F.col("rb"))).alias("rho"))


def mean_ranks(df: DataFrame, series: str, c: str, unique: str, name: str) -> DataFrame:
    placed = positions(df, series, [c, unique], "_p")
    ties = placed.groupBy(series, c).agg(F.min("_p").alias("_m"), F.count("*").alias("_k")).select(F.col(series).alias("_s"), F.col(c).alias("_c"), (F.col("_m") + 1 + (F.col("_k") - 1) / 2).alias(name))
    return placed.drop("_p").join(ties, F.col(series).eqNullSafe(F.col("_s")) & F.col(c).eqNullSafe(F.col("_c"))).drop("_s", "_c")


# ---- Slots -----------------------------------------------------------------------------------------------------

_BVC = f"""z as (select *, case when count(pct) over {_w(20)} > 1 then greatest(-10.0, least(10.0, (pct - avg(pct) over {_w(20)}) / greatest(stddev_samp(pct) over {_w(20)}, 1e-12))) end as z from b),
v as (select *, volume / (1 + exp(-1.5 * z)) as buy, volume - volume / (1 + exp(-1.5 * z)) as sell from z),
i as (select *, case when buy is not null then abs(buy - sell) / greatest(buy + sell, 1e-12) end as imb, (buy - sell) / greatest(buy + sell, 1e-12) as tilt from v)"""


@q("f33_volume_split", sql("select symbol, ts_us, round(buy, 2) as buy, round(sell, 2) as sell from v", RET, _BVC))
def f33(spark, sf_dir):
    return windowed(spark, sf_dir, lambda w: S.base(w, CFG), {"buy": r6("buy", 2), "sell": r6("sell", 2)}, 22)


@q("f34_hash_split", sql("""select symbol, ts_us, round(volume * share, 2) as buy, round(volume * (1 - share), 2) as sell from (select *, cast(('0x' || substr(sha256(cast(ts_us as varchar)), 1, 16)) as ubigint) / 18446744073709551616.0 as share from bars) t"""))
def f34(spark, sf_dir):
    df = bars(spark, sf_dir).withColumn("ts_us", us("ts"))
    buy, sell = S.hash_split(F.col("volume"), F.col("ts_us").cast("string"))
    return df.select("symbol", "ts_us", r6(buy, 2).alias("buy"), r6(sell, 2).alias("sell"))


def _slot(name: str, text: str | None = None, digits: int = 5):
    def run(spark, sf_dir, name=name):
        return S.single_slot(bars(spark, sf_dir), name).select("symbol", us("ts").alias("ts_us"), r6(name, digits).alias(name))

    q(f"f{name[5:]}_{name}", text)(run)


# Full windows of returns without gaps, as lists, with their mean and deviation.
_LISTS = """li as (select * from (select symbol, ts_us, list(r) over f as l, avg(r) over f as m, stddev_pop(r) over f as d, count(r) over f as n from b window f as (partition by symbol order by ts rows between {n} - 1 preceding and current row)) q where n = {n})"""
_LAGS = ", ".join(f"lag(r, {k}) over (partition by symbol order by ts) as r{k}" for k in range(1, 6))


def _ac(k: int) -> str:
    f = f"(partition by symbol order by ts rows between {47 - k} preceding and current row)"
    return f"""case when count(r) over {_w(48)} >= 48 and count(case when r is not null and r{k} is not null then 1 end) over {f} >= {48 - k} and var_pop(case when r is not null and r{k} is not null then r end) over {f} > 0
  and var_pop(case when r is not null and r{k} is not null then r{k} end) over {f} > 0 then abs(corr(r, r{k}) over {f}) end as a{k}"""


_slot(
    "slot_00",
    sql(
        "select symbol, ts_us, round(greatest(-1.0, least(1.0, (bought - sold) / (bought + sold + 1e-12))), 5) as slot_00 from e",
        RET,
        _BVC,
        "x as (select *, " + _gate('min("low")', '"low"', 24) + " as lo, " + _gate('max("high")', '"high"', 24) + " as hi from i)",
        'n as (select symbol, ts_us, idx, case when lo is not null and ("low" - lo) / greatest(hi - lo, 1e-12) < 0.05 then buy else 0.0 end as at_low, case when lo is not null and (hi - "high") / greatest(hi - lo, 1e-12) < 0.05 then sell else 0.0 end as at_high from x)',
        f"e as (select b.symbol, b.ts_us, sum({_DECAY.format(a='(2.0::double / 2.2)')} * f.at_low) as bought, sum({_DECAY.format(a='(2.0::double / 2.2)')} * f.at_high) as sold from n b join n f on f.symbol = b.symbol and f.idx > b.idx - 340 and f.idx <= b.idx group by b.symbol, b.ts_us)",
    ),
)
_slot("slot_01", sql(f"select symbol, ts_us, round(coalesce({_gate('avg(imb)', 'imb', 100)}, 0.0), 5) as slot_01 from i", RET, _BVC))
_slot(
    "slot_02",
    sql(
        """select b.symbol, b.ts_us, round(coalesce(h, 0.0), 5) as slot_02 from b left join (
  select symbol, ts_us, case when max(total) < 1e-12 then 0.0 else -sum(case when p / greatest(total, 1e-12) > 1e-12 then p / greatest(total, 1e-12) * ln(p / greatest(total, 1e-12)) else 0.0 end) end as h
  from (select *, sum(p) over (partition by symbol, ts_us) as total from pw) y group by symbol, ts_us) z on z.symbol = b.symbol and z.ts_us = b.ts_us""",
        RET,
        _LISTS.format(n=72),
        "ks as (select k, list(cos(2 * pi() * k * j / 72) order by j) as c, list(sin(2 * pi() * k * j / 72) order by j) as s from range(0, 37) a(k), range(0, 72) d(j) group by k)",
        "pw as (select symbol, ts_us, pow(list_inner_product(v, c), 2) + pow(list_inner_product(v, s), 2) as p from (select symbol, ts_us, list_transform(l, lambda x: x - m) as v from li) u, ks)",
    ),
)
_slot("slot_03", sql(f"select symbol, ts_us, round(coalesce(ln(({_gate('var_samp(r)', 'r', 12)} + 1e-12) / ({_gate('var_samp(r)', 'r', 144)} + 1e-12)), 0.0), 5) as slot_03 from b", RET))
_slot(
    "slot_04",
    sql(
        """select b.symbol, b.ts_us, round(case when d is null or d < 1e-12 or span / (d + 1e-12) < 1e-12 then 0.0 else 0.5 - ln(span / (d + 1e-12)) / ln(120) end, 5) as slot_04 from b left join (
  select symbol, ts_us, max(c) - min(c) as span, any_value(d) as d from (select symbol, ts_us, d, sum(x - m) over (partition by symbol, ts_us order by j) as c from (select symbol, ts_us, m, d, unnest(l) as x, unnest(range(0, 120)) as j from li) u) y group by symbol, ts_us) z
  on z.symbol = b.symbol and z.ts_us = b.ts_us""",
        RET,
        _LISTS.format(n=120),
    ),
)
_slot(
    "slot_05",
    sql(
        "select symbol, ts_us, round(coalesce((coalesce(a1, 0) + coalesce(a2, 0) + coalesce(a3, 0) + coalesce(a4, 0) + coalesce(a5, 0)) / nullif((a1 is not null)::int + (a2 is not null)::int + (a3 is not null)::int + (a4 is not null)::int + (a5 is not null)::int, 0), 0.0), 5) as slot_05 from a",
        RET,
        f"l as (select *, {_LAGS} from b)",
        f"a as (select *, {', '.join(_ac(k) for k in range(1, 6))} from l)",
    ),
)
_RIBBON = ", ".join(f"abs(any_value(b.\"close\") - sum({_DECAY.format(a=f'(2.0::double / {s + 1})')} * f.\"close\"))" for s in CFG.ribbon_spans)
_slot(
    "slot_06",
    sql(
        f"select symbol, ts_us, round(coalesce(greatest(-10.0, least(10.0, (x - avg(x) over {_w(12)}) / greatest(stddev_samp(x) over {_w(12)}, 1e-12))), 0.0), 4) as slot_06 from x",
        RET,
        f"x as (select b.symbol, b.ts_us, any_value(b.ts) as ts, list_avg([{_RIBBON}]) as x from b join b f on f.symbol = b.symbol and f.idx > b.idx - 1100 and f.idx <= b.idx group by b.symbol, b.ts_us)",
    ),
    4,
)
_slot(
    "slot_07",
    sql(
        f"select symbol, ts_us, round({_zscore('d', 24)}, 4) as slot_07 from d",
        RET,
        _BVC,
        "p as (select *, r - lag(r, 3) over w as accel, coalesce(ln((buy + sell + 1e-12) / (lag(buy + sell, 3) over w + 1e-12)), 0.0) as vchg from i window w as (partition by symbol order by ts))",
        "g as (select *, abs(accel) - abs(vchg) as apart from p)",
        f"d as (select *, {_gate('avg(apart)', 'apart', 24)} as d from g)",
    ),
    4,
)
_slot("slot_08", sql("select symbol, ts_us, case when vol > max(vol) over (partition by symbol order by ts rows unbounded preceding) * 0.75 then 1.0 else 0.0 end as slot_08 from v8", RET, f"v8 as (select *, coalesce({_gate('stddev_samp(coalesce(r, 0.0))', 'coalesce(r, 0.0)', 288)}, 0.0) as vol from b)"))
_slot("slot_09", sql("select symbol, ts_us, round(coalesce(case when imb is not null then greatest(0.0, least(1.0, (imb - 0.85) / (1 - 0.85 + 1e-12))) end, 0.0), 5) as slot_09 from i", RET, _BVC))
_slot(
    "slot_10",
    sql(
        f"select symbol, ts_us, round(greatest(0.0, least(1.0, s / greatest(max(s) over {_w(288)}, 1e-12))), 5) as slot_10 from k",
        RET,
        'x as (select *, greatest("high" - "low", 1e-12) as span, greatest(abs("close" - "open"), 1e-12) as body from b)',
        "y as (select *, least(span / body, 100.0) as wick, case when body / span < 0.15 then 1.0 else 0.0 end as doji from x)",
        f"k as (select *, least(wick * doji, quantile_cont(wick, 0.99) over {_w(288)}) as s from y)",
    ),
)
_slot(
    "slot_11",
    sql(
        """select symbol, ts_us, round(coalesce(case when resist is not null or support is not null then exp(-least(case when resist is null then abs("close" - support) / ("close" * 0.005 + 1e-12) when support is null then abs(resist - "close") / ("close" * 0.005 + 1e-12)
   else least(abs(resist - "close"), abs("close" - support)) / ("close" * 0.005 + 1e-12) end, 10.0)) end, 0.0), 5) as slot_11 from n""",
        RET,
        _PIVOTS,
        f"n as (select *, max(pivot_high) over {_LEVEL} as resist, min(pivot_low) over {_LEVEL} as support from pv)",
    ),
)
_slot("slot_12", sql(f"select symbol, ts_us, round({_zscore('m', 12)}, 4) as slot_12 from m", RET, _BVC, 'm as (select *, "close" * (1 + 0.65 * tilt) - "close" as m from i)'), 4)
_BIN = "least(9, greatest(0, cast(trunc((x - lo) / (hi - lo) * 10) as integer)))"
_slot(
    "slot_13",
    sql(
        """select b.symbol, b.ts_us, round(coalesce(h, 0.0), 5) as slot_13 from b left join (
  select symbol, ts_us, -sum(n / 96.0::double * ln(n / 96.0::double + 1e-12)) as h from (select symbol, ts_us, bin, count(*) as n from k group by symbol, ts_us, bin) y group by symbol, ts_us) z on z.symbol = b.symbol and z.ts_us = b.ts_us""",
        RET,
        _LISTS.format(n=96),
        "g as (select symbol, ts_us, case when hi = lo then lo - 0.5 else lo end as lo, case when hi = lo then hi + 0.5 else hi end as hi, unnest(l) as x from (select symbol, ts_us, l, list_min(l) as lo, list_max(l) as hi from li) u)",
        f"f as (select *, (hi - lo) / 10 as width, {_BIN} as i from g)",
        "h as (select *, case when x < lo + i * width then i - 1 else i end as i1 from f)",
        "k as (select symbol, ts_us, least(9, greatest(0, case when i1 < 9 and x >= lo + (i1 + 1) * width then i1 + 1 else i1 end)) as bin from h)",
    ),
)
_slot(
    "slot_14",
    sql(
        f"""select symbol, ts_us, round(case when count(*) over {_w(200)} >= 200 then greatest(0.0, least(1.0, raw / greatest(max(raw) over {_w(200)}, 1e-12))) else 0.0 end, 5) as slot_14
  from (select b.symbol, b.ts, b.ts_us, coalesce(speed, 0.0) as raw from b left join sp on sp.symbol = b.symbol and sp.ts_us = b.ts_us) z""",
        RET,
        "li as (select * from (select symbol, ts_us, list(coalesce(r, 0.0)) over f as l, avg(coalesce(r, 0.0)) over f as m, count(*) over f as n from b window f as (partition by symbol order by ts rows between 199 preceding and current row)) q where n = 200)",
        # The discrete Hilbert transform of an even window, row by row; the phase's steps are taken within half a turn.
        "hk as (select k, list(case when (k - j) % 2 <> 0 then 0.01 / tan(pi() * (k - j) / 200) else 0.0 end order by j) as h from range(0, 200) a(k), range(0, 200) d(j) group by k)",
        "ph as (select symbol, ts_us, k, atan2(list_inner_product(v, h), v[k + 1]) as phase from (select symbol, ts_us, list_transform(l, lambda x: x - m) as v from li) u, hk)",
        "st as (select symbol, ts_us, phase - lag(phase) over (partition by symbol, ts_us order by k) as d from ph)",
        "sp as (select symbol, ts_us, avg(abs(d - 2 * pi() * round(d / (2 * pi())))) as speed from st group by symbol, ts_us)",
    ),
)


def _composite_sql() -> tuple[list[str], str]:
    """Common tables of every slot without rounding, and the composite: static bounds or the range of 288 rows."""
    tables, names = [], [f"slot_{i:02d}" for i in range(15)]
    for n in names:
        text = re.sub(rf", \d\)( \+ 0\.0\))? as {n}\s+from", rf", 290)\1 as {n} from", q.sql[f"f{n[5:]}_{n}"])
        tables.append(f"{n}_t as ({text})")
    terms = []
    for n, weight in CFG.weights.items():
        low, high = CFG.bounds.get(n, (None, None))
        if low is None:
            y = f"({n} - min({n}) over {_w(288)}) / greatest(max({n}) over {_w(288)} - min({n}) over {_w(288)}, 1e-12)"
        else:
            y = f"least(abs({n}), {high}) / ({high} + 1e-12)" if low < 0 else f"(least(greatest({n}, {low}), {high}) - {low}) / ({high} - {low} + 1e-12)"
        terms.append(f"{weight}::double * coalesce(least(1.0, greatest(0.0, {y})), 0.0)")
    joined = " ".join(f"join {n}_t using (symbol, ts_us)" for n in names[1:])
    tables.append(f"slots as (select symbol, ts_us, ts_us as ts, {', '.join(names)} from slot_00_t {joined})")
    tables.append(f"composite as (select *, least(1.0, greatest(0.0, {' + '.join(terms)})) as slot_15 from slots)")
    return tables, ", ".join(f"round({n}, 5) + 0.0 as {n}" for n in [*names, "slot_15"])


_COMPOSITE, _ROUNDED = _composite_sql()


@q("f15_composite", f"with {', '.join(_COMPOSITE)} select symbol, ts_us, {_ROUNDED} from composite")
def f15(spark, sf_dir):
    """All slots and the composite of every bar."""
    df = core(S.all_slots(bars(spark, sf_dir)))
    return df.select("symbol", us("ts").alias("ts_us"), *[r6(f"slot_{i:02d}", 5).alias(f"slot_{i:02d}") for i in range(16)])


# ---- Signatures from bars --------------------------------------------------------------------------------------


_AHEAD = "over (partition by b.symbol order by b.ts rows between 1 following and 288 following)"
_FOLLOWED = [
    f'fo as (select b.symbol, b.ts, b.ts_us, idx, r, slot_00, slot_15, lead("open") over (partition by b.symbol order by b.ts) as entry, max("high") {_AHEAD} as top, min("low") {_AHEAD} as bottom, count(*) {_AHEAD} as coming from b join composite c on c.symbol = b.symbol and c.ts_us = b.ts_us)',
    f"vo as (select *, {_gate('stddev_samp(r)', 'r', 48)} as vol48, coalesce({_gate('stddev_samp(r)', 'r', 72, 1)}, 0.0) as vol72, (top - entry) / (entry + 1e-12) as up, (entry - bottom) / (entry + 1e-12) as down from fo)",
    "ga as (select *, coalesce(vol48 - lag(vol48) over (partition by symbol order by ts), 0.0) as slot_24, coalesce(case when slot_00 >= 0 then up else down end, 0.0) as gain, coalesce(case when slot_00 >= 0 then down else up end, 0.0) as pain from vo)",
    "si as (select *, least(50.0, greatest(0.0, gain / (pain + 1e-12))) as recovery from ga where idx >= 500 and coming = 288 and slot_15 >= 0)",
]


@q(
    "f20_signatures",
    sql(
        """select symbol, ts_us, true as signature_flag, round(slot_15, 5) as slot_15, 0.05::double as neural_conviction, 0.0::double as conviction_threshold, round(slot_24, 5) as slot_24, round(slot_15 * (1 + vol72 * sqrt(72)), 5) as slot_25,
  round(abs(slot_15 - 0.05), 5) as slot_27, 0.0::double as slot_28, round(recovery, 5) as slot_30, round(slot_15, 5) as slot_31, round(greatest(gain, 0.0), 5) as mfe, round(greatest(pain, 0.0), 5) as mae, round(recovery, 5) as recovery_factor from si""",
        RET,
        *_COMPOSITE,
        *_FOLLOWED,
    ),
)
def signatures(spark, sf_dir):
    """Bars to signature rows: composite, gate, auxiliary and metadata slots, forward outcomes."""
    got = outcomes.signature_rows(bars(spark, sf_dir))
    return got.select("symbol", us("ts").alias("ts_us"), "signature_flag", *[r6(c, 5).alias(c) for c in ("slot_15", "neural_conviction", "conviction_threshold", "slot_24", "slot_25", "slot_27", "slot_28", "slot_30", "slot_31", "mfe", "mae", "recovery_factor")])


@q("f29_time_hash", sql("select symbol, ts_us, round(cast(('0x' || substr(sha256(cast(ts_us as varchar)), 1, 8)) as ubigint) / 4294967295.0, 8) as slot_29 from bars"))
def f29(spark, sf_dir):
    df = bars(spark, sf_dir).withColumn("ts_us", us("ts"))
    return df.select("symbol", "ts_us", r6(outcomes.time_hash(F.col("ts_us").cast("string")), 8).alias("slot_29"))


# ---- Pieces of series and joins along time ---------------------------------------------------------------------


@q("s01_bars", sql('select symbol, ts_us, round("open", 6) as o, round("high", 6) as h, round("low", 6) as l, round("close", 6) as c, round(volume, 4) as v from bars'))
def s01(spark, sf_dir):
    return bars(spark, sf_dir).select("symbol", us("ts").alias("ts_us"), r6("open").alias("o"), r6("high").alias("h"), r6("low").alias("l"), r6("close").alias("c"), r6("volume", 4).alias("v"))


_SPLIT = "2015-06-01 00:00:00"


@q("s02_incremental", f"""with st as (select symbol, datetime, "close", received_at, bar_id from ohlcv where datetime is not null and symbol is not null and received_at < timestamptz '{_SPLIT}+00'),
 la as (select symbol as s, max(datetime) as m from st group by symbol),
 al as (select * from st union all select o.symbol, o.datetime, o."close", o.received_at, o.bar_id from ohlcv o left join la on s = o.symbol where o.datetime is not null and o.symbol is not null and (m is null or o.datetime > m))
 select symbol, epoch_us(datetime) as ts_us, bar_id from (select *, row_number() over (partition by symbol, datetime order by received_at desc, bar_id desc) as k from al) t where k = 1""")
def s02(spark, sf_dir):
    """A store of what had been received by a moment, brought up to date with everything delivered."""
    t = table(spark, sf_dir, "ohlcv").filter("datetime is not null and symbol is not null").select("symbol", us("datetime").alias("ts_us"), "close", "received_at", "bar_id")
    got = B.append_new(t.filter(F.col("received_at").cast("timestamp") < F.lit(_SPLIT).cast("timestamp")), t, ["symbol", "ts_us"], "ts_us", ["received_at", "bar_id"])
    return got.select("symbol", "ts_us", "bar_id")


@q("s08_shard_slice", sql(f"""select symbol, ts_us, cast(idx as bigint) as bar_idx from b join (select symbol as s, min(idx) as a, max(idx) as z from b where ts_us >= 1430438400000000 and ts_us < 1433116800000000 group by symbol) e on s = symbol where idx >= a - 500 and idx <= z + 288""", RET))
def s08(spark, sf_dir):
    """May 2015 with 500 bars of warm-up and 288 bars to look ahead."""
    df = positions(bars(spark, sf_dir), "symbol", ["ts"])
    return B.shard_slice(df, "2015-05-01", "2015-06-01", 500, 288).select("symbol", us("ts").alias("ts_us"), "bar_idx")


@q("s09_causal_slice", sql("select symbol, ts_us, cast(idx as bigint) as bar_idx from b where ts_us >= 1430438400000000 and ts_us < 1433116800000000", RET))
def s09(spark, sf_dir):
    df = positions(bars(spark, sf_dir), "symbol", ["ts"])
    return B.shard_slice(df, "2015-05-01", "2015-06-01", 0, 0).select("symbol", us("ts").alias("ts_us"), "bar_idx")


_FUND = """fu as (select symbol as s, epoch_us(datetime) as f_us, max(funding_rate) as rate from funding where datetime is not null and symbol is not null group by symbol, datetime)"""


@q("j01_asof_funding", sql("""select symbol, ts_us, rate from (select symbol, ts_us, rate, row_number() over (partition by symbol, ts_us order by f_us desc) as k from bars left join fu on s = symbol and f_us <= ts_us) t where k = 1""", _FUND))
def j01(spark, sf_dir):
    """Every bar with the funding rate in force."""
    f = table(spark, sf_dir, "funding").select("symbol", us("datetime").alias("f_us"), F.col("funding_rate").alias("rate"))
    return joins.asof_backward(bars(spark, sf_dir).select("symbol", us("ts").alias("ts_us")), f, "symbol", "ts_us", "f_us", ["rate"])


_US = """us as (select * from (select *, row_number() over (partition by symbol, iv, ts order by ingested_at desc, sig_id desc) as kk from sigs where ts is not null and symbol is not null and iv is not null) t where kk = 1)"""


@q("j02_reindex_fill", sql("""select b.symbol, b.ts_us, case when u.symbol is null then 0.0 else u.quality end as quality, case when u.symbol is null then 0.0 else u.veto end as veto from bars b left join us u on u.symbol = b.symbol and epoch_us(u.ts) = b.ts_us""", _US))
def j02(spark, sf_dir):
    """Every bar with its signature's quality, 0 where it has none."""
    s = unique_sigs(spark, sf_dir).select("symbol", us("ts").alias("ts_us"), "quality", "veto")
    return joins.filled_from(bars(spark, sf_dir).select("symbol", us("ts").alias("ts_us")), s, ["symbol", "ts_us"], ["quality", "veto"])


def unique_sigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures with an instant, one per symbol, interval and instant: the one ingested last."""
    s = sigs(spark, sf_dir).filter("ts is not null and symbol is not null and iv is not null")
    rest = [c for c in s.columns if c not in ("symbol", "iv", "ts")]
    return s.groupBy("symbol", "iv", "ts").agg(F.max_by(F.struct(*rest), F.struct("ingested_at", "sig_id")).alias("_s")).select("symbol", "iv", "ts", "_s.*")


@q("j03_known_instants", sql("select u.sig_id from us u where exists (select 1 from bars b where b.symbol = u.symbol and b.ts_us = epoch_us(u.ts))", _US))
def j03(spark, sf_dir):
    s = unique_sigs(spark, sf_dir).withColumn("ts_us", us("ts"))
    return s.join(bars(spark, sf_dir).select("symbol", us("ts").alias("ts_us")), ["symbol", "ts_us"], "left_semi").select("sig_id")


@q("j04_lookup", sql("select u.sig_id, b.close as price, cast(b.idx as bigint) as bar_idx from us u join b on b.symbol = u.symbol and b.ts_us = epoch_us(u.ts)", _US, RET))
def j04(spark, sf_dir):
    s = unique_sigs(spark, sf_dir).select("sig_id", "symbol", us("ts").alias("ts_us"))
    b = positions(bars(spark, sf_dir), "symbol", ["ts"]).select("symbol", us("ts").alias("ts_us"), F.col("close").alias("price"), IDX)
    return s.join(b, ["symbol", "ts_us"], "left").filter("price is not null").select("sig_id", "price", IDX)


@q("j13_lag_alignment", sql("select symbol, ts_us, round(x, 8) as x, round(y, 8) as y from a where x is not null and y is not null", RET, f"""a as (select symbol, ts_us, lag(r, 12) over (partition by symbol order by ts) as x, case when count(pct) over {_w(12)} >= 12 then avg(pct) over {_w(12)} end as y from b)"""))
def j13(spark, sf_dir):
    stages = lambda w: [_r(w), {"x": F.lag("r", 12).over(w), "y": W.roll_mean(F.col("pct"), w, 12)}]
    return windowed(spark, sf_dir, stages, {"x": r6("x", 8), "y": r6("y", 8)}, 14).filter("x is not null and y is not null")


@q("j14_offset_gather", sql("select u.sig_id, cast(h as bigint) as offset_bars, f.close as price from us u join b on b.symbol = u.symbol and b.ts_us = epoch_us(u.ts) cross join (values (12), (36), (72)) o(h) join b f on f.symbol = b.symbol and f.idx = b.idx + h", _US, RET))
def j14(spark, sf_dir):
    """Close 12, 36 and 72 bars after each signature."""
    s = unique_sigs(spark, sf_dir).select("sig_id", "symbol", us("ts").alias("ts_us"))
    df = with_halo(positions(bars(spark, sf_dir), "symbol", ["ts"]), 0, 72)
    df = core(df.withColumns({f"c{h}": F.lead("close", h).over(along()) for h in (12, 36, 72)})).select("symbol", us("ts").alias("ts_us"), F.explode(F.array(*[F.struct(F.lit(h).cast("long").alias("offset_bars"), F.col(f"c{h}").alias("price")) for h in (12, 36, 72)])).alias("g"))
    return s.join(df, ["symbol", "ts_us"]).select("sig_id", "g.*").filter("price is not null")
