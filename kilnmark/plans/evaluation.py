"""Queries that evaluate signatures: folds, daily results, horizons, ablations, calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import p_values, t_of_r
from ..operators import joins, outcomes
from ..operators import windows as W
from ..operators.blocks import along, core, positions, with_halo
from ..operators.order_stats import exact_quantiles
from ..session import cut
from .archive import gain
from .common import Registry, bars, r6, sql, us
from .series import _NEXT, _OUTCOME, _US, RET, _r, mean_ranks, unique_sigs
from ..functions import slots as S

q = Registry()
WINDOW, STEP, LEAST = 90, 30, 200  # days of training, days of test, training rows that a fold needs


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each signature once with its day (days since 1970) and result."""
    return unique_sigs(spark, sf_dir).filter("mfe is not null and mae is not null").withColumn("day", F.datediff("ts", F.lit("1970-01-01").cast("date")).cast("long")).withColumn("ret", gain())


_T = "tr as (select *, date_diff('day', date '1970-01-01', cast(ts as date)) as day, mfe - mae as ret from us where mfe is not null and mae is not null)"
_FOLDS = f"""fo as (select k as fold, d0 + k * {STEP} as a, d0 + k * {STEP} + {WINDOW} as z from (select min(day) as d0, max(day) as d1 from tr) e, unnest(range(0, cast(greatest(0, ceil((d1 - d0 - {WINDOW}) / {STEP}.0)) as bigint))) u(k)),
fr as (select tr.*, fold, 'train' as part from tr join fo on day >= a and day < z union all select tr.*, fold, 'test' as part from tr join fo on day >= z and day < z + {STEP}),
ok as (select fold from fr group by fold having count(*) filter (part = 'train') >= {LEAST} and count(*) filter (part = 'test') > 0)"""


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir)
    e = t.agg(F.min("day"), F.max("day")).first()
    first, last = (0, 0) if e[0] is None else e
    return joins.fold_rows(t, "day", first, last, WINDOW, STEP)


def kept_folds(rows: DataFrame) -> DataFrame:
    n = rows.groupBy("fold").agg(F.count(F.when(F.col("part") == "train", 1)).alias("train"), F.count(F.when(F.col("part") == "test", 1)).alias("test"))
    return n.filter((F.col("train") >= LEAST) & (F.col("test") > 0)).select("fold")


@q("j06_folds", sql("select sig_id, cast(fold as bigint) as fold, part from fr", _US, _T, _FOLDS))
def j06(spark, sf_dir):
    return folded(spark, sf_dir).select("sig_id", "fold", "part")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kept fold the result of every test day between its first and last, 0 on days without trades."""
    rows = folded(spark, sf_dir)
    tests = rows.filter("part = 'test'").join(kept_folds(rows), "fold", "left_semi")
    by_day = tests.groupBy("fold", F.date_add(F.lit("1970-01-01").cast("date"), F.col("day").cast("int")).alias("date")).agg(F.sum("ret").alias("ret"))
    return joins.calendar_filled(by_day, "date", ["ret"], ["fold"])


_DAILY = """sp as (select fold, min(day) as a, max(day) as z from fr where part = 'test' and fold in (select fold from ok) group by fold),
da as (select sp.fold, d as day, coalesce(sum(ret), 0.0) as ret from sp cross join lateral (select unnest(range(cast(a as bigint), cast(z as bigint) + 1)) as d) x left join fr on fr.part = 'test' and fr.fold = sp.fold and fr.day = d group by sp.fold, d)"""


@q("j07_calendar_fill", sql("select cast(fold as bigint) as fold, cast(day as bigint) as day, round(ret, 6) as ret from da", _US, _T, _FOLDS, _DAILY))
def j07(spark, sf_dir):
    return daily(spark, sf_dir).select("fold", F.datediff("date", F.lit("1970-01-01").cast("date")).cast("long").alias("day"), r6("ret").alias("ret"))


@q("a16_daily_sums", sql("select cast(day as bigint) as day, round(sum(ret), 6) as ret, count(*) as n from tr group by day", _US, _T))
def a16(spark, sf_dir):
    return trades(spark, sf_dir).groupBy("day").agg(r6(F.sum("ret")).alias("ret"), F.count("*").alias("n"))


@q("a17_fold_sharpe", sql("select cast(fold as bigint) as fold, round(avg(ret) / (coalesce(stddev_samp(ret), 0) + 1e-12) * sqrt(365.0), 4) as sharpe, count(*) as days from da group by fold having count(*) > 1", _US, _T, _FOLDS, _DAILY))
def a17(spark, sf_dir):
    g = daily(spark, sf_dir).groupBy("fold").agg(F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"), F.count("*").alias("days")).filter("days > 1")
    return g.select("fold", r6(F.col("m") / (F.coalesce("s", F.lit(0.0)) + W.EPS) * F.sqrt(F.lit(365.0)), 4).alias("sharpe"), "days")


@q("a18_max_drawdown", sql("select round(max(peak - total), 6) as drawdown, count(*) as days from (select *, max(total) over (order by fold, day) as peak from (select *, sum(ret) over (order by fold, day) as total from da) t) u", _US, _T, _FOLDS, _DAILY))
def a18(spark, sf_dir):
    """Over the test days of all folds in a row: days, not trades, are few."""
    w = Window.orderBy("fold", "date").rowsBetween(Window.unboundedPreceding, 0)
    d = daily(spark, sf_dir).withColumn("total", F.sum("ret").over(w)).withColumn("peak", F.max("total").over(w))
    return d.agg(r6(F.max(F.col("peak") - F.col("total"))).alias("drawdown"), F.count("*").alias("days"))


# ---- Horizons --------------------------------------------------------------------------------------------------

HORIZONS = (12, 36, 72, 144, 288)


def horizon_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = with_halo(positions(bars(spark, sf_dir), "symbol", ["ts"]), 0, max(HORIZONS))
    df = core(df.withColumns({f"f{h}": F.lead("close", h).over(along()) / F.col("close") - 1 for h in HORIZONS}))
    s = unique_sigs(spark, sf_dir).select("symbol", us("ts").alias("ts_us"), "quality")
    both = df.withColumn("ts_us", us("ts")).join(s, ["symbol", "ts_us"]).filter("quality is not null")
    long = both.select("quality", F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"f{h}").alias("ret")) for h in HORIZONS])).alias("x")).select("quality", "x.*").filter("ret is not null")
    return long.groupBy("horizon").agg(W.corr(F.col("quality"), F.col("ret")).alias("r"), F.count("*").alias("n"))


_HZ = "hz as (" + " union all ".join(f"select {h} as horizon, u.quality, f.close / b.close - 1 as ret from us u join b on b.symbol = u.symbol and b.ts_us = epoch_us(u.ts) join b f on f.symbol = b.symbol and f.idx = b.idx + {h} where u.quality is not null" for h in HORIZONS) + ")"


@q("a29_horizon_study", sql("select horizon, n, round(r, 6) as r, round(r * sqrt((n - 2) / (1 - r * r)), 4) as t from (select horizon, count(*) as n, corr(quality, ret) as r from hz group by horizon) x where n > 2", _US, RET, _HZ))
def a29(spark, sf_dir):
    g = horizon_table(spark, sf_dir).filter("n > 2")
    return g.select("horizon", "n", r6("r").alias("r"), r6(t_of_r(F.col("r"), F.col("n")), 4).alias("t"))


def _p_sql(keys: str) -> str:
    """Two-sided p of tt(keys, t, v): one less the density between -|t| and |t|, by Simpson's rule."""
    density = "exp(lgamma((v + 1) / 2) - lgamma(v / 2) - 0.5 * ln(v * pi()) - (v + 1) / 2 * ln(1 + pow(abs(t) * j / 4000.0, 2) / v))"
    weight = "case when j in (0, 4000) then 1 when j % 2 = 1 then 4 else 2 end"
    return f"select {keys} round(any_value(t), 4) as t, round(greatest(0.0, 1 - 2 * any_value(abs(t)) / 12000.0 * sum({weight} * {density})), 6) as p from tt, range(0, 4001) g(j)"


@q("a29_horizon_p_values", sql(_p_sql("horizon,") + " group by horizon", _US, RET, _HZ, "tt as (select horizon, r * sqrt((n - 2) / (1 - r * r)) as t, (n - 2)::double as v from (select horizon, count(*) as n, corr(quality, ret) as r from hz group by horizon) x where n > 2 and abs(r) < 1)"))
def a29p(spark, sf_dir):
    g = horizon_table(spark, sf_dir).withColumn("t", t_of_r(F.col("r"), F.col("n"))).filter("t is not null")
    return g.select("horizon", r6("t", 4).alias("t"), r6(p_values(F.col("t"), (F.col("n") - 2).cast("double"))).alias("p"))


@q("o09_best_horizon", sql("select min(horizon) filter (k = 1) as best from (select *, row_number() over (order by abs(r * sqrt((n - 2) / (1 - r * r))) desc, horizon) as k from (select horizon, count(*) as n, corr(quality, ret) as r from hz group by horizon) x where n > 2) y", _US, RET, _HZ))
def o09(spark, sf_dir):
    g = horizon_table(spark, sf_dir).filter("n > 2").withColumn("t", F.abs(t_of_r(F.col("r"), F.col("n"))))
    return g.agg(F.max_by("horizon", F.struct("t", -F.col("horizon"))).alias("best"))


_PEAK = f"""t as (select symbol, ts_us, idx, max("high") over {_NEXT(24)} as top from b),
pk as (select t.symbol, t.ts_us, min(f.idx - t.idx) as to_top from t join us u on u.symbol = t.symbol and epoch_us(u.ts) = t.ts_us join b f on f.symbol = t.symbol and f.idx > t.idx and f.idx <= t.idx + 24 and f."high" = t.top group by t.symbol, t.ts_us)"""


@q("a30_bars_to_peak", sql(" union all ".join(f"select {p}::double as p, round(quantile_cont(to_top, {p}), 5) as x from pk" for p in (0.25, 0.5, 0.75, 0.9, 0.99)), _US, RET, _PEAK))
def a30(spark, sf_dir):
    df = with_halo(positions(bars(spark, sf_dir), "symbol", ["ts"]), 0, 25)
    df = core(S.staged(df, outcomes.first_peaks(along(), 24))).withColumn("ts_us", us("ts"))
    s = unique_sigs(spark, sf_dir).select("symbol", us("ts").alias("ts_us")).distinct()
    got = exact_quantiles(df.join(s, ["symbol", "ts_us"], "left_semi"), None, {"to_top": F.col("to_top")}, [0.25, 0.5, 0.75, 0.9, 0.99])
    return got.select("p", r6("x", 5).alias("x"))


# ---- Ablation and calibration ----------------------------------------------------------------------------------

_ABL = f"""ab as (select symbol, strftime(ts, '%Y-%m') as shard, quality, veto, conviction, mfe, mae from us where quality is not null and veto is not null and conviction is not null and mfe is not null and mae is not null),
va as (select *, 'veto' as variant, veto as score from ab union all select *, 'blend' as variant, (veto + conviction) / 2 as score from ab),
cutv as (select variant, quantile_cont(score, 0.8) as edge from va group by variant),
me as (select shard, va.variant, count(*) as n, coalesce(sum(case when score >= edge then greatest(mfe - mae, 0) end), 0) as profit, coalesce(sum(case when score >= edge then greatest(mae - mfe, 0) end), 0) as loss,
  avg(case when score >= edge then mfe - mae end) as mean_gain, 1 - avg(case when score >= edge then 1.0 else 0.0 end) as discard from va join cutv on cutv.variant = va.variant group by shard, va.variant)"""


def ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per month and score variant the result of keeping the upper fifth by score."""
    s = unique_sigs(spark, sf_dir).dropna(subset=["quality", "veto", "conviction", "mfe", "mae"]).withColumn("shard", F.date_format("ts", "yyyy-MM"))
    v = F.explode(F.array(F.struct(F.lit("veto").alias("variant"), F.col("veto").alias("score")), F.struct(F.lit("blend").alias("variant"), ((F.col("veto") + F.col("conviction")) / 2).alias("score"))))
    va = s.select("shard", "mfe", "mae", v.alias("v")).select("shard", "mfe", "mae", "v.*")
    edge = exact_quantiles(va, "variant", {"score": F.col("score")}, [0.8]).select(F.col("grp").alias("variant"), F.col("x").alias("edge"))
    keep = F.col("score") >= F.col("edge")
    return va.join(edge, "variant").groupBy("shard", "variant").agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(F.when(keep, F.greatest(gain(), F.lit(0.0)))), F.lit(0.0)).alias("profit"),
        F.coalesce(F.sum(F.when(keep, F.greatest(-gain(), F.lit(0.0)))), F.lit(0.0)).alias("loss"),
        F.avg(F.when(keep, gain())).alias("mean_gain"),
        (1 - F.avg(F.when(keep, 1.0).otherwise(0.0))).alias("discard"),
    )


@q("a35_ablation", sql("select shard, variant, n, round(profit, 5) as profit, round(loss, 5) as loss, round(mean_gain, 6) as mean_gain, round(discard, 6) as discard from me", _US, _ABL))
def a35(spark, sf_dir):
    return ablation(spark, sf_dir).select("shard", "variant", "n", r6("profit", 5).alias("profit"), r6("loss", 5).alias("loss"), r6("mean_gain").alias("mean_gain"), r6("discard").alias("discard"))


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ablation(spark, sf_dir).groupBy("shard").agg(F.max(F.when(F.col("variant") == "blend", F.col("mean_gain"))).alias("x"), F.max(F.when(F.col("variant") == "veto", F.col("mean_gain"))).alias("y"))
    g = m.filter("x is not null and y is not null").agg(F.count("*").alias("n"), F.avg(F.col("x") - F.col("y")).alias("m"), F.stddev_samp(F.col("x") - F.col("y")).alias("s"))
    return g.withColumn("t", F.when(F.col("s") > 0, F.col("m") / (F.col("s") / F.sqrt(F.col("n")))))


@q("a36_paired_t", sql("select n, round(m, 7) as mean_difference, round(m / (s / sqrt(n)), 4) as t from (select count(*) as n, avg(x - y) as m, stddev_samp(x - y) as s from (select shard, max(case when variant = 'blend' then mean_gain end) as x, max(case when variant = 'veto' then mean_gain end) as y from me group by shard) p where x is not null and y is not null) e where s > 0", _US, _ABL))
def a36(spark, sf_dir):
    return _paired(spark, sf_dir).filter("t is not null").select("n", r6("m", 7).alias("mean_difference"), r6("t", 4).alias("t"))


@q("a36_paired_p", sql(_p_sql("") + " having any_value(t) is not null", _US, _ABL, "tt as (select m / (s / sqrt(n)) as t, (n - 1)::double as v from (select count(*) as n, avg(x - y) as m, stddev_samp(x - y) as s from (select shard, max(case when variant = 'blend' then mean_gain end) as x, max(case when variant = 'veto' then mean_gain end) as y from me group by shard) p where x is not null and y is not null) e where s > 0)"))
def a36p(spark, sf_dir):
    return _paired(spark, sf_dir).filter("t is not null").select(r6("t", 4).alias("t"), r6(p_values(F.col("t"), (F.col("n") - 1).cast("double"))).alias("p"))


_LEDGER = [f"slot_{i:02d}" for i in range(15)]


def ledger_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = unique_sigs(spark, sf_dir).filter("rf is not null")
    return s.select("sig_id", "rf", F.explode(F.array(*[F.struct(F.lit(c).alias("slot"), F.col(c).alias("x")) for c in _LEDGER])).alias("c")).select("sig_id", "rf", "c.slot", "c.x").filter("x is not null")


@q("a37_calibration_ledger", sql("select slot, n, round(mean, 6) as mean, round(deviation, 6) as deviation, least, most, round(p05, 6) as p05, round(median, 6) as median, round(p95, 6) as p95, round(rho, 6) as rho from (select slot, count(*) as n, avg(x) as mean, stddev_samp(x) as deviation, min(x) as least, max(x) as most, quantile_cont(x, 0.05) as p05, quantile_cont(x, 0.5) as median, quantile_cont(x, 0.95) as p95, corr(ra, rb) as rho from (select *, rank() over (partition by slot order by x) + (count(*) over (partition by slot, x) - 1) / 2.0 as ra, rank() over (partition by slot order by rf) + (count(*) over (partition by slot, rf) - 1) / 2.0 as rb from le) r group by slot) t", _US, "le as (" + " union all ".join(f"select '{c}' as slot, {c} as x, rf from us where rf is not null and {c} is not null" for c in _LEDGER) + ")"))
def a37(spark, sf_dir):
    """Per slot its moments, percentiles and rank correlation with the recovery factor."""
    le = ledger_rows(spark, sf_dir)
    stats = le.groupBy("slot").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("deviation"), F.min("x").alias("least"), F.max("x").alias("most"))
    qs = exact_quantiles(le, "slot", {"x": F.col("x")}, [0.05, 0.5, 0.95]).groupBy(F.col("grp").alias("slot")).agg(*[F.max(F.when(F.abs(F.col("p") - p) < 1e-9, F.col("x"))).alias(k) for k, p in (("p05", 0.05), ("median", 0.5), ("p95", 0.95))])
    ranked = mean_ranks(mean_ranks(le, "slot", "x", "sig_id", "ra"), "slot", "rf", "sig_id", "rb")
    rho = ranked.groupBy("slot").agg(W.corr(F.col("ra"), F.col("rb")).alias("rho"))
    got = stats.join(qs, "slot").join(rho, "slot")
    return got.select("slot", "n", r6("mean").alias("mean"), r6("deviation").alias("deviation"), "least", "most", *[r6(c).alias(c) for c in ("p05", "median", "p95", "rho")])


@q("a37_suggested_weights", f"""with led as ({q.sql["a37_calibration_ledger"]}),
w as (select slot, greatest(0.02, least(0.18, abs(rho) / greatest(sum(abs(rho)) over (), 1e-12))) as w from led)
select slot, round(w / sum(w) over (), 6) + 0.0 as weight from w""")
def a37w(spark, sf_dir):
    """Weights in proportion to absolute rank correlation, each within [0.02, 0.18], scaled to sum to 1."""
    led = a37(spark, sf_dir).select("slot", F.abs("rho").alias("a"))
    total = led.agg(F.sum("a").alias("t"))
    w = led.join(total, F.lit(True)).withColumn("w", F.greatest(F.lit(0.02), F.least(F.lit(0.18), F.col("a") / F.greatest(F.col("t"), F.lit(1e-12)))))
    w = cut(w)
    return w.join(w.agg(F.sum("w").alias("s")), F.lit(True)).select("slot", r6(F.col("w") / F.col("s")).alias("weight"))


# ---- Relevance and priors --------------------------------------------------------------------------------------

_BINS = 10


@q("m01_mutual_information", sql(f"""select symbol, round(sum(n / t * ln(n * t / (na * nb))), 6) as nats from (select *, sum(n) over (partition by symbol) as t, sum(n) over (partition by symbol, i) as na, sum(n) over (partition by symbol, j) as nb from (
 select symbol, i, j, count(*)::double as n from (select symbol, least({_BINS} - 1, floor((x - xl) / (xh - xl) * {_BINS})) as i, least({_BINS} - 1, floor((y - yl) / (yh - yl) * {_BINS})) as j from (
  select symbol, x, y, min(x) over (partition by symbol) as xl, max(x) over (partition by symbol) as xh, min(y) over (partition by symbol) as yl, max(y) over (partition by symbol) as yh from mi) a where xh > xl and yh > yl) c group by 1, 2, 3) d) e group by symbol""", RET, """mi as (select symbol, r as x, ln("high" / "low") as y from b where r is not null and "high" >= "low")"""))
def m01(spark, sf_dir):
    """Mutual information of return and range per symbol, in nats, from a 10 by 10 histogram."""
    df = core(S.staged(with_halo(positions(bars(spark, sf_dir), "symbol", ["ts"]), 1), [_r(along())])).filter("r is not null and high >= low")
    return mutual_information(df.select("symbol", F.col("r").alias("x"), F.ln(F.col("high") / F.col("low")).alias("y")), "symbol", _BINS).select("symbol", r6("nats").alias("nats"))


def mutual_information(df: DataFrame, by: str, bins: int) -> DataFrame:
    """by, nats: mutual information of x and y in equal-width bins between their extremes. Groups without spread in
    either don't come out. Only counts per cell are shuffled."""
    e = df.groupBy(by).agg(*[f(c).alias(n) for n, f, c in (("xl", F.min, "x"), ("xh", F.max, "x"), ("yl", F.min, "y"), ("yh", F.max, "y"))]).filter("xh > xl and yh > yl")
    place = lambda c, lo, hi: F.least(F.lit(bins - 1), F.floor((F.col(c) - F.col(lo)) / (F.col(hi) - F.col(lo)) * bins))
    n = df.join(e, by).groupBy(by, place("x", "xl", "xh").alias("i"), place("y", "yl", "yh").alias("j")).agg(F.count("*").cast("double").alias("n"))
    w = lambda *k: F.sum("n").over(Window.partitionBy(by, *k))
    n = n.withColumns({"t": w(), "na": w("i"), "nb": w("j")})
    return n.groupBy(by).agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("nats"))


@q("m07_autocorrelations", sql(" union all ".join(f"select symbol, {k} as lag, round(corr(r, lagged), 6) as acf from (select symbol, r, lag(r, {k}) over (partition by symbol order by ts) as lagged from b) t where r is not null and lagged is not null group by symbol having count(*) > 2" for k in range(1, 21)), RET))
def m07(spark, sf_dir):
    """Autocorrelation of returns at lags 1 to 20 per symbol, in one pass."""
    df = core(S.staged(with_halo(positions(bars(spark, sf_dir), "symbol", ["ts"]), 22), [_r(along()), {f"l{k}": F.lag("r", k).over(along()) for k in range(1, 21)}]))
    g = df.groupBy("symbol").agg(*[W.corr(F.col("r"), F.col(f"l{k}")).alias(f"c{k}") for k in range(1, 21)], *[F.count(F.when(F.col("r").isNotNull() & F.col(f"l{k}").isNotNull(), 1)).alias(f"n{k}") for k in range(1, 21)])
    long = g.select("symbol", F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), r6(f"c{k}").alias("acf"), F.col(f"n{k}").alias("n")) for k in range(1, 21)])).alias("x")).select("symbol", "x.*")
    return long.filter("n > 2").select("symbol", "lag", "acf")


_PRIORS = {
    "low_proximity_p05": (0.05, "case when count(low) over {w24} >= 24 then (low - min(low) over {w24}) / greatest(max(high) over {w24} - min(low) over {w24}, 1e-12) end"),
    "imbalance_p85": (0.85, "case when high > low then abs(2 * (close - low) / (high - low) - 1) end"),
    "body_p20": (0.2, "case when high > low then abs(close - open) / (high - low) end"),
    "wick_p99": (0.99, "case when high > low then least((high - low) / greatest(abs(close - open), 1e-12), 100.0) end"),
    "volatility_p50": (0.5, "case when count(r) over {w288} >= 2 then stddev_samp(r) over {w288} end"),
}
_PR = "pr as (select symbol, " + ", ".join(e.format(w24=_w, w288=_x).replace("low)", '"low")').replace("high)", '"high")') + f" as {k}" for _w, _x in [("(partition by symbol order by ts rows between 23 preceding and current row)", "(partition by symbol order by ts rows between 287 preceding and current row)")] for k, (p, e) in _PRIORS.items()).replace("open)", '"open")') + " from b)"


@q("m07_prior_percentiles", sql(" union all ".join(f"select symbol, '{k}' as prior, round(quantile_cont({k}, {p}), 7) as x from pr where {k} is not null group by symbol" for k, (p, _) in _PRIORS.items()), RET, _PR))
def m07p(spark, sf_dir):
    """Percentiles from which thresholds are derived: proximity, imbalance, body, wick and volatility."""
    df = with_halo(positions(bars(spark, sf_dir), "symbol", ["ts"]), 290)
    w = along()
    w24, w288 = W.rows(w, 24), W.rows(w, 288)
    span = F.col("high") - F.col("low")
    stages = [
        _r(w),
        {
            "low_proximity_p05": F.when(F.count("low").over(w24) >= 24, (F.col("low") - F.min("low").over(w24)) / F.greatest(F.max("high").over(w24) - F.min("low").over(w24), F.lit(W.EPS))),
            "imbalance_p85": F.when(span > 0, F.abs(2 * (F.col("close") - F.col("low")) / span - 1)),
            "body_p20": F.when(span > 0, F.abs(F.col("close") - F.col("open")) / span),
            "wick_p99": F.when(span > 0, F.least(span / F.greatest(F.abs(F.col("close") - F.col("open")), F.lit(W.EPS)), F.lit(100.0))),
            "volatility_p50": F.when(F.count("r").over(w288) >= 2, F.stddev_samp("r").over(w288)),
        },
    ]
    df = cut(core(S.staged(df, stages)).select("symbol", *_PRIORS))
    parts = [exact_quantiles(df, "symbol", {k: F.col(k)}, [p]).select(F.col("grp").alias("symbol"), F.lit(k).alias("prior"), r6("x", 7).alias("x")) for k, (p, _) in _PRIORS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out
