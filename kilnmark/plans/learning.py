"""Queries of derived priors, regimes, density clusters and sampling."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cycles, hidden
from ..functions import slots as S
from ..operators import windows as W
from ..operators.blocks import BLOCK, CORE, IDX, along, core, positions, with_halo
from ..operators.density import dbscan
from ..operators.order_stats import exact_quantiles
from ..session import cut, stored, table
from .common import Registry, bars, fine, r6, sql, us
from .series import _r

q = Registry()


def latest(df: DataFrame, n: int) -> DataFrame:
    """The last n bars of each series, from their positions: a bounded group whatever the series' length."""
    last = df.groupBy("symbol").agg(F.max(IDX).alias("_last"))
    return df.join(last, "symbol").filter(F.col(IDX) > F.col("_last") - n).drop("_last")


WIDE = 8 * BLOCK  # rows of a block where halos reach back 30 cycles, up to 30,000 rows


def wide_blocks(df: DataFrame, top: DataFrame, columns: list[str], cycles_back: int) -> DataFrame:
    """Blocks with a halo of so many of the symbol's cycles; those beyond the last bar, which hold a halo only, are left out."""
    df = df.select("symbol", IDX, *columns).join(top.select("symbol", "cycle", "bars"), "symbol")
    return with_halo(df, cycles_back * F.col("cycle"), block=WIDE).filter(F.col("block") * WIDE < F.col("bars"))


def heads(df: DataFrame) -> DataFrame:
    """Per symbol what its latest 2,000 returns tell (the caps of the wavelet cycle and of the change point), and its number of bars."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by(IDX)
        r = np.diff(np.log(t["close"].to_numpy()))
        d = cycles.dominant_cycle(r)
        return pa.table({"symbol": [key[0].as_py()], "cycle": [d], "distance": [cycles.change_distance(r, d)], "noise": [cycles.noise(r)], "bars": [t[IDX][-1].as_py() + 1]})

    return cut(latest(df, cycles.MOST_BARS + 1).select("symbol", IDX, "close").groupBy("symbol").applyInArrow(run, "symbol string, cycle long, distance long, noise double, bars long"))


def ratio_counts(df: DataFrame, top: DataFrame) -> DataFrame:
    """symbol, k, i, x: counts of the summed returns of every candidate window against the cycle's, over all bars.

    Pass one finds the extremes, pass two counts the cells between them; a block gives 11 rows and then at most 11 x 144."""
    n, ratios = cycles.RATIO_BINS, cycles.RATIOS
    blocks = wide_blocks(df, top, ["close"], 2)

    def pairs(t: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        d, bars = t["cycle"][0].as_py(), t["bars"][0].as_py()
        at, own = t[IDX].to_numpy()[1:], t[CORE].to_numpy()[1:]
        r = np.diff(np.log(t["close"].to_numpy()))
        for m, ratio in enumerate(ratios):
            w = max(int(d * ratio), 2)
            if bars - max(w, d) - d > 2 * n and len(r) >= max(w, d):
                ok = own & (at >= max(w, d)) & (at < bars - d)
                yield m, cycles.trailing_sum(r, w)[ok], cycles.trailing_sum(r, d)[ok]

    def extremes(key: tuple, t: pa.Table) -> pa.Table:
        got = [(m, x.min(), x.max(), y.min(), y.max()) for m, x, y in pairs(t.sort_by(IDX)) if len(x)]
        names = ("m", "xl", "xh", "yl", "yh")
        return pa.table({"symbol": pa.array([key[0].as_py()] * len(got), pa.string()), "block": pa.array([key[1].as_py()] * len(got), pa.int64()), **{k: pa.array([float(g[i]) if i else g[i] for g in got], pa.float64() if i else pa.int32()) for i, k in enumerate(names)}})

    e = cut(blocks.groupBy("symbol", "block").applyInArrow(extremes, "symbol string, block long, m int, xl double, xh double, yl double, yh double"))
    e = e.select("symbol", "block", "m").join(e.groupBy("symbol", "m").agg(F.min("xl").alias("xl"), F.max("xh").alias("xh"), F.min("yl").alias("yl"), F.max("yh").alias("yh")), ["symbol", "m"])

    def count(key: tuple, t: pa.Table, e: pa.Table) -> pa.Table:
        between = {r["m"]: r for r in e.to_pylist()}
        place = lambda v, lo, hi: np.minimum(((v - lo) / (hi - lo) * n).astype(int), n - 1)
        i, x = [np.zeros(0, int)], [np.zeros(0)]
        for m, a, b in pairs(t.sort_by(IDX)) if between else ():
            g = between.get(m)
            if g and len(a) and g["xh"] > g["xl"] and g["yh"] > g["yl"]:
                h = np.bincount(place(a, g["xl"], g["xh"]) * n + place(b, g["yl"], g["yh"]), minlength=n * n)
                i.append(m * n * n + np.flatnonzero(h))
                x.append(h[h > 0].astype(float))
        i, x = np.concatenate(i), np.concatenate(x)
        return pa.table({"symbol": pa.array([key[0].as_py()] * len(i), pa.string()), "k": pa.array(["ratio"] * len(i), pa.string()), "i": pa.array(i, pa.int32()), "x": pa.array(x)})

    got = blocks.groupBy("symbol", "block").cogroup(e.groupBy("symbol", "block")).applyInArrow(count, _FACT)
    return got.groupBy("symbol", "k", "i").agg(F.sum("x").alias("x"))


_FACT = "symbol string, k string, i int, x double"


def bar_facts(df: DataFrame, top: DataFrame) -> DataFrame:
    """symbol, k, i, x: percentiles, sums of the correlations and the state count, over all bars.

    Everything but the state count comes from blocks; M04 fits its models on a symbol's returns and volatilities, 24
    bytes a bar, in one task."""
    blocks = wide_blocks(df, top, ["open", "high", "low", "close"], cycles.VOLATILITY_CYCLES)
    per_bar = ("x", *cycles.AT)
    schema = f"symbol string, {IDX} long, " + ", ".join(f"{c} double" for c in per_bar) + ", k string, i int, v double"

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by(IDX)
        d, bars, at, own = t["cycle"][0].as_py(), t["bars"][0].as_py(), t[IDX].to_numpy(), t[CORE].to_numpy()
        b = cycles.by_bar(*[t[c].to_numpy() for c in ("open", "high", "low", "close")], d)
        x, first, stop = b["x"], int(np.argmax(own)), int(len(own) - np.argmax(own[::-1]))
        start = 1  # row 0 has no return: it is the series' first bar, or its predecessor isn't in the block
        if at[0] > 0:
            b["rv"][1:] = cycles.realised(x[1:], cycles.VOLATILITY_CYCLES * d)
        s = slice(max(first, start), stop)
        u, r = b["signed"][s.start - 1 : s.stop - 1], x[s]
        facts = [("corr", i, z) for i, z in enumerate((len(r), u.sum(), r.sum(), (u * u).sum(), (r * r).sum(), (u * r).sum()))]
        for k in range(1, cycles.most_lags(bars - 1, d) + 1):
            j = max(first, start + k)
            if j < stop:
                facts += [(z, k, q) for z, q in (("product", x[j:stop] @ x[j - k : stop - k]), ("late", x[j:stop].sum()), ("early", x[j - k : stop - k].sum()))]
        m, o = len(facts), stop - first
        both = lambda v, kind: pa.chunked_array([pa.array(v[first:stop], kind, from_pandas=True), pa.nulls(m, kind)])
        return pa.table({
            "symbol": pa.array([key[0].as_py()] * (o + m), pa.string()), IDX: both(at, pa.int64()), **{c: both(b[c], pa.float64()) for c in per_bar},
            **{c: pa.chunked_array([pa.nulls(o, kind), pa.array([kind_of(f[i]) for f in facts], kind)]) for i, (c, kind, kind_of) in enumerate((("k", pa.string(), str), ("i", pa.int32(), int), ("v", pa.float64(), float)))},
        }).combine_chunks()

    got = stored(blocks.groupBy("symbol", "block").applyInArrow(run, schema), "prior-bars")
    rows = got.filter(F.col(IDX).isNotNull())
    parts = [got.filter(F.col(IDX).isNull()).groupBy("symbol", "k", "i").agg(F.sum("v").alias("x"))]
    fact = lambda q: q.select(F.col("grp").alias("symbol"), "k", F.round(100 * F.col("p")).cast("int").alias("i"), "x")
    for at in {p for p in cycles.AT.values()}:
        names = [k for k, p in cycles.AT.items() if p == at]
        parts.append(fact(exact_quantiles(rows, "symbol", {k: F.col(k) for k in names}, [p / 100 for p in at]).withColumn("k", F.col("q"))))
        if "rv" in names:
            parts[-1] = rv = cut(parts[-1])
    parts.append(rows.groupBy("symbol").agg(F.lit("wick_top").alias("k"), F.lit(0).alias("i"), F.max("wick").alias("x")))
    pick = lambda p: F.max(F.when(F.col("i") == p, F.col("x")))
    fence = rv.groupBy("symbol").agg(cycles.fence(pick(25), pick(75)).alias("fence"))
    parts.append(rows.join(fence, "symbol").filter("rv is not null").groupBy("symbol").agg(F.lit("inside").alias("k"), F.lit(0).alias("i"), F.avg((F.col("rv") <= F.col("fence")).cast("double")).alias("x")))

    def states(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by(IDX)
        n = hidden.best_states(np.stack([t["x"].to_numpy(), np.nan_to_num(t["rv"].to_numpy())], 1)) if t.num_rows >= cycles.LEAST_STATES_BARS else 4
        return pa.table({"symbol": [key[0].as_py()], "k": ["states"], "i": pa.array([0], pa.int32()), "x": [float(n)]})

    parts.append(rows.select("symbol", IDX, "x", "rv").groupBy("symbol").applyInArrow(states, _FACT))
    return reduce(DataFrame.unionAll, parts)


def priors(spark: SparkSession, sf_dir: str, names: tuple[str, ...] | None = None) -> DataFrame:
    """symbol, prior, x: the priors of all bars; with names only those of dominant_cycle, change_distance and cycle_ratio."""
    df = positions(bars(spark, sf_dir), "symbol", ["ts"])
    top = heads(df)
    head = {"dominant_cycle": "cycle", "change_distance": "distance"}
    long = top.select("symbol", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(0).alias("i"), F.col(c).cast("double").alias("x")) for k, c in (head | {"noise": "noise", "bars": "bars"}).items()])).alias("f")).select("symbol", "f.*")
    if names is None or "cycle_ratio" in names:
        long = long.unionAll(ratio_counts(df, top))
    if names is None:
        long = long.unionAll(bar_facts(df, top))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        f: dict = {}
        for k, i, x in zip(t["k"].to_pylist(), t["i"].to_pylist(), t["x"].to_pylist(), strict=True):
            f.setdefault(k, {})[i] = x
        d, n, cells = int(f["dominant_cycle"][0]), int(f["bars"][0]), cycles.RATIO_BINS**2
        h = np.zeros(len(cycles.RATIOS) * cells)
        for i, x in f.get("ratio", {}).items():
            h[i] = x
        told = [cycles.information(z.reshape(cycles.RATIO_BINS, -1)) for z in h.reshape(-1, cells)]
        got = {"dominant_cycle": d, "change_distance": f["change_distance"][0], "cycle_ratio": float(cycles.RATIOS[int(np.argmax(told))]) if max(told) > 0 else 1.0}
        if names is None:
            facts: dict = {(k, p): f[k][p] for k, ps in cycles.AT.items() for p in ps if k in f}
            facts |= {"wick_top": f["wick_top"][0], "inside": f.get("inside", {0: 1.0})[0], "states": int(f["states"][0])}
            facts["corr"] = _correlation([f["corr"][i] for i in range(6)])
            m, q = f["corr"][2] / max(f["corr"][0], 1), f["corr"][4]
            lags = range(1, cycles.most_lags(n - 1, d) + 1)
            a = np.array([f["product"][k] - m * (f["late"][k] + f["early"][k]) + (n - 1 - k) * m * m for k in lags]) / (q - (n - 1) * m * m + 1e-12)
            got = cycles.assemble(d, n, facts, a, f["noise"][0], got["change_distance"], got["cycle_ratio"])
        got = {k: float(v) for k, v in got.items() if names is None or k in names}
        return pa.table({"symbol": [key[0].as_py()] * len(got), "prior": list(got), "x": list(got.values())})

    return long.groupBy("symbol").applyInArrow(run, "symbol string, prior string, x double")


def _correlation(sums: list[float]) -> float | None:
    n, u, v, uu, vv, uv = sums
    if n <= 2 or (a := uu - u * u / n) <= 1e-15 * uu or (b := vv - v * v / n) <= 1e-15 * vv:
        return None
    return (uv - u * v / n) / math.sqrt(a * b)


@q("m02_dominant_cycles")
def m02(spark, sf_dir):
    return priors(spark, sf_dir, ("dominant_cycle",)).select("symbol", F.col("x").cast("int").alias("cycle"))


@q("m03_cycle_ratios")
def m03(spark, sf_dir):
    return priors(spark, sf_dir, ("change_distance", "cycle_ratio")).withColumn("x", r6("x"))


@q("m07_all_priors")
def m07(spark, sf_dir):
    """Every prior of every symbol, the state count by BIC included."""
    return priors(spark, sf_dir).withColumn("x", r6("x"))


SHORT = 2_000  # bars of the short relevance: its window, not a cap


@q("m05_adaptive_weights")
def m05(spark, sf_dir):
    """Composite weights that follow each slot's relevance for the return of the next 12 bars."""
    cfg = S.SlotConfig()
    df = core(S.all_slots(bars(spark, sf_dir), cfg, 13).withColumn("y", F.lead("close", 12).over(along()) / F.col("close") - 1)).filter("y is not null")
    names = [f"slot_{i:02d}" for i in range(15)]
    df = stored(df.select("symbol", IDX, "y", *names), "slots")
    # Rank correlations over all bars, equal values ranked in order of time: the return is ranked once a symbol, all slots by one more sort.
    ry = positions(df.select("symbol", IDX, "y"), "symbol", ["y", IDX], "ry").select("symbol", IDX, "ry")
    long = df.select("symbol", IDX, F.explode(F.array(*[F.struct(F.lit(s).alias("slot"), F.col(s).alias("x")) for s in names])).alias("_s")).select("symbol", IDX, "_s.slot", "_s.x")
    rx = positions(long.withColumn("pair", F.concat_ws("|", "symbol", "slot")), "pair", ["x", IDX], "rx")
    rel = rx.join(ry, ["symbol", IDX]).groupBy("symbol", "slot").agg(F.coalesce(W.corr(F.col("rx"), F.col("ry")), F.lit(0.0)).alias("r"))
    rel = rel.groupBy("symbol").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("slot", "r")))).alias("whole"))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by(IDX)
        w = cycles.adaptive_weights({s: t[s].to_numpy() for s in names}, t["y"].to_numpy(), cfg.weights, short=SHORT, whole=dict(t["whole"][0].as_py()))
        return pa.table({"symbol": [key[0].as_py()] * len(w), "slot": list(w), "weight": list(w.values())})

    return latest(df, SHORT).join(rel, "symbol").groupBy("symbol").applyInArrow(run, "symbol string, slot string, weight double").withColumn("weight", r6("weight"))


@q("f08_hidden_regimes")
def f08(spark, sf_dir):
    """Probability of the most volatile of four hidden states, fitted on the 288 bars before each batch of 288.

    Batches begin at multiples of 288 of the series, so that blocks don't change the result."""
    df = with_halo(positions(bars(spark, sf_dir), "symbol", ["ts"]), 3 * 288)
    df = S.staged(df, [_r(along()), *S.regime_volatility(along(), S.SlotConfig())]).select("symbol", "block", IDX, CORE, us("ts").alias("ts_us"), "r0", "volatility")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by(IDX)
        first = (-t[IDX][0].as_py()) % 288
        x = np.stack([t["r0"].to_numpy(), t["volatility"].to_numpy()], 1)
        p = np.append(np.full(min(first, len(x)), np.nan), hidden.walk_forward(x[first:], 288, 288, 4))
        return t.append_column("p", pa.array(np.nan_to_num(p)))

    out = df.groupBy("symbol", "block").applyInArrow(run, f"symbol string, block long, {IDX} long, {CORE} boolean, ts_us long, r0 double, volatility double, p double")
    return out.filter(CORE).select("symbol", "ts_us", r6("p", 4).alias("p"))


@q("m06_density_clusters")
def m06(spark, sf_dir):
    """DBSCAN labels of all signatures over their 15 structural slots (unset: 0), radius 0.5, 5 rows to be dense."""
    return dbscan(table(spark, sf_dir, "signatures"), "sig_id", [f"slot_{i:02d}" for i in range(15)], 0.5, 5).select("sig_id", "cluster", "core")


@q("m15_seeded_sample", "select sig_id from signatures order by md5(sig_id || ':42'), sig_id limit 1000")
def m15(spark, sf_dir):
    """The 1,000 signatures of smallest hash: the same ones every time."""
    return table(spark, sf_dir, "signatures").select("sig_id").orderBy(F.md5(F.concat_ws(":", "sig_id", F.lit(42))), "sig_id").limit(1_000)
