"""Core helpers against brute force and pandas."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kilnmark import config
from kilnmark.functions import cycles, hidden, stats
from kilnmark.functions.instants import instant, interval_seconds
from kilnmark.operators import blocks, joins, windows
from kilnmark.operators.bars import append_new, clean_bars, tick_bars
from kilnmark.operators.blocks import along, core, cumulative, positions, with_halo
from kilnmark.operators.density import dbscan
from kilnmark.operators.graphs import components
from kilnmark.operators.order_stats import exact_medians, exact_quantiles
from kilnmark.operators.ordered import Ordered


def test_instants_in_all_spellings(spark):
    texts = ["2015-05-01 10:00:00", "2015-05-01T10:00:00Z", "2015-05-01 12:00:00+02:00", "2015-05-01T05:30:00-04:30", "1430474400000", " 2015-05-01 10:00:00.000000+00:00 ", "2015-05-01"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.unix_micros(instant(F.col("t")))).collect()]
    assert got[:-1] == [1430474400000000] * 6 and got[-1] == 1430438400000000
    bad = spark.createDataFrame([(None,), ("",), ("soon",), ("12",)], "t string").select(instant(F.col("t"))).collect()
    assert all(r[0] is None for r in bad)
    assert [r[0] for r in spark.createDataFrame([("5m",), ("1h",), ("x",), (None,)], "t string").select(interval_seconds(F.col("t"))).collect()] == [300, 3600, None, None]


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(g, float(x)) for g in ("a", "b", None) for x in [*rng.normal(size=301), *[0.0] * 150, *rng.lognormal(3, 4, 40), -5.0, -5.0]]
    rows += [("a", math.nan), ("a", math.inf), ("a", None), ("only nulls", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    at = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {(r["grp"], r["p"]): (r["n"], r["x"]) for r in exact_quantiles(df, "g", {"x": F.col("x")}, at).collect()}
    assert len(got) == 15
    for g in ("a", "b", None):
        xs = [x for k, x in rows if k == g and x is not None and math.isfinite(x)]
        for p in at:
            assert got[g, p][0] == len(xs) and got[g, p][1] == pytest.approx(np.quantile(xs, p), rel=1e-12, abs=1e-12)
    assert exact_medians(df.limit(0), "g", {"x": F.col("x")}).count() == 0


def test_positions_do_not_depend_on_partitions(spark):
    rows = [("hot", i % 97, i) for i in range(500)] + [("cold", 1, 1000), (None, 5, 2000), (None, 4, 2001)]
    df = spark.createDataFrame(rows, "symbol string, t int, id int").repartition(7)
    got = positions(df, "symbol", ["t", "id"]).toPandas()
    for s, g in got.groupby("symbol", dropna=False):
        g = g.sort_values(["t", "id"])
        assert g["bar_idx"].tolist() == list(range(len(g)))
    assert positions(df.limit(0), "symbol", ["t", "id"]).count() == 0


def test_neighbours_across_partitions(spark):
    df = spark.createDataFrame([("s", i) for i in range(50)], "k string, i int")
    got = Ordered(df, ["k", "i"], 9).with_neighbours(lambda t, a, b: t.slice(a, b - a).append_column("seen", __import__("pyarrow").array([t.num_rows - (b - a)] * (b - a))), "k string, i int, seen long", 3, 3)
    seen = {r["i"]: r["seen"] for r in got.collect()}
    assert len(seen) == 50 and set(seen.values()) <= {3, 6} and seen[25] == 6


def test_windows_over_blocks_equal_pandas(spark, monkeypatch):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"symbol": ["a"] * 300 + ["b"] * 40, "t": [*range(300), *range(40)], "x": rng.normal(size=340)})
    pdf.loc[rng.random(340) < 0.1, "x"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    w = along()
    h = with_halo(positions(df, "symbol", ["t"]), 30, 12, block=50)
    x = F.col("x")
    got = core(h.withColumns({"m": windows.roll_mean(x, w, 10, 8), "s": windows.roll_std(x, w, 10, 2), "q": windows.roll_quantile(x, w, 20, 0.9, 1), "z": windows.zscore(x, w, 12), "f": windows.forward_max(x, w, 12)})).toPandas().sort_values(["symbol", "t"])
    for s, g in pdf.groupby("symbol"):
        o = got[got.symbol == s]
        v = g.x.reset_index(drop=True)
        r = v.rolling(12, min_periods=1)
        want = {"m": v.rolling(10, min_periods=8).mean(), "s": v.rolling(10, min_periods=2).std(), "q": v.rolling(20, min_periods=1).quantile(0.9), "z": ((v - r.mean()) / r.std().clip(lower=1e-12)).clip(-10, 10).fillna(0), "f": v[::-1].rolling(12, min_periods=1).max()[::-1].shift(-1)}
        for k, e in want.items():
            np.testing.assert_allclose(o[k].to_numpy(float), e.to_numpy(float), atol=1e-9, err_msg=f"{s} {k}")


def test_cumulative_over_blocks(spark):
    df = spark.createDataFrame([("a", i, float((i * 37) % 11 - 5)) for i in range(100)], "symbol string, t int, x double")
    got = cumulative(positions(df, "symbol", ["t"]), {"s": ("x", "sum"), "m": ("x", "max"), "l": ("x", "min")}, block=9).orderBy("t").toPandas()
    np.testing.assert_allclose(got.s, got.x.cumsum())
    assert (got.m == got.x.cummax()).all() and (got.l == got.x.cummin()).all()


def test_asof_equals_merge_asof(spark):
    rng = np.random.default_rng(3)
    left = pd.DataFrame({"k": rng.choice(["a", "b", "c"], 200), "t": rng.integers(0, 10**12, 200)}).drop_duplicates().sort_values("t")
    right = pd.DataFrame({"k": rng.choice(["a", "b"], 30), "u": rng.integers(0, 10**12, 30), "v": rng.normal(size=30)}).sort_values("u")
    got = joins.asof_backward(spark.createDataFrame(left), spark.createDataFrame(right), "k", "t", "u", ["v"]).toPandas().sort_values(["k", "t"])
    want = pd.merge_asof(left, right, left_on="t", right_on="u", by="k").sort_values(["k", "t"])
    np.testing.assert_allclose(got.v.to_numpy(float), want.v.to_numpy(float))
    assert joins.asof_backward(spark.createDataFrame(left), spark.createDataFrame(right).limit(0), "k", "t", "u", ["v"]).filter("v is not null").count() == 0


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 400), st.integers(1, 100), st.integers(1, 50))
def test_folds_cover_what_the_loop_covers(length, window, step):
    k, want = 0, []
    while k * step + window < length:
        want.append((k, k * step, k * step + window))
        k += 1
    assert joins.folds(0, length, window, step) == want


def test_fold_rows(spark):
    got = {(r["fold"], r["part"]): r["n"] for r in joins.fold_rows(spark.range(200).withColumnRenamed("id", "d"), "d", 0, 199, 90, 30).groupBy("fold", "part").agg(F.count("*").alias("n")).collect()}
    assert got == {(k, p): n for k in range(4) for p, n in (("train", 90), ("test", 30 if k < 3 else 20))}


def test_calendar_and_fill(spark):
    d = spark.createDataFrame([("a", "2020-01-01", 1.0), ("a", "2020-01-04", 2.0)], "k string, day string, v double").withColumn("day", F.to_date("day"))
    assert [r["v"] for r in joins.calendar_filled(d, "day", ["v"], ["k"]).orderBy("day").collect()] == [1.0, 0.0, 0.0, 2.0]
    left, right = spark.createDataFrame([(1,), (2,), (3,)], "i int"), spark.createDataFrame([(1, 5.0), (2, None)], "i int, v double")
    assert {r["i"]: r["v"] for r in joins.filled_from(left, right, ["i"], ["v"]).collect()} == {1: 5.0, 2: None, 3: 0.0}


def test_bars(spark):
    t = spark.createDataFrame([("a", "2020-01-01 00:10:00", 2.0, 1), ("a", "2020-01-01 00:10:00", 3.0, 2), ("a", "2020-01-01 00:50:00", 1.0, 3), (None, "2020-01-01 00:50:00", 1.0, 4)], "s string, t string, p double, i int").withColumn("t", F.to_timestamp("t"))
    r = tick_bars(t, "s", "t", "p", "i").collect()
    assert len(r) == 1 and (r[0]["open"], r[0]["high"], r[0]["low"], r[0]["close"], r[0]["trades"]) == (2.0, 3.0, 1.0, 1.0, 3)
    store, new = spark.createDataFrame([("a", 1, 1), ("a", 2, 1)], "s string, t int, v int"), spark.createDataFrame([("a", 2, 9), ("a", 3, 1), ("a", 3, 2), ("b", 1, 1)], "s string, t int, v int")
    assert sorted(map(tuple, append_new(store, new, ["s", "t"], "t", ["v"]).collect())) == [("a", 1, 1), ("a", 2, 1), ("a", 3, 2), ("b", 1, 1)]
    assert append_new(store.limit(0), new, ["s", "t"], "t", ["v"]).count() == 3


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 11), (30, 20), (20, 25), (25, 24), (24, 23), (23, 22), (22, 21)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, **dict.fromkeys((20, 21, 22, 23, 24, 25, 30), 20)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("crowd", [20_000, 40])
def test_dbscan_equals_brute_force(spark, monkeypatch, crowd):
    from kilnmark.operators import density

    monkeypatch.setattr(density, "CROWD", crowd)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 0.1, (120, 3)), rng.normal(3, 0.1, (60, 3)), rng.uniform(-5, 5, (80, 3))])
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= 0.3
    dense = near.sum(1) >= 5
    rows = [(i, *map(float, v), "extra") for i, v in enumerate(x)] + [(None, 0.0, 0.0, 0.0, "")]
    got = dbscan(spark.createDataFrame(rows, "id long, a double, b double, c double, cell string"), "id", ["a", "b", "c"], 0.3, 5).toPandas().set_index("id").sort_index()
    assert (got.core.to_numpy() == dense).all()
    label = {}
    for i in np.flatnonzero(dense):
        if i not in label:
            todo, seen = [i], {i}
            while todo:
                for v in np.flatnonzero(near[todo.pop()] & dense):
                    if v not in seen:
                        seen.add(v)
                        todo.append(v)
            label |= dict.fromkeys(seen, min(seen))
    assert all(got.cluster[i] == c for i, c in label.items())
    assert ((got.cluster == -1).to_numpy() == (~dense & ~near[:, dense].any(1))).all()


def test_student_t():
    assert stats.t_p_value(0.0, 10) == pytest.approx(1.0)
    assert stats.t_p_value(2.228138852, 10) == pytest.approx(0.05, abs=1e-7)
    assert stats.t_p_value(-1.8774, 29) == pytest.approx(0.070553, abs=2e-5)
    assert math.isnan(stats.t_p_value(1.0, 0))


def test_hidden_states_find_regimes():
    rng = np.random.default_rng(5)
    s = np.repeat([0, 1, 0, 1], 150)
    x = rng.normal(0, np.where(s, 3.0, 0.3))[:, None]
    m = hidden.fit(x[None], 2)
    a, _ = hidden.forward(hidden._log_density(x[None], m["mean"], m["var"]), m["start"], m["move"])
    assert (a[0].argmax(1) == s).mean() > 0.95 and hidden.best_states(x, 2, 4) == 2
    p = hidden.walk_forward(np.append(x, np.abs(x), 1), 200, 100, 2)
    assert np.isnan(p[:200]).all() and not np.isnan(p[200:]).any()
    again = hidden.walk_forward(np.append(x, np.abs(x), 1)[:450], 200, 100, 2)
    np.testing.assert_allclose(p[:400], again[:400])  # what follows a batch doesn't change it


def test_cycles_and_weights():
    t = np.arange(3000)
    r = np.sin(2 * np.pi * t / 100) + np.random.default_rng(6).normal(0, 0.1, 3000)
    d = cycles.dominant_cycle(r)
    assert 24 <= d <= 40  # scale of about 100 / 4, times the wavelet's factor
    assert cycles.dominant_cycle(r[:10]) == cycles.USUAL_CYCLE
    o = 100 * np.exp(np.cumsum(r) / 1e4)
    p = cycles.derive(o, o * 1.001, o * 0.999, o, np.ones(3000))
    assert len([k for k in p if not k.startswith(("slot_05", "slot_06.span"))]) >= 35 and all(math.isfinite(v) for v in p.values())
    cfg = cycles.patched(cycles.SlotConfig(), p)
    assert cfg.vpin_window == 4 * int(p["dominant_cycle"])
    y = np.random.default_rng(7).normal(size=4000)
    w = cycles.adaptive_weights({"a": y + np.random.default_rng(8).normal(size=4000), "b": np.random.default_rng(9).normal(size=4000)}, y, {"a": 0.1, "b": 0.1}, high=0.9)
    assert sum(w.values()) == pytest.approx(1) and w["a"] > 3 * w["b"]


def test_likelihood_in_chunks():
    rng = np.random.default_rng(10)
    x = np.stack([rng.normal(0, np.where(np.arange(1501) // 50 % 2, 3.0, 0.3)), np.abs(rng.normal(size=1501))], 1)
    for k in (2, 5):
        assert hidden.likelihood(x, k, 8) == pytest.approx(hidden.fit(x[None], k, 8)["like"][0], rel=1e-9)


def test_priors_of_all_bars(spark, tmp_path, monkeypatch):
    from kilnmark.plans import learning

    rng = np.random.default_rng(11)
    n = 5_000
    o = 100 * np.exp(np.cumsum(rng.normal(0, np.where(np.arange(n) < 2_900, 0.004, 0.0004))))
    c = o * np.exp(rng.normal(0, 0.001, n))
    h, low = np.maximum(o, c) * (1 + rng.random(n) * np.where(np.arange(n) < 2_900, 0.02, 0.001)), np.minimum(o, c) * (1 - rng.random(n) * 0.002)
    df = pd.DataFrame({"symbol": "A", "interval": "5m", "datetime": pd.date_range("2024-01-01", periods=n, freq="5min"), "open": o, "high": h, "low": low, "close": c, "volume": 1.0, "bar_id": np.arange(n)})
    df["received_at"] = df["datetime"]
    df = pd.concat([df, df[:40].assign(symbol="B"), df[:1].assign(symbol="C")])
    spark.createDataFrame(df).write.parquet(f"{tmp_path}/ohlcv.parquet")
    monkeypatch.setattr(learning, "WIDE", 1_500)
    got = learning.m07(spark, str(tmp_path)).toPandas()
    ratios = learning.m03(spark, str(tmp_path)).toPandas()
    for s, g in got.groupby("symbol"):
        k = {"A": n, "B": 40, "C": 1}[s]
        want = cycles.derive(o[:k], h[:k], low[:k], c[:k], np.ones(k))
        assert dict(zip(g.prior, g.x, strict=True)) == pytest.approx(want, abs=2e-6), s
        assert dict(ratios[ratios.symbol == s][["prior", "x"]].values) == pytest.approx({p: want[p] for p in ("change_distance", "cycle_ratio")})
    tail = cycles.derive(*(z[-2_000:] for z in (o, h, low, c)), np.ones(2_000))
    a = dict(got[got.symbol == "A"][["prior", "x"]].values)
    assert len(set(got.symbol)) == 3 and all(abs(a[p] - tail[p]) > 1e-3 for p in ("gate.high", "slot_10.body")) and a["gate.baseline"] > 1.5 * tail["gate.baseline"]


def test_config_parser():
    text = """
# comment
a:
  b: 1.5   # trailing
  c: {x: 1, y: [2, "three # not a comment", null], z: "a, b"}
  d:
    - one
    - 2
e: "quoted: text"
f: null
g: TRUE
"""
    got = config.parse(text)
    assert got == {"a": {"b": 1.5, "c": {"x": 1, "y": [2, "three # not a comment", None], "z": "a, b"}, "d": ["one", 2]}, "e": "quoted: text", "f": None, "g": True}
    assert config.parse("") == {} and config.flat(got)["a.c.z"] == "a, b"
    assert config.config_hash(got) == config.config_hash(config.parse(text.replace("# trailing", "")))
    assert config.bars_per_day("5m") == 288 and config.bars_per_day("1d") == 1
    with pytest.raises(ValueError):
        config.bars_per_day("fortnight")
    with pytest.raises(ValueError):
        config.parse("a: 1\n    b: 2")


def test_crowded_keys_are_dealt_out(spark, monkeypatch):
    from kilnmark.operators import spread
    from kilnmark.operators.graphs import components

    many = spark.createDataFrame([(1, i, "m") for i in range(500)] + [(2, 7, None), (None, 8, "n"), (3, 9, "o")], "k long, x long, v string")
    few = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k long, y string")
    for how in ("inner", "left"):
        plain, dealt = many.join(few, "k", how), spread.spread_join(many, few, "k", how, heavy=50)
        assert dealt.columns == plain.columns
        assert sorted(map(str, dealt.collect())) == sorted(map(str, plain.collect()))
    assert spread.crowded(many, "k", 50).collect()[0]["_lots"] == 10 and spread.crowded(many.limit(0), "k", 50) is None
    # a star, a chain and a pair, with every key of more than a few rows dealt out
    links = [(0, i) for i in range(1, 80)] + [(100 + i, 101 + i) for i in range(40)] + [(500, 499), (7, None)]
    monkeypatch.setattr(spread, "HEAVY", 5)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(80)}, **{100 + i: 100 for i in range(41)}, 499: 499, 500: 499}


def test_many_wanted_buckets_meet_in_a_shuffle(spark, monkeypatch):
    from kilnmark.operators import order_stats

    monkeypatch.setattr(order_stats, "BROADCAST_ROWS", 0)
    df = spark.createDataFrame([("a", float(i)) for i in range(101)] + [(None, -2.0), (None, 4.0), ("b", None)], "g string, x double")
    got = {(r["grp"], r["p"]): r["x"] for r in order_stats.exact_quantiles(df, "g", {"x": F.col("x")}, [0.25, 0.5]).collect()}
    assert got == {("a", 0.25): 25.0, ("a", 0.5): 50.0, (None, 0.25): pytest.approx(-0.5), (None, 0.5): pytest.approx(1.0)}
