"""Implausible readings and regular grids against brute force, with dirty and empty tables."""

import math
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kilnmark.operators import regular, spikes

BAR = T.StructType([T.StructField("bar_id", T.LongType()), T.StructField("symbol", T.StringType()), T.StructField("datetime", T.TimestampType()), *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")], T.StructField("received_at", T.TimestampType()), T.StructField("source", T.StringType()), T.StructField("block", T.StringType())])
T0 = datetime(2020, 1, 1, tzinfo=timezone.utc)


def bars_of(n, symbol="s", first=0, volume=None, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        c = 100 + rng.normal()
        v = float(rng.lognormal(3, 0.3)) if volume is None else volume
        out.append([first + i, symbol, T0 + timedelta(minutes=i), c, c + float(rng.uniform(0.1, 0.3)), c - float(rng.uniform(0.1, 0.3)), c + 0.05, v, T0 + timedelta(minutes=i + 1), "clash", None])
    return out


def flags(spark, rows):
    return {r["bar_id"]: r for r in spikes.flag_readings(spark.createDataFrame(rows, BAR)).collect()}


def test_limits_spikes_and_stuck_readings(spark):
    rows = bars_of(300) + bars_of(40, "t", 1000, seed=1) + bars_of(30, None, 2000, seed=2)
    rows[5][4] = -1.0  # high
    rows[6][4] = math.nan
    rows[7][7] = -3.0  # volume
    rows[8][4], rows[8][5] = 90.0, 95.0
    rows[9][4] = rows[9][3] + 50
    rows[10][7] = 1e6
    rows[11][4] = None
    rows[12][3] = math.inf  # an unusable open alone is no case
    for i in range(100, 106):
        rows[i][7] = 17.0
    for i in range(120, 125):
        rows[i][7] = 18.0  # five are too few
    for i in range(140, 150):
        rows[i][7] = 0.0  # nothing traded is normal
    rows[160][2] = None
    for i in range(310, 317):
        rows[i][4], rows[i][5] = 101.5, 98.5
    got = flags(spark, rows)
    assert len(got) == 370
    assert {i for i, r in got.items() if r["impossible"]} == {5, 6, 7, 8}
    assert {i for i, r in got.items() if r["spike"]} >= {9, 10}
    assert {i for i, r in got.items() if r["stuck"]} == {*range(100, 106), *[rows[i][0] for i in range(310, 317)]}
    assert got[10]["score"] > np.median([r["score"] for r in got.values()]) + 0.1


def test_a_run_across_all_partitions(spark):
    rows = bars_of(200, volume=5.0)
    got = flags(spark, rows)
    assert all(r["stuck"] for r in got.values())


def test_flags_of_empty_null_and_repeated_bars(spark):
    assert flags(spark, []) == {}
    nulls = [[i, "n", T0 + timedelta(minutes=i), *[None] * 5, None, None, None] for i in range(10)]
    got = flags(spark, nulls + [nulls[0][:]])
    assert len(got) == 10 and not any(r["impossible"] or r["spike"] or r["stuck"] for r in got.values())


def test_random_bars_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = bars_of(400, "a", seed=3) + bars_of(300, "b", 500, seed=4)
    for r in rows:
        for k in (3, 4, 5, 6, 7):
            if rng.random() < 0.05:
                r[k] = [None, math.nan, 0.0, -1.0, r[k] * 30 if r[k] else 1.0][rng.integers(5)]
        if rng.random() < 0.2:
            r[7] = 9.0
    b = pd.DataFrame(rows, columns=BAR.names)
    ok = lambda x: x is not None and math.isfinite(x) and x > 0
    up, down, vol = [], [], []
    impossible = []
    for r in rows:
        o, h, l, c, v = r[3:8]
        body = ok(o) and ok(c)
        up.append(h / max(o, c) - 1 if body and ok(h) else np.nan)
        down.append(1 - l / min(o, c) if body and ok(l) else np.nan)
        vol.append(v if v is not None and math.isfinite(v) and v >= 0 else np.nan)
        bad = any(x is not None and not ok(x) for x in (h, l)) or (v is not None and not (math.isfinite(v) and v >= 0))
        bad |= ok(h) and ok(l) and h < l
        bad |= any(ok(x) and (ok(h) and h < x or ok(l) and l > x) for x in (o, c))
        impossible.append(bad)
    b["up"], b["down"], b["vol"] = up, down, vol
    m = b.groupby("symbol")[["up", "down", "vol"]].transform("median")
    spike = ((b.up > 20 * m.up) | (b.down > 20 * m.down) | (b.vol > 20 * m.vol)).tolist()
    got = flags(spark, rows)
    assert [got[i]["impossible"] for i in b.bar_id] == impossible
    assert [got[i]["spike"] for i in b.bar_id] == spike


def grid(spark, rows, shards, hold=3):
    o = spark.createDataFrame(rows, "bar_id long, symbol string, datetime timestamp, close double, volume double, received_at timestamp, slot string, stretch string")
    m = spark.createDataFrame(shards, "symbol string, interval string, shard_start timestamp, shard_end timestamp, status string")
    return {(r["symbol"], r["slot_epoch"]): r for r in regular.regular_bars(o, m, hold).collect()}


def test_grid_states_means_and_coverage(spark):
    at = lambda m: T0 + timedelta(minutes=m)
    e = int(T0.timestamp())
    rows = [
        (1, "s", at(0), 10.0, 1.0, at(1), None, None),
        (2, "s", at(5), 20.0, 2.0, at(6), None, None),
        (3, "s", at(5), 30.0, 3.0, at(9), None, None),  # delivered again
        (4, "s", at(12), 50.0, None, at(13), None, None),  # off the grid
        (5, "s", at(40), math.nan, 1.0, at(41), None, None),
        (6, "s", at(45), -1.0, 1.0, at(46), None, None),
        (7, "s", None, 5.0, 1.0, at(1), None, None),
        (8, "elsewhere", at(0), 5.0, 1.0, at(1), None, None),
    ]
    shards = [("s", "5m", at(0), at(30), "done"), ("s", "5m", at(20), at(50), None), ("s", "5m", at(50), at(50), "done"), ("t", "1h", at(0), at(120), "x"), (None, "5m", at(0), at(5), None), ("u", "odd", at(0), at(5), None)]
    got = grid(spark, rows, shards)
    assert {k[1] - e for k in got if k[0] == "s"} == {m * 60 for m in range(0, 50, 5)} and len(got) == 12
    r = lambda m: got["s", e + m * 60]
    assert (r(0)["close"], r(0)["volume"], r(0)["coverage"], r(0)["state"]) == (10.0, 1.0, 1.0, "observed")
    assert (r(5)["close"], r(5)["volume"]) == (30.0, 3.0)
    assert r(10)["close"] == pytest.approx(0.4 * 30 + 0.6 * 50) and r(10)["state"] == "observed" and r(10)["volume"] is None
    assert r(15)["state"] == "filled" and r(15)["close"] == 50.0 and r(15)["coverage"] == 1.0
    assert r(25)["state"] == "filled" and r(25)["coverage"] == pytest.approx(0.4)
    assert r(30)["state"] == "missing" and r(30)["close"] is None and r(40)["state"] == "missing" and r(45)["state"] == "missing"
    assert all(v["state"] == "missing" for k, v in got.items() if k[0] == "t")


def test_grid_of_empty_tables(spark):
    shard = [("s", "5m", T0, T0 + timedelta(minutes=10), None)]
    assert len(grid(spark, [], shard)) == 2
    assert grid(spark, [(1, "s", T0, 1.0, 1.0, T0, None, None)], []) == {}


def test_grid_over_stretches_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(regular, "STRETCH", 7)
    rng = np.random.default_rng(12)
    t = np.sort(rng.choice(6000, 80, replace=False))
    rows = [(i, "s", T0 + timedelta(seconds=int(x)), float(i + 1), 1.0, T0, None, None) for i, x in enumerate(t)]
    got = grid(spark, rows, [("s", "1m", T0, T0 + timedelta(minutes=100), None)])
    e = int(T0.timestamp())
    for k in range(100):
        near = cov = 0.0
        for i, a in enumerate(t):
            z = min(t[i + 1] if i + 1 < len(t) else 10**9, a + 180)
            part = max(0, min(z, (k + 1) * 60) - max(a, k * 60)) / 60
            near, cov = near + part * (i + 1), cov + part
        r = got["s", e + k * 60]
        assert r["coverage"] == pytest.approx(cov) and (r["close"] is None) == (cov == 0)
        if cov:
            assert r["close"] == pytest.approx(near / cov)
        assert (r["state"] == "observed") == bool(((t >= k * 60) & (t < (k + 1) * 60)).any())


def test_no_reading_of_a_suspicious_region_scores_below_its_floor():
    rng = np.random.default_rng(4)
    for seed in range(5):
        x = np.stack([rng.exponential(1, 400), rng.normal(size=400), rng.integers(1, 4, 400).astype(float)], 1)
        forest = spikes.grow(x, seed)
        y = rng.normal(0, 6, (3000, 3))
        s = spikes.score(forest, y, len(x))
        for f, above in ((0, 3.0), (1, 0.5), (2, 5.5)):
            floor = spikes.least_score(forest, f, above, len(x))
            assert 0 < floor <= s[y[:, f] > above].min()
        # far outside is more isolated than the midst
        assert spikes.score(forest, np.array([[30.0, 0.0, 1.0]]), 400)[0] > np.quantile(spikes.score(forest, x, 400), 0.9)
    assert spikes.least_score([], 0, 1.0, 0) <= 1


def test_odd_readings_hold_most_spikes(spark):
    rng = np.random.default_rng(11)
    n = 3000
    c = 100 * np.exp(np.cumsum(rng.normal(0, 0.001, n)))
    up, down, vol = (rng.exponential(1, n) for _ in range(3))
    at = rng.choice(np.arange(50, n), 40, replace=False)
    vol[at[:20]] = rng.uniform(21, 200, 20)
    up[at[20:]] = rng.uniform(21, 200, 20)
    rows = [(i, "s", datetime.fromtimestamp(60 * i, timezone.utc), float(c[i]), float(c[i] * (1 + up[i] * 1e-3)), float(c[i] * (1 - down[i] * 1e-3)), float(c[i]), float(vol[i] + 1e-9 * i)) for i in range(n)]
    df = spark.createDataFrame(rows, "bar_id long, symbol string, datetime timestamp, open double, high double, low double, close double, volume double")
    got = spikes.flag_readings(df).toPandas()
    assert got.spike.sum() >= 35 and (got.candidate | ~(got.spike | got.stuck)).all()
    assert got[got.spike].odd.mean() >= 0.9 and got.odd.mean() < 0.12


def test_forest_and_threshold_come_from_all_readings(spark, monkeypatch):
    rng = np.random.default_rng(21)
    n = 3000
    c = 100 * np.exp(np.cumsum(rng.normal(0, 0.001, n)))
    up, down, vol = rng.exponential(1, n), rng.exponential(1, n), rng.exponential(1, n)

    def flagged(up):
        rows = [(i, "s", datetime.fromtimestamp(60 * i, timezone.utc), float(c[i]), float(c[i] * (1 + up[i] * 1e-3)), float(c[i] * (1 - down[i] * 1e-3)), float(c[i]), float(vol[i])) for i in range(n)]
        df = spark.createDataFrame(rows, "bar_id long, symbol string, datetime timestamp, open double, high double, low double, close double, volume double")
        return spikes.flag_readings(df).toPandas().sort_values("bar_id", ignore_index=True)

    got = flagged(up)
    assert (got.odd == (got.score > np.quantile(got.score, 0.95) * (1 + 1e-12))).all()
    # Median and midst stay, and none of 1,000 readings drawn by their ids changes: the others count too.
    drawn = spark.range(n).orderBy(F.xxhash64("id"), "id").limit(1000).toPandas()["id"]
    changed = (up > np.quantile(up, 0.92)) & ~np.isin(np.arange(n), drawn)
    assert changed.sum() > 100
    other = flagged(np.where(changed, 2.5 * up, up))
    assert (other.score[~changed] != got.score[~changed]).mean() > 0.5
    monkeypatch.setattr(spikes, "HELD", 300)
    parts = flagged(up)
    assert np.allclose(parts.score, got.score, rtol=1e-12) and (parts.odd == got.odd).all()
