"""Slots against pandas, independence of blocks and of the future, streams against batches."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kilnmark.functions import slots as S
from kilnmark.operators import conviction as C
from kilnmark.operators import outcomes
from kilnmark.operators.blocks import along, core, positions, with_halo
from kilnmark.streaming import flows


def series(n=900, seed=0):
    rng = np.random.default_rng(seed)
    c = 100 * np.exp(np.cumsum(rng.normal(0, 0.001, n)))
    o = np.append(c[0], c[:-1])
    h, low = np.maximum(o, c) * (1 + np.abs(rng.normal(0, 0.0005, n))), np.minimum(o, c) * (1 - np.abs(rng.normal(0, 0.0005, n)))
    return pd.DataFrame({"symbol": "s", "interval": "5m", "ts": pd.date_range("2020-01-01", periods=n, freq="5min", tz="UTC"), "open": o, "high": h, "low": low, "close": c, "volume": rng.exponential(100, n)})


@pytest.fixture(scope="module")
def slots(spark):
    pdf = series()
    return pdf, core(S.all_slots(spark.createDataFrame(pdf))).toPandas().sort_values("ts").reset_index(drop=True)


def test_slots_equal_pandas(slots):
    pdf, got = slots
    e = 1e-12
    c, v = pdf.close, pdf.volume
    r = np.log(c / c.shift() + e)
    pct = c.pct_change().fillna(0)
    z = ((pct - pct.rolling(20, min_periods=1).mean()) / pct.rolling(20, min_periods=1).std().clip(lower=e)).clip(-10, 10)
    buy = v / (1 + np.exp(-1.5 * z))
    sell = v - buy
    span = (pdf.high.rolling(24).max() - pdf.low.rolling(24).min()).clip(lower=e)
    b = buy.where((pdf.low - pdf.low.rolling(24).min()) / span < 0.05, 0.0).ewm(span=1.2, adjust=False).mean()
    s = sell.where((pdf.high.rolling(24).max() - pdf.high) / span < 0.05, 0.0).ewm(span=1.2, adjust=False).mean()
    z12 = lambda x, n: ((x - x.rolling(n, min_periods=1).mean()) / x.rolling(n, min_periods=1).std().clip(lower=e)).clip(-10, 10).fillna(0)

    def entropy(x):
        p = np.histogram(x, 10)[0] / len(x)
        p = p[p > 0]
        return -(p * np.log(p + e)).sum()

    def spectral(x):
        p = np.abs(np.fft.rfft(x - x.mean())) ** 2
        p = p / p.sum()
        p = p[p > e]
        return -(p * np.log(p)).sum()

    def hurst(x):
        d = np.cumsum(x - x.mean())
        return 0.5 - np.log((d.max() - d.min()) / (x.std() + e)) / np.log(len(x))

    want = {
        "slot_00": ((b - s) / (b + s + e)).clip(-1, 1).fillna(0),
        "slot_01": ((buy - sell).abs() / (buy + sell).clip(lower=e)).rolling(100).mean().fillna(0),
        "slot_02": r.rolling(72).apply(spectral, raw=True).fillna(0),
        "slot_03": np.log((r.rolling(12).var() + e) / (r.rolling(144).var() + e)).fillna(0),
        "slot_04": r.rolling(120).apply(hurst, raw=True).fillna(0),
        "slot_05": pd.concat([r.rolling(48).apply(lambda x, k=k: pd.Series(x).autocorr(k), raw=True).abs() for k in range(1, 6)], axis=1).mean(axis=1).fillna(0),
        "slot_06": z12(pd.concat([(c - c.ewm(span=k, adjust=False).mean()).abs() for k in (8, 13, 21, 34, 55)], axis=1).mean(axis=1), 12),
        "slot_13": r.rolling(96).apply(entropy, raw=True).fillna(0),
    }
    for k, x in want.items():
        np.testing.assert_allclose(got[k], x, atol=2e-6, err_msg=k)
    assert np.isfinite(got[[f"slot_{i:02d}" for i in range(16)]].to_numpy()).all()
    assert got.slot_15.between(0, 1).all() and got.slot_14.between(0, 1).all() and (got.slot_08.isin([0, 1])).all()


def test_slots_do_not_depend_on_blocks_or_the_future(spark, monkeypatch):
    pdf = series(2300, 1)
    names = [f"slot_{i:02d}" for i in range(16)]
    whole = core(S.all_slots(spark.createDataFrame(pdf))).toPandas().sort_values("ts")
    monkeypatch.setattr(S, "BLOCK", 300)
    parts = core(S.all_slots(spark.createDataFrame(pdf))).toPandas().sort_values("ts")
    np.testing.assert_allclose(parts[names], whole[names], atol=1e-7)
    past = core(S.all_slots(spark.createDataFrame(pdf[:1500]))).toPandas().sort_values("ts")
    # The level slot looks pivot_strength bars ahead for pivots, but uses them only that much later.
    np.testing.assert_allclose(past[names], whole[names][:1500], atol=1e-7)


def test_kernels_equal_windows(spark, slots):
    pdf, got = slots
    for name in ("slot_05", "slot_10"):
        one = S.single_slot(spark.createDataFrame(pdf), name).toPandas().sort_values("ts")
        np.testing.assert_allclose(got[name], one[name], atol=1e-9, err_msg=name)


def test_composite_kernel_equals_windows(spark, slots):
    pdf, got = slots
    df = with_halo(spark.createDataFrame(got.drop(columns="slot_15")), 2000)
    one = core(S.staged(df, S.composite(along(), S.SlotConfig()))).toPandas().sort_values("ts")
    np.testing.assert_allclose(got.slot_15, one.slot_15, atol=1e-9)


def test_flat_and_short_series(spark):
    flat = series(400)
    flat[["open", "high", "low", "close"]] = 5.0
    flat["volume"] = 0.0
    got = core(S.all_slots(spark.createDataFrame(flat))).toPandas()
    assert np.isfinite(got[[f"slot_{i:02d}" for i in range(16)]].to_numpy()).all()
    assert len(core(S.all_slots(spark.createDataFrame(series(1)))).toPandas()) == 1
    assert core(S.all_slots(spark.createDataFrame(series(5)).limit(0))).count() == 0


def test_weights_and_names_are_checked(spark):
    with pytest.raises(ValueError):
        S.composite(along(), S.SlotConfig(weights={"slot_00": 0.5}))
    with pytest.raises(ValueError):
        S.single_slot(spark.createDataFrame(series(3)), "slot_77")
    with pytest.raises(ValueError):
        outcomes.gate(F.col("x"), 0.1, mode="other")


def test_signature_rows(spark):
    pdf = series(1000, 2)
    got = outcomes.signature_rows(spark.createDataFrame(pdf)).toPandas().sort_values("ts")
    assert len(got) == 1000 - 500 - 288 and {f"slot_{i:02d}" for i in range(32)} <= set(got.columns)
    i = 600
    row = got[got.ts == pdf.ts[i].tz_localize(None)].iloc[0]
    entry, hi, lo = pdf.open[i + 1], pdf.high[i + 1 : i + 289].max(), pdf.low[i + 1 : i + 289].min()
    up, down = (hi - entry) / entry, (entry - lo) / entry
    assert (row.mfe, row.mae) == pytest.approx((up, down) if row.slot_00 >= 0 else (down, up))
    assert (got.slot_31 == got.slot_15).all() and (got.neural_conviction == 0.05).all()


def test_conviction_buffer_equals_the_loop(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in ("a", "b"):
        t = np.cumsum(rng.choice([60, 3600, 86_400, 5 * 86_400, 20 * 86_400], 80)) + 1_500_000_000
        rows += [(k, int(x), float(rng.random()), i) for i, x in enumerate(t)]
    rows += [("a", rows[10][1], 0.5, 500)]  # the same instant again
    got = C.buffered(spark.createDataFrame(rows, "k string, t long, x double, i int"), "k", "t", "x", "i")
    got = {(r["k"], r["i"]): (r["_buffer"], r["rank"], r["th"]) for r in got.withColumns({"rank": C.rank_in(F.col("_buffer"), F.col("x")), "th": C.threshold(F.col("_buffer"))}).collect()}
    for k in ("a", "b"):
        own = sorted((t, i, x) for kk, t, x, i in rows if kk == k)
        for n, (t, i, x) in enumerate(own):
            near = n and t - own[n - 1][0] <= C.WEEK
            want = [y for s, _, y in own[:n] if s >= own[n - 1][0] - C.WEEK] if near else []
            assert sorted(got[k, i][0]) == pytest.approx(sorted(want)), (k, i)
            assert got[k, i][1] == pytest.approx(np.mean([y <= x for y in want]) if want else x)
            assert got[k, i][2] == pytest.approx(np.median(want) * 1.1 if want else 1e-12)


def test_norms_and_embedding(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, []), (3, None)], "i int, v array<double>")
    assert {r["i"]: r["n"] for r in df.select("i", C.lp_norm(F.col("v")).alias("n")).collect()} == pytest.approx({1: 5.0, 2: 0.0, 3: 0.0})
    got = C.embedded(spark.createDataFrame([(1, [1.0, 2.0, 4.0]), (2, [1.0]), (3, None)], "i int, v array<double>"), "v").collect()
    assert {r["i"]: None if r["embedding"] is None else len(r["embedding"]) for r in got} == {1: 8, 2: None, 3: None}


def test_streams_equal_batches(spark, tmp_path):
    rows = [("k", float(i), float((i * 7) % 5)) for i in range(40)]
    for n in range(4):
        spark.createDataFrame(rows[n * 10 : n * 10 + 10], "key string, seconds double, value double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{n}")
    stream = lambda: spark.readStream.schema("key string, seconds double, value double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    got = flows.drained(flows.buffer_ranks(stream(), "key", "seconds", "value", 8), "ranks").toPandas().sort_values("seconds")
    for n, r in enumerate(got.itertuples()):
        want = [v for _, s, v in rows[:n] if s >= rows[n - 1][1] - 8] if n else []
        assert r.seen == len(want) and r.share == pytest.approx(np.mean([v <= r.value for v in want]) if want else r.value)
    bars = stream().selectExpr("key as symbol", "cast(seconds as long) as ts_us", "value as high", "-value as low")
    out = flows.drained(flows.delayed_outcomes(bars, 6), "out").toPandas().sort_values("ts_us")
    v = pd.Series([r[2] for r in rows])
    assert len(out) == 34 and out.top.tolist() == [v[i + 1 : i + 7].max() for i in range(34)]
    flows.into_folder(stream(), f"{tmp_path}/sink", f"{tmp_path}/state")
    flows.into_folder(stream(), f"{tmp_path}/sink", f"{tmp_path}/state")
    assert spark.read.parquet(f"{tmp_path}/sink").count() == 40


def test_stream_buffer_spans_a_week(spark, tmp_path):
    import __spark_entry__ as entry

    day = lambda d: pd.Timestamp("2024-01-01") + pd.Timedelta(days=d)
    rows = [("k", day(0.5 * i), float((i * 7) % 11)) for i in range(30)] + [("z", day(3), 1.0)]
    spark.createDataFrame(pd.DataFrame(rows, columns=["event_type", "ts", "value"])).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = entry.queries()["t03_stream_buffer"](spark, str(tmp_path)).toPandas().sort_values("seconds")
    assert got[got.key == "z"][["seen", "share"]].values.tolist() == [[0, 1.0]]
    for n, r in enumerate(got[got.key == "k"].itertuples()):
        want = [v for _, t, v in rows[:n] if t >= rows[n - 1][1] - pd.Timedelta(days=7)]
        assert r.seen == len(want) and r.share == pytest.approx(np.mean([v <= rows[n][2] for v in want]) if want else rows[n][2], abs=1e-6)
    assert got.seen.max() == 15
