"""Compaction by blocks on really tiny files, footers, stores, the candle source."""

import os
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from kilnmark.operators import compaction, store
from kilnmark.sources import footers, klines


def tiny(folder, n, seed=0, extra=False, codec="snappy"):
    os.makedirs(folder, exist_ok=True)
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        k = int(rng.integers(0, 9))
        t = pa.table({"id": pa.array(range(len(rows), len(rows) + k), pa.int64()), "x": pa.array([None if v < 0.1 else v for v in rng.random(k)], pa.float64()), "s": pa.array([f"text {v}" * 3 for v in range(k)]), "l": pa.array([[1, 2]] * k, pa.list_(pa.int32())), **({"more": pa.array([True] * k)} if extra else {})})
        pq.write_table(t, f"{folder}/f{i:04d}.parquet", compression=codec, row_group_size=3, write_page_index=bool(i % 2), use_dictionary=bool(i % 3), data_page_size=64)
        rows += t.to_pylist()
    return rows


def test_footer_round_trip(tmp_path):
    tiny(str(tmp_path), 3)
    data = (tmp_path / "f0001.parquet").read_bytes()
    n = int.from_bytes(data[-8:-4], "little")
    out = bytearray()
    footers.write_value(footers.STRUCT, footers.footer(data), out)
    assert bytes(out) == data[-8 - n : -8]
    with pytest.raises(ValueError):
        footers.footer(b"not parquet at all")


def test_many_tiny_files_become_few(spark, tmp_path):
    a, b = tiny(f"{tmp_path}/in/year=2020/month=01", 120), tiny(f"{tmp_path}/in/year=2020/month=02", 60, 1, codec="zstd")
    other = tiny(f"{tmp_path}/in/year=2020/month=03", 5, 2) + tiny(f"{tmp_path}/in/year=2020/month=03/odd", 4, 3, extra=True)
    got = compaction.compact(spark, f"{tmp_path}/in", f"{tmp_path}/out", 40_000).toPandas()
    assert got.files.sum() == 189 and got.rows.sum() == len(a) + len(b) + len(other) and len(got) < 25
    for month, want in (("01", a), ("02", b)):
        files = sorted(p for p in got.path if f"month={month}" in p)
        opened = [pq.ParquetFile(p.removeprefix("file:")) for p in files]
        rows = [r for f in opened for r in f.read().to_pylist()]
        assert rows == want
        assert sum(f.metadata.num_row_groups for f in opened) == got[got.path.isin(files)].row_groups.sum()
    assert spark.read.parquet(f"{tmp_path}/out/year=2020/month=01").count() == len(a)
    assert spark.read.parquet(f"{tmp_path}/out/year=2020/month=01").filter("x > 0.5").count() == sum(1 for r in a if r["x"] is not None and r["x"] > 0.5)
    again = compaction.compact(spark, f"{tmp_path}/in", f"{tmp_path}/out", 40_000).toPandas()
    assert sorted(again.path) == sorted(got.path) and spark.read.parquet(f"{tmp_path}/out/year=2020/month=02").count() == len(b)


def test_nothing_to_merge(spark, tmp_path):
    os.makedirs(f"{tmp_path}/none")
    assert compaction.compact(spark, f"{tmp_path}/none", f"{tmp_path}/out").count() == 0


def test_mixed_schemas_do_not_merge(tmp_path):
    tiny(f"{tmp_path}/a", 1), tiny(f"{tmp_path}/b", 1, extra=True)
    with pytest.raises(ValueError):
        compaction.merge_files([f"file:{tmp_path}/a/f0000.parquet", f"file://{tmp_path}/b/f0000.parquet"], f"file:{tmp_path}/c.parquet")
    with pytest.raises(ValueError, match="file system"):
        compaction.merge_files([f"{tmp_path}/a/f0000.parquet"], f"{tmp_path}/c.parquet")


def test_paths_with_and_without_scheme(spark, tmp_path, monkeypatch):
    rows = tiny(f"{tmp_path}/in/a b=1", 20)
    monkeypatch.setattr(compaction, "PIECE", 7)
    for i, scheme in enumerate(("", "file:", "file://")):
        got = compaction.compact(spark, f"{scheme}{tmp_path}/in", f"{scheme}{tmp_path}/out{i}").collect()
        assert [r["path"] for r in got] and all(r["path"].startswith("file:") for r in got)
        assert pq.read_table(f"{tmp_path}/out{i}/a b=1", partitioning=None).num_rows == len(rows)


SIG = "sig_id long, symbol string, interval string, timestamp string, year string, month string, slot_28 float, file_id long, ingested_at timestamp, keeper string, path string"


def signatures(spark):
    t = datetime(2020, 1, 1, tzinfo=timezone.utc)
    rows = [
        (1, "a", "5m", "2020-02-01 00:05:00", "2020", "2", 1.0, 7, t, "clash", "p"),
        (2, "a", "5m", "2020-02-01T00:05:00Z", "20", "Feb", float("nan"), 8, t, None, None),
        (3, "a", "5m", str(1580515500000), None, None, None, 8, None, None, None),
        (4, "a", "1m", "2020-02-01 00:05:00", "2020", "02", 1.0, 7, t, None, None),
        (5, "b", "5m", None, "2020", "02", 1.0, 7, t, None, None),
        (6, "b", "5m", None, "2020", "02", 1.0, 9, t, None, None),
        (7, None, "5m", "2020-02-01 00:05:00", "2020", "02", 1.0, 7, t, None, None),
        (8, "b", "5m", "garbage", "x", "y", 1.0, None, t, None, None),
    ]
    return spark.createDataFrame(rows, SIG), spark.createDataFrame([(7, "signatures/year=2020/month=03/f.parquet"), (8, "year=2020/month=02/g")], "file_id long, path string")


def test_signatures_stored_once(spark, tmp_path):
    s, f = signatures(spark)
    merged, doubles, stored = compaction.compact_signatures(s, f, f"{tmp_path}/out")
    assert {r["sig_id"]: r["keeper"] for r in doubles.collect()} == {1: 2, 2: 2, 3: 2}
    got = {r["sig_id"]: (r["year"], r["month"]) for r in stored.collect()}
    assert got == {2: ("2020", "02"), 4: ("2020", "02"), 5: ("2020", "03"), 6: ("unknown", "unknown"), 7: ("2020", "02"), 8: ("unknown", "unknown")}
    assert merged.agg(F.sum("rows")).first()[0] == 6
    assert sorted(map(tuple, compaction.stored_twice(s, f).collect())) == [(1, 2), (1, 3), (2, 3)]


def test_no_signatures(spark, tmp_path):
    s, f = signatures(spark)
    merged, doubles, stored = compaction.compact_signatures(s.limit(0), f.limit(0), f"{tmp_path}/out")
    assert merged.count() == doubles.count() == stored.count() == 0
    assert compaction.stored_twice(s.limit(0), f.limit(0)).count() == 0


def test_store_is_idempotent_and_labels_join_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 0.9), (2, "b", 0.2), (3, "a", None)], "id int, symbol string, quality double").withColumn("ts", F.lit("2020-05-01").cast("timestamp"))
    for _ in range(2):
        store.store_batch(df, f"{tmp_path}/a", least=0.1)
    assert spark.read.parquet(f"{tmp_path}/a").count() == 2
    store.store_batch(df, f"{tmp_path}/a", least=0.1, replace=False)
    assert spark.read.parquet(f"{tmp_path}/a").count() == 4
    assert store.archive_view(spark, "v", f"{tmp_path}/a", f"{tmp_path}/nowhere").count() == 4
    got = store.relabelled(df.select("id", "quality"), spark.createDataFrame([(2, None), (9, 1.0)], "id int, quality double"), "id", "quality").collect()
    assert {r["id"]: r["quality"] for r in got} == {1: 0.9, 2: None, 3: None}


def test_candle_pages(spark, tmp_path):
    now = 1_000_000.0
    assert klines.retry_after("7") == 7 and klines.retry_after(None) == 1 and klines.retry_after("soon") == 1
    assert klines.retry_after("Mon, 12 Jan 1970 13:46:50 GMT", now) == 10
    calls, waits = [], []

    def fetch(start, limit):
        calls.append(start)
        if len(calls) == 2:
            return 429, {"Retry-After": "3"}, []
        return 200, {}, [[t, "1", "2", "0.5", "1.5", "9"] for t in range(max(start - 1, 0), 25)][:limit]

    got = [r[0] for r in klines.pages(fetch, 0, 22, limit=10, sleep=waits.append)]
    assert got == list(range(23)) and waits == [3.0]
    assert list(klines.pages(lambda s, n: (200, {}, []), 0, 5)) == []
    with pytest.raises(OSError):
        list(klines.pages(lambda s, n: (500, {}, []), 0, 5, sleep=lambda s: None))
    os.makedirs(f"{tmp_path}/pages")
    for i in range(3):
        with open(f"{tmp_path}/pages/ETH.{i}.jsonl", "w") as f:
            f.write('[[%d,"1","2","0.5","1.5","9",%d,"3",4,"5","6","0"]]\n\n[]\n' % (i, i + 1))
    spark.dataSource.register(klines.KlineSource)
    rows = spark.read.format("kline_pages").load(f"{tmp_path}/pages").orderBy("open_time").collect()
    assert [(r["symbol"], r["open_time"], r["trades"]) for r in rows] == [("ETH", 0, 4), ("ETH", 1, 4), ("ETH", 2, 4)]
    q = spark.readStream.format("kline_pages").load(f"{tmp_path}/pages").writeStream.format("memory").queryName("candles").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("candles").count() == 3


def test_many_rows_left_out_meet_in_a_shuffle(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(compaction, "BROADCAST_IDS", 0)
    s, f = signatures(spark)
    merged, doubles, stored = compaction.compact_signatures(s, f, f"{tmp_path}/out")
    assert stored.count() == s.count() - doubles.filter("sig_id <> keeper").count() and stored.select("sig_id").distinct().count() == stored.count()


def test_bounds_from_footers(spark, tmp_path):
    t = [datetime(2020, 1, d, tzinfo=timezone.utc) for d in (1, 2, 3, 4)]
    pq.write_table(pa.table({"at": pa.array([t[1], t[3], None], pa.timestamp("us", "UTC"))}), f"{tmp_path}/a b.parquet")
    pq.write_table(pa.table({"at": pa.array([None, t[0]], pa.timestamp("us", "UTC"))}), f"{tmp_path}/b.parquet")
    pq.write_table(pa.table({"at": pa.array([None], pa.timestamp("us", "UTC"))}), f"{tmp_path}/c.parquet")
    names = spark.read.parquet(str(tmp_path)).inputFiles()
    got = compaction.footer_bounds(spark, names, "at").select("n", F.unix_seconds("low").alias("low"), F.unix_seconds("high").alias("high")).first()
    assert tuple(got) == (6, int(t[0].timestamp()), int(t[3].timestamp()))
    pq.write_table(pa.table({"at": pa.array([t[2]], pa.timestamp("us", "UTC"))}), f"{tmp_path}/d.parquet", write_statistics=False)
    assert compaction.footer_bounds(spark, [*names, f"file:{tmp_path}/d.parquet"], "at") is None
    assert compaction.footer_bounds(spark, [], "at").first()["n"] == 0
