"""Queries of the registry against their SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
CHECKED = [
    "flagship", "t02_tick_bars", "t02_stream_bars", "t06_stream_outcomes", "t11_sessions", "w02_rolling_extremes", "w05_zscore", "w10_levels", "w20_forward_outcomes", "w22_bars_to_peak", "w24_expanding_volatility",
    "w29_cusum", "w33_value_ranks", "w27_dynamic_threshold", "f01_slot_01", "f05_slot_05", "f10_slot_10", "f34_hash_split", "s02_incremental", "s08_shard_slice", "s18_partition_counts", "s04_kline_pages", "j01_asof_funding", "j02_reindex_fill",
    "j07_calendar_fill", "a01_phylum_edge", "a04_phylum_profile", "a13_cutoffs", "a14_edge_metrics", "a19_column_profile", "a29_horizon_study", "a35_ablation", "a37_calibration_ledger", "m01_mutual_information", "m07_prior_percentiles",
    "o04_best_per_day", "o06_composite_rank", "u04_month_difference", "pred17_literal_scan", "p4_found", "p5_found", "p6_found",
]


def rows(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
            return "~"
        return f"{float(v):.6g}" if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v)

    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    return c


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert rows(got) == rows(duck.sql(entry.oracle_sql()[name]).df())


def test_entry_and_names(spark):
    got = entry.entry(spark)
    assert got.columns == ["symbol", "ts_us", "close", "z", "gain"] and got.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
