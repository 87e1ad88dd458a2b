"""Queries of the core's data operators: compaction, implausible readings, regular grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compaction, regular, spikes
from ..session import table, work_path
from .common import INSTANT, r6


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.stored_twice(table(spark, sf_dir, "signatures"), table(spark, sf_dir, "signature_files"))


def p4_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows stored per year and month after compaction."""
    target = work_path(spark, "compacted")
    _, _, stored = compaction.compact_signatures(table(spark, sf_dir, "signatures"), table(spark, sf_dir, "signature_files"), target)
    return stored.groupBy(F.col("year").cast("string").alias("year"), F.col("month").cast("string").alias("month")).agg(F.count("*").alias("n"), F.count_distinct("sig_id").alias("ids"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes.implausible(table(spark, sf_dir, "ohlcv"))


def p5_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bar with its flags and its isolation score."""
    return spikes.flag_readings(table(spark, sf_dir, "ohlcv"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regular.missing_slots(table(spark, sf_dir, "ohlcv"), table(spark, sf_dir, "mining_shards"))


def p6_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every slot of the shards with close, volume, coverage and state."""
    got = regular.regular_bars(table(spark, sf_dir, "ohlcv"), table(spark, sf_dir, "mining_shards"))
    return got.withColumns({c: r6(c) for c in ("close", "volume", "coverage")})


QUERIES = {f.__name__: f for f in (p4_found, p4_months, p5_found, p5_scores, p6_found, p6_grid)}

_SLOTS = """
with sec(iv, s) as (values ('1m', 60), ('5m', 300), ('15m', 900), ('1h', 3600)),
slots as (
  select distinct symbol, s, unnest(generate_series(cast(epoch(shard_start) as bigint), cast(epoch(shard_end) as bigint) - s, s)) as slot_epoch
  from mining_shards join sec on iv = "interval"),
have as (
  select distinct o.symbol, cast(floor(epoch(o.datetime) / x.s) as bigint) * x.s as slot_epoch
  from ohlcv o join (select distinct symbol, s from slots) x on x.symbol = o.symbol
  where o.datetime is not null and o."close" is not null and isfinite(o."close") and o."close" > 0)
select slots.symbol, slots.slot_epoch from slots left join have on have.symbol = slots.symbol and have.slot_epoch = slots.slot_epoch
where have.symbol is null"""

_FINE = lambda c: f"coalesce(isfinite({c}) and {c} > 0, false)"
_RUN = lambda same: f"""
select bar_id from (select bar_id, count(*) over (partition by symbol, g) as n, ok from (
  select bar_id, symbol, ok, sum(case when {same} and ok and pok then 0 else 1 end) over (partition by symbol order by datetime, bar_id rows between unbounded preceding and current row) as g from (
    select *, lag(volume) over w as pv, lag("high") over w as ph, lag("low") over w as pl, lag(ok) over w as pok
    from (select *, coalesce(isfinite(volume) and volume <> 0, false) as ok from ohlcv where datetime is not null) t
    window w as (partition by symbol order by datetime, bar_id)) u) v) x where n >= 6 and ok"""  # noqa: E731
_SPIKES = f"""
with q as (select *, {_FINE('"open"')} as fo, {_FINE('"close"')} as fc, {_FINE('"high"')} as fh, {_FINE('"low"')} as fl from ohlcv),
m as (select *, case when fo and fc and fh then "high" / greatest("open", "close") - 1 end as up,
  case when fo and fc and fl then 1 - "low" / least("open", "close") end as down,
  case when isfinite(volume) and volume >= 0 then volume end as vol from q),
med as (select symbol as s, quantile_cont(up, 0.5) as mu, quantile_cont(down, 0.5) as md, quantile_cont(vol, 0.5) as mv from m group by symbol)
select distinct bar_id from (
select bar_id from m where ("high" is not null and not fh) or ("low" is not null and not fl) or (volume is not null and not coalesce(isfinite(volume) and volume >= 0, false))
 or (fh and fl and "high" < "low") or (fh and fo and "high" < "open") or (fh and fc and "high" < "close") or (fl and fo and "low" > "open") or (fl and fc and "low" > "close")
union all select bar_id from m join med on s = symbol where up > 20 * mu or down > 20 * md or vol > 20 * mv
union all {_RUN('coalesce(volume = pv, false)')}
union all {_RUN('coalesce("high" = ph and "low" = pl, false)')}) f"""

_GRID = f"""
with sec(iv, s) as (values ('1m', 60), ('5m', 300), ('15m', 900), ('1h', 3600)),
slots as (
  select distinct symbol, s, unnest(generate_series(cast(epoch(shard_start) as bigint), cast(epoch(shard_end) as bigint) - s, s)) as slot_epoch
  from mining_shards join sec on iv = "interval"),
r as (select o.symbol, x.s, x.s * 1000000::bigint as us, epoch_us(o.datetime) as t, o."close" as v, case when isfinite(o.volume) and o.volume >= 0 then o.volume end as amount,
    row_number() over (partition by o.symbol, x.s, o.datetime order by o.received_at desc nulls last, o.bar_id desc nulls last) as rn
  from ohlcv o join (select distinct symbol, s from slots) x on x.symbol = o.symbol where o.datetime is not null and {_FINE('o."close"')}),
u as (select *, least(coalesce(lead(t) over (partition by symbol, s order by t), t + 3 * us), t + 3 * us) as until from r where rn = 1),
c as (select *, unnest(generate_series(t // us, (until - 1) // us)) as cell from u),
w as (select *, (least(until, (cell + 1) * us) - greatest(t, cell * us)) / us as share from c),
g as (select symbol, s, cell * s as slot_epoch, sum(share * v) / sum(share) as v, sum(share) as share, sum(case when t // us = cell then amount end) as amount, count(*) filter (t // us = cell) as started from w group by symbol, s, cell)
select slots.symbol, slots.slot_epoch, round(v, 6) + 0.0 as "close", round(amount, 6) + 0.0 as volume, round(coalesce(share, 0.0), 6) + 0.0 as coverage,
  case when started > 0 then 'observed' when share > 0 then 'filled' else 'missing' end as state
from slots left join g on g.symbol = slots.symbol and g.s = slots.s and g.slot_epoch = slots.slot_epoch"""

_PART = lambda k: f"coalesce(nullif(regexp_extract(path, '{k}=([0-9]+)', 1), ''), 'unknown')"
_KEPT = f"""
with s as (select sig_id, symbol, "interval" as iv, {INSTANT} as t, file_id from signatures),
f as (select file_id, min(path) as path from signature_files group by file_id),
k as (
  select sig_id, strftime(t, '%Y') as year, strftime(t, '%m') as month from (select *, row_number() over (partition by symbol, iv, t order by sig_id) as rn from s where t is not null) x where rn = 1 or symbol is null or iv is null
  union all select sig_id, {_PART('year')}, {_PART('month')} from s left join f using (file_id) where t is null)
select year, month, count(*) as n, count(distinct sig_id) as ids from k group by year, month"""

SQL = {
    "p4_months": _KEPT,
    "p6_grid": _GRID,
    "p4_found": f"""with s as (select sig_id, symbol, "interval" as iv, {INSTANT} as at from signatures where "timestamp" is not null)
select a.sig_id as sig_id_a, b.sig_id as sig_id_b from s a join s b on a.symbol = b.symbol and a.iv = b.iv and a.at = b.at and a.sig_id < b.sig_id""",
    "p5_found": _SPIKES,
    "p6_found": _SLOTS,
}
