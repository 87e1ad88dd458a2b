"""Queries of the llm operators and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.instants import instant
from ..plans.common import INSTANT
from ..session import table
from . import clusters, leaks, mixing, percentiles, residue, topn, vectors


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topn.best_of_phylum(table(spark, sf_dir, "signatures")).select("phylum", "sig_id")


def p1_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = topn.best_of_phylum(table(spark, sf_dir, "signatures"), 20)
    return best.select("phylum", "sig_id", F.col("slot_31").cast("double").alias("quality"), "place")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.close_pairs(table(spark, sf_dir, "signatures"))


def p2_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every signature whose sig_id is divisible by 50, among all signatures."""
    return vectors.neighbours(table(spark, sf_dir, "signatures"), "sig_id", vectors.EMBEDDING, 10, 24, queries=F.col("sig_id") % 50 == 0)


def p3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles per symbol and per phylum: the stated error is 0."""
    rows = percentiles.symbol_and_phylum(table(spark, sf_dir, "signatures"))
    got = percentiles.order_statistics(rows, ["kind", "grp", "measure"], "value", "sig_id", percentiles.AT)
    return got.withColumn("x", F.round("x", 3) + 0.0)


def _months(spark: SparkSession, sf_dir: str) -> DataFrame:
    sig = table(spark, sf_dir, "signatures").filter(instant(F.col("timestamp")).isNotNull())
    month = F.date_format(instant(F.col("timestamp")), "yyyy-MM")
    return percentiles.long_measures(sig, symbol=F.col("symbol"), month=month)


def p3_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank summaries of single months per symbol, at 101 points each: what is kept to be combined later."""
    got = percentiles.rank_summary(_months(spark, sf_dir), ["symbol", "month", "measure"], "value", "sig_id")
    return got.withColumn("x", F.round("x", 3) + 0.0)


def p3_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per symbol over all months from the months' summaries: rank error at most 1/100."""
    parts = percentiles.rank_summary(_months(spark, sf_dir), ["symbol", "month", "measure"], "value", "sig_id")
    return percentiles.combine(parts, ["symbol", "measure"], 100, percentiles.AT).withColumn("x", F.round("x", 3) + 0.0)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.signature_clusters(table(spark, sf_dir, "signatures"))


def p7_typical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cluster with its size and its three most typical members."""
    return clusters.typical_members(table(spark, sf_dir, "signatures"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaked passage with its place in the document's text."""
    return leaks.leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.short_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mix and how often each is used."""
    return mixing.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets, budgets and the shares that the mix reaches."""
    return mixing.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue(table(spark, sf_dir, "documents")).select("doc_id")


def p10_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to exclude with their number of residue cells."""
    return residue.residue(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_ranked, p2_found, p2_search, p3_percentiles, p3_months, p3_combined, p7_found, p7_typical, p8_found, p8_passages, p9_found, p9_mix, p9_shares, p10_found, p10_cells)}

_TOP = """
select cast(slot_28 as bigint) as phylum, sig_id{more} from (
  select *, row_number() over (partition by cast(slot_28 as bigint) order by slot_31 desc, sig_id) as place
  from signatures where slot_28 is not null and slot_31 is not null and isfinite(slot_28) and isfinite(slot_31)
) t where place <= {n}"""

_MEASURE_ROWS = " union all ".join(
    f"select 'symbol' as kind, symbol as grp, '{m}' as measure, cast({m} as double) as value from signatures where {m} is not null and isfinite({m}) and symbol is not null"
    f" union all select 'phylum', cast(cast(slot_28 as bigint) as varchar), '{m}', cast({m} as double) from signatures where {m} is not null and isfinite({m}) and slot_28 is not null and isfinite(slot_28)"
    for m in percentiles.MEASURES
)

_VECTOR = " and ".join(f"isfinite({c})" for c in vectors.EMBEDDING)
_GAP = lambda cols: " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in cols)
_DOUBLES = lambda cols: ", ".join(f"cast({c} as double) as {c}" for c in cols)

_CLOSE = f"""
with v as (select sig_id, {_DOUBLES(vectors.EMBEDDING)} from signatures where coalesce({_VECTOR}, false) and ({" or ".join(f"{c} <> 0" for c in vectors.EMBEDDING)}))
select a.sig_id as sig_id_a, b.sig_id as sig_id_b from v a join v b on b.slot_16 >= a.slot_16 - 0.008 and b.slot_16 <= a.slot_16 + 0.008
where a.sig_id < b.sig_id and sqrt({_GAP(vectors.EMBEDDING)}) <= 0.008"""

_ALIKE = f"""
with recursive v as (select sig_id, {_DOUBLES(clusters.LIKENESS)} from signatures where coalesce({" and ".join(f"isfinite({c})" for c in clusters.LIKENESS)}, false)),
e as (select a.sig_id as x, b.sig_id as y from v a join v b on b.slot_07 >= a.slot_07 - 0.1 and b.slot_07 <= a.slot_07 + 0.1 where a.sig_id <> b.sig_id and sqrt({_GAP(clusters.LIKENESS)}) <= 0.1),
r as (select sig_id as x, sig_id as y from v where sig_id in (select x from e) union select r.x, e.y from r join e on r.y = e.x),
c as (select x as sig_id, min(y) as cluster_id, count(*) as n from r group by x)
select cluster_id, sig_id from c where n >= 15"""

_WORDS = """select {id}, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda w: lower(w)) as w from {table} where text is not null"""
_RUNS = """select {id}, array_to_string(w[k : k + 14], ' ') as run from (select {id}, w, unnest(range(1, len(w) - 13)) as k from ({words}) t where len(w) >= 15) u"""
_LEAKS = f"""
select distinct d.doc_id, i.item_id from ({_RUNS.format(id="doc_id", words=_WORDS.format(id="doc_id", table="documents"))}) d
join (select distinct item_id, run from ({_RUNS.format(id="item_id", words=_WORDS.format(id="item_id", table="eval_items"))}) x) i on i.run = d.run"""

_MONTH = f"({INSTANT.replace(chr(10), ' ')})"
_MONTHS = " union all ".join(f"select symbol, strftime({_MONTH}, '%Y-%m') as month, '{m}' as measure, cast({m} as double) as value from signatures where {m} is not null and isfinite({m}) and {_MONTH} is not null" for m in percentiles.MEASURES)

_POINTS = f"select symbol, measure, k, n, q[k + 1] as x from (select symbol, month, measure, count(*) as n, quantile_cont(value, [{', '.join(str(i / 100) for i in range(101))}]) as q from ({_MONTHS}) v group by symbol, month, measure) t, unnest(range(0, 101)) u(k)"
_COMBINED = f"""
with pts as (select symbol, measure, x, sum(n / 100.0::double * case when k in (0, 100) then 0.5 else 1.0 end) as w, sum(case when k = 0 then n else 0 end) as n from ({_POINTS}) t group by symbol, measure, x),
c as (select symbol, measure, x, sum(w) over (partition by symbol, measure order by x rows unbounded preceding) as upto, sum(n) over (partition by symbol, measure) as n from pts),
a as (select unnest([{', '.join(f'{p}::double' for p in percentiles.AT)}]) as p)
select symbol, measure, p, cast(n as bigint) as n, round(coalesce(min(x) filter (upto >= p * n - 1e-9), max(x)), 3) + 0.0 as x from c, a group by symbol, measure, p, n"""

SQL = {
    "p3_combined": _COMBINED,
    "p1_found": _TOP.format(more="", n=5),
    "p1_ranked": _TOP.format(more=", cast(slot_31 as double) as quality, cast(place as integer) as place", n=20),
    "p2_found": _CLOSE,
    "p3_percentiles": " union all ".join(
        f"select kind, grp, measure, cast({p} as double) as p, count(*) as n, round(quantile_cont(value, {p}), 3) + 0.0 as x from ({_MEASURE_ROWS}) v group by kind, grp, measure" for p in percentiles.AT
    ),
    "p3_months": f"select symbol, month, measure, k / 100.0::double as p, n, round(q[k + 1], 3) + 0.0 as x from (select symbol, month, measure, count(*) as n, quantile_cont(value, [{', '.join(str(i / 100) for i in range(101))}]) as q from ({_MONTHS}) v group by symbol, month, measure) t, unnest(range(0, 101)) u(k)",
    "p7_found": _ALIKE,
    "p8_found": _LEAKS,
    # Characters stand for tokens: no source is near its limit by either measure.
    "p9_found": """with s as (select lower(trim(source)) as k, sum(coalesce(length(text), 0)) as size from documents group by 1)
select t.source from source_targets t left join s on s.k = lower(trim(t.source)) where coalesce(s.size, 0) * t.max_repeats < t.target_share * (select sum(size) from s)""",
}
