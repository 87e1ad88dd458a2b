"""Queries over the signature archive: filters, profiles, distributions, audits, rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.instants import instant
from ..functions.stats import t_of_r
from ..operators import windows as W
from ..operators.order_stats import exact_quantiles
from ..session import table, work_path
from .common import Registry, bars, no_minus_zero, r6, sigs, sql, us
from .series import _US, unique_sigs

q = Registry()
def phylum() -> Column:
    return F.col("phylum").cast("long")


def gain() -> Column:
    return F.col("mfe") - F.col("mae")


def one_row_quantiles(df: DataFrame, c: str, ps: dict[str, float]) -> DataFrame:
    got = exact_quantiles(df, None, {c: F.col(c)}, list(ps.values()))
    return got.agg(*[F.max(F.when(F.abs(F.col("p") - p) < 1e-9, F.col("x"))).alias(k) for k, p in ps.items()])


# ---- Filters ---------------------------------------------------------------------------------------------------


@q("pred01_quality_gate", sql("select sig_id from sigs where quality >= 0.5"))
def pred01(spark, sf_dir):
    return sigs(spark, sf_dir).filter("quality >= 0.5").select("sig_id")


@q("pred02_elite", sql("select sig_id, quality from sigs where quality >= 0.9 and flag"))
def pred02(spark, sf_dir):
    sigs(spark, sf_dir).createOrReplaceTempView("_elite_source")
    return spark.sql("select sig_id, quality from _elite_source where quality >= :least and IDENTIFIER(:flag)", args={"least": 0.9, "flag": "flag"})


@q("pred03_regime", sql("select sig_id, slot_08 as regime from sigs where slot_08 = 3"))
def pred03(spark, sf_dir):
    return sigs(spark, sf_dir).filter("slot_08 = 3").select("sig_id", F.col("slot_08").alias("regime"))


@q("pred03_regime_probable", sql("select sig_id, slot_08 as regime from sigs where slot_08 >= 0.75"))
def pred03b(spark, sf_dir):
    return sigs(spark, sf_dir).filter("slot_08 >= 0.75").select("sig_id", F.col("slot_08").alias("regime"))


@q("pred04_audit_trail", sql("select sig_id, epoch_us(ts) as ts_us, symbol, data_hash, config_hash, git_commit from sigs where ts >= timestamp '2015-03-01' and ts < timestamp '2015-07-01'"))
def pred04(spark, sf_dir):
    s = sigs(spark, sf_dir).filter((F.col("ts") >= F.lit("2015-03-01").cast("timestamp")) & (F.col("ts") < F.lit("2015-07-01").cast("timestamp")))
    return s.select("sig_id", us("ts").alias("ts_us"), "symbol", "data_hash", "config_hash", "git_commit")


@q("pred04_audit_text", 'select sig_id from signatures where "timestamp" >= \'2015-03-01\' and "timestamp" <= \'2015-06-30\'')
def pred04b(spark, sf_dir):
    """The same bounds compared as text, which leaves out the last day's rows: kept for parity with text timestamps."""
    return table(spark, sf_dir, "signatures").filter("timestamp between '2015-03-01' and '2015-06-30'").select("sig_id")


@q("pred05_mined", sql("select sig_id from sigs where flag"))
def pred05(spark, sf_dir):
    return sigs(spark, sf_dir).filter("flag").select("sig_id")


@q("pred06_mfe_range", sql("select sig_id, mfe from sigs where mfe between 0.2 and 0.5"))
def pred06(spark, sf_dir):
    return sigs(spark, sf_dir).filter("mfe between 0.2 and 0.5").select("sig_id", "mfe")


@q("pred07_high_yield", sql("select count(*) as n from sigs where mfe >= 0.02"))
def pred07(spark, sf_dir):
    return sigs(spark, sf_dir).filter("mfe >= 0.02").agg(F.count("*").alias("n"))


@q("pred08_first_in_month", "select min(sig_id) as sig_id from signatures where contains(\"timestamp\", '2015-08-')")
def pred08(spark, sf_dir):
    return table(spark, sf_dir, "signatures").filter(F.col("timestamp").contains("2015-08-")).agg(F.min("sig_id").alias("sig_id"))


@q("pred09_substring", "select bar_id from ohlcv where symbol ilike '%usdc%'")
def pred09(spark, sf_dir):
    return table(spark, sf_dir, "ohlcv").filter(F.col("symbol").ilike("%usdc%")).select("bar_id")


@q("pred10_above_percentile", sql("select sig_id, mfe from sigs where mfe >= (select quantile_cont(mfe, 0.99) from sigs)"))
def pred10(spark, sf_dir):
    s = sigs(spark, sf_dir)
    edge = one_row_quantiles(s, "mfe", {"edge": 0.99}).first()["edge"]
    return s.filter(F.col("mfe") >= F.lit(edge)).select("sig_id", "mfe")


@q("pred13_finite_masks", no_minus_zero("select bar_id from ohlcv where \"open\" is not null and isfinite(\"open\") and \"high\" is not null and isfinite(\"high\") and volume is not null and isfinite(volume)"))
def pred13(spark, sf_dir):
    good = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) for c in ("open", "high", "volume")])
    return table(spark, sf_dir, "ohlcv").filter(good).select("bar_id")


@q("pred15_base_schema", "select bar_id, symbol, coalesce(quote_volume, 0.0) as quote_volume, coalesce(cast(trades as double), 0.0) as trades, 0.0 as taker_volume from ohlcv where quote_volume is null or isfinite(quote_volume)")
def pred15(spark, sf_dir):
    """Rows brought to a wider schema: missing columns and nulls filled with 0."""
    t = table(spark, sf_dir, "ohlcv").filter("quote_volume is null or (not isnan(quote_volume) and abs(quote_volume) < double('Infinity'))")
    wide = t.select("bar_id", "symbol", "quote_volume", F.col("trades").cast("double").alias("trades")).withColumn("taker_volume", F.lit(0.0))
    return wide.fillna(0.0, ["quote_volume", "trades"])


@q("pred16_partition_columns", sql("select sig_id, strftime(ts, '%Y') as year, strftime(ts, '%m') as month from sigs where ts is not null"))
def pred16(spark, sf_dir):
    return sigs(spark, sf_dir).filter("ts is not null").select("sig_id", F.date_format("ts", "yyyy").alias("year"), F.date_format("ts", "MM").alias("month"))


@q("pred17_literal_scan", r"""select doc_id, cast(k - 1 as bigint) as line from (select doc_id, unnest(string_split(text, chr(10))) as l, unnest(range(1, len(string_split(text, chr(10))) + 1)) as k from documents where text is not null) t
 where regexp_matches(l, '=\s*[0-9]+\.[0-9]+') and not regexp_matches(l, '^\s*#|range\(|print')""")
def pred17(spark, sf_dir):
    """Lines that assign a decimal literal, comments and allowed calls aside."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "l"))
    return lines.filter(F.col("l").rlike(r"=\s*[0-9]+\.[0-9]+") & ~F.col("l").rlike(r"^\s*#|range\(|print")).select("doc_id", F.col("line").cast("long").alias("line"))


@q("pred18_paths", "select file_id from signature_files where regexp_matches(path, 'month=0[1-6]') and not regexp_matches(path, 'symbol=[A-M]')")
def pred18(spark, sf_dir):
    return table(spark, sf_dir, "signature_files").filter(F.col("path").rlike("month=0[1-6]") & ~F.col("path").rlike("symbol=[A-M]")).select("file_id")


# ---- Aggregates ------------------------------------------------------------------------------------------------


@q("a01_phylum_edge", sql("select cast(phylum as bigint) as phylum, count(*) as n, round(avg(rf), 4) as mean, min(rf) as least, max(rf) as most from sigs where phylum is not null group by phylum having avg(rf) >= 8.0"))
def a01(spark, sf_dir):
    g = sigs(spark, sf_dir).filter("phylum is not null").groupBy(phylum().alias("phylum"))
    got = g.agg(F.count("*").alias("n"), F.avg("rf").alias("mean"), F.min("rf").alias("least"), F.max("rf").alias("most"))
    return got.filter("mean >= 8.0").withColumn("mean", r6("mean", 4))


def _distribution(df: DataFrame, c: str) -> DataFrame:
    median = one_row_quantiles(df, c, {"median": 0.5})
    base = df.agg(F.min(c).alias("least"), F.max(c).alias("most"), r6(F.avg(c)).alias("mean"), r6(F.stddev_samp(c)).alias("deviation"), F.count(c).alias("n"))
    return base.join(median.select(r6("median").alias("median")), F.lit(True))


_DIST = lambda c: f"min({c}) as least, max({c}) as most, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as deviation, count({c}) as n, round(quantile_cont({c}, 0.5), 6) as median"


@q("a02_conviction_distribution", sql(f"select {_DIST('conviction')} from sigs"))
def a02(spark, sf_dir):
    return _distribution(sigs(spark, sf_dir), "conviction")


@q("a03_veto_distribution", sql(f"select {_DIST('veto')} from sigs where quality >= 0.6"))
def a03(spark, sf_dir):
    return _distribution(sigs(spark, sf_dir).filter("quality >= 0.6"), "veto")


@q("a04_phylum_profile", sql("""select cast(phylum as bigint) as phylum, count(*) as n, round(avg(mfe), 6) as mean_mfe, round(avg(mae), 6) as mean_mae, round(quantile_cont(mfe, 0.5), 6) as median_mfe, round(quantile_cont(mae, 0.5), 6) as median_mae,
 max(mfe) as most_mfe, min(mae) as least_mae, round(avg(mfe) / nullif(avg(mae), 0), 4) as ratio from sigs where phylum is not null group by phylum"""))
def a04(spark, sf_dir):
    s = sigs(spark, sf_dir).filter("phylum is not null").withColumn("phylum", phylum())
    got = s.groupBy("phylum").agg(F.count("*").alias("n"), F.avg("mfe").alias("m"), F.avg("mae").alias("a"), F.max("mfe").alias("most_mfe"), F.min("mae").alias("least_mae"))
    mid = exact_quantiles(s, "phylum", {"mfe": F.col("mfe"), "mae": F.col("mae")}, [0.5]).groupBy(F.col("grp").alias("phylum")).agg(*[r6(F.max(F.when(F.col("q") == c, F.col("x")))).alias(f"median_{c}") for c in ("mfe", "mae")])
    got = got.join(mid, "phylum", "left")
    return got.select("phylum", "n", r6("m").alias("mean_mfe"), r6("a").alias("mean_mae"), "median_mfe", "median_mae", "most_mfe", "least_mae", r6(F.when(F.col("a") != 0, F.col("m") / F.col("a")), 4).alias("ratio"))


@q("a05_phylum_share", sql("select cast(phylum as bigint) as phylum, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 6) as share from sigs where phylum is not null group by phylum"))
def a05(spark, sf_dir):
    g = sigs(spark, sf_dir).filter("phylum is not null").groupBy(phylum().alias("phylum")).agg(F.count("*").alias("n"))
    return g.join(g.agg(F.sum("n").alias("t")), F.lit(True)).select("phylum", "n", r6(100.0 * F.col("n") / F.col("t")).alias("share"))


_SEVEN = [f"slot_{i:02d}" for i in range(7)]


@q("a06_phylum_slots", sql(f"select cast(phylum as bigint) as phylum, {', '.join(f'round(avg({s}), 6) as mean_{s}, round(stddev_samp({s}), 5) as dev_{s}' for s in _SEVEN)} from sigs where phylum is not null group by phylum"))
def a06(spark, sf_dir):
    g = sigs(spark, sf_dir).filter("phylum is not null").groupBy(phylum().alias("phylum"))
    return g.agg(*[x for s in _SEVEN for x in (r6(F.avg(s)).alias(f"mean_{s}"), r6(F.stddev_samp(s), 5).alias(f"dev_{s}"))])


@q("a07_quality_tiers", sql("select case when quality >= 0.9 then 'elite' when quality >= 0.8 then 'strong' when quality >= 0.7 then 'good' else 'base' end as tier, count(*) as n, round(avg(mfe), 6) as mfe, round(avg(mae), 6) as mae, round(avg(rf), 4) as rf from sigs where quality is not null group by 1"))
def a07(spark, sf_dir):
    tier = F.when(F.col("quality") >= 0.9, "elite").when(F.col("quality") >= 0.8, "strong").when(F.col("quality") >= 0.7, "good").otherwise("base")
    return sigs(spark, sf_dir).filter("quality is not null").groupBy(tier.alias("tier")).agg(F.count("*").alias("n"), r6(F.avg("mfe")).alias("mfe"), r6(F.avg("mae")).alias("mae"), r6(F.avg("rf"), 4).alias("rf"))


@q("a08_monthly", sql("select strftime(ts, '%Y-%m') as month, count(*) as n from sigs where ts is not null group by 1"))
def a08(spark, sf_dir):
    return sigs(spark, sf_dir).filter("ts is not null").groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


@q("a09_yearly", sql("select cast(extract(year from ts) as integer) as year, count(*) as n from sigs where ts is not null group by 1"))
def a09(spark, sf_dir):
    return sigs(spark, sf_dir).filter("ts is not null").groupBy(F.year("ts").alias("year")).agg(F.count("*").alias("n"))


@q("a10_span", sql("select symbol, epoch_us(min(ts)) as first_us, epoch_us(max(ts)) as last_us, count(*) as n, round(count(*) / greatest((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0, 1.0), 6) as per_day from sigs where ts is not null group by symbol"))
def a10(spark, sf_dir):
    g = sigs(spark, sf_dir).filter("ts is not null").groupBy("symbol").agg(us(F.min("ts")).alias("first_us"), us(F.max("ts")).alias("last_us"), F.count("*").alias("n"))
    return g.withColumn("per_day", r6(F.col("n") / F.greatest((F.col("last_us") - F.col("first_us")) / 86_400_000_000, F.lit(1.0))))


@q("a11_global", sql("select " + ", ".join(f"min({c}) as least_{c}, max({c}) as most_{c}, round(avg({c}), 4) as mean_{c}" for c in ("mfe", "mae", "rf")) + " from sigs"))
def a11(spark, sf_dir):
    return sigs(spark, sf_dir).agg(*[x for c in ("mfe", "mae", "rf") for x in (F.min(c).alias(f"least_{c}"), F.max(c).alias(f"most_{c}"), r6(F.avg(c), 4).alias(f"mean_{c}"))])


_PS = (0.5, 0.75, 0.9, 0.95, 0.99, 0.999)


@q("a12_percentiles", sql(" union all ".join(f"select '{c}' as measure, {p}::double as p, round(quantile_cont({c}, {p}), 5) as x from sigs" for c in ("mfe", "mae", "rf") for p in _PS)))
def a12(spark, sf_dir):
    got = exact_quantiles(sigs(spark, sf_dir), None, {c: F.col(c) for c in ("mfe", "mae", "rf")}, list(_PS))
    return got.select(F.col("q").alias("measure"), "p", r6("x", 5).alias("x"))


_GATES = (0.0, 0.5, 0.75, 0.9, 0.95, 0.99)


@q("a13_cutoffs", sql(" union all ".join(f"select {p}::double as gate, count(*) as n, round(avg(mfe), 6) as mfe, round(avg(mae), 6) as mae, round(avg(rf), 4) as rf, round(avg(case when mfe > mae then 1.0 else 0.0 end), 6) as wins from sigs where quality >= (select quantile_cont(quality, {p}) from sigs)" for p in _GATES)))
def a13(spark, sf_dir):
    """Outcomes of what lies above each quality percentile: one pass over all rows for all gates."""
    s = sigs(spark, sf_dir)
    edges = {round(r["p"], 4): r["x"] for r in exact_quantiles(s, None, {"quality": F.col("quality")}, list(_GATES)).collect()}
    gates = F.array(*[F.struct(F.lit(p).alias("gate"), F.lit(edges.get(p)).cast("double").alias("edge")) for p in _GATES])
    rows = s.select("quality", "mfe", "mae", "rf", F.explode(gates).alias("g")).filter("quality >= g.edge")
    return rows.groupBy("g.gate").agg(F.count("*").alias("n"), r6(F.avg("mfe")).alias("mfe"), r6(F.avg("mae")).alias("mae"), r6(F.avg("rf"), 4).alias("rf"), r6(F.avg(F.when(F.col("mfe") > F.col("mae"), 1.0).otherwise(0.0))).alias("wins"))


@q("a14_edge_metrics", sql("""select round(case when l > 0 then p / l when p > 0 then 999.0 else 0.0 end, 6) as gpf, round(m, 6) as recovery, n from (
 select coalesce(sum(greatest(mfe - mae, 0)), 0) as p, coalesce(sum(greatest(mae - mfe, 0)), 0) as l, quantile_cont(rf, 0.5) as m, count(*) as n from sigs where mfe is not null and mae is not null) t"""))
def a14(spark, sf_dir):
    """Gross profit over gross loss (999 without any loss), median recovery, count."""
    s = sigs(spark, sf_dir).filter("mfe is not null and mae is not null")
    g = s.agg(F.coalesce(F.sum(F.greatest(gain(), F.lit(0.0))), F.lit(0.0)).alias("p"), F.coalesce(F.sum(F.greatest(-gain(), F.lit(0.0))), F.lit(0.0)).alias("l"), F.count("*").alias("n"))
    g = g.join(one_row_quantiles(s, "rf", {"m": 0.5}), F.lit(True))
    return g.select(r6(F.when(F.col("l") > 0, F.col("p") / F.col("l")).when(F.col("p") > 0, 999.0).otherwise(0.0)).alias("gpf"), r6("m").alias("recovery"), "n")


@q("a15_crude_edge", sql("select symbol, round(sum(mfe) / nullif(sum(mae), 0), 6) as gpf, round(avg(rf), 4) as recovery from sigs group by symbol"))
def a15(spark, sf_dir):
    return sigs(spark, sf_dir).groupBy("symbol").agg(r6(F.when(F.sum("mae") != 0, F.sum("mfe") / F.sum("mae"))).alias("gpf"), r6(F.avg("rf"), 4).alias("recovery"))


_SLOTS16 = [f"slot_{i:02d}" for i in range(16)]


@q("a19_column_profile", no_minus_zero(" union all ".join(f"select '{c}' as name, count(*) filter ({c} is null) as nulls, count(*) filter ({c} is not null and not isfinite({c})) as not_finite, count(*) filter ({c} = 0) as zeros, round(avg(case when isfinite({c}) then cast({c} as double) end), 6) as mean, round(stddev_samp(case when isfinite({c}) then cast({c} as double) end), 6) as deviation, min(case when isfinite({c}) then cast({c} as double) end) as least, max(case when isfinite({c}) then cast({c} as double) end) as most from signatures" for c in _SLOTS16)))
def a19(spark, sf_dir):
    """Nulls, non-finite values, zeros and moments of every slot, in one pass."""
    t = table(spark, sf_dir, "signatures")
    cells = t.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("v")) for c in _SLOTS16])).alias("c")).select("c.name", "c.v")
    ok = F.when(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") != float("inf")), F.col("v").cast("double"))
    g = cells.groupBy("name").agg(F.count(F.when(F.col("v").isNull(), 1)).alias("nulls"), (F.count("v") - F.count(ok)).alias("not_finite"), F.count(F.when(F.col("v") == 0, 1)).alias("zeros"), r6(F.avg(ok)).alias("mean"), r6(F.stddev_samp(ok)).alias("deviation"), F.min(ok).alias("least"), F.max(ok).alias("most"))
    return g


_DESC = (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


@q("a20_describe", sql(" union all ".join(f"select '{c}' as name, {p}::double as p, count({c}) as n, round(quantile_cont({c}, {p}), 5) as x from sigs" for c in ("slot_16", "slot_17", "slot_18", "quality") for p in _DESC)))
def a20(spark, sf_dir):
    got = exact_quantiles(sigs(spark, sf_dir), None, {c: F.col(c) for c in ("slot_16", "slot_17", "slot_18", "quality")}, list(_DESC))
    return got.select(F.col("q").alias("name"), "p", "n", r6("x", 5).alias("x"))


# The audit's bounds of slots.
BOUNDS = {"slot_00": (-1, 1), "slot_03": (-5, 5), "slot_04": (0, 1), "slot_07": (-10, 10), "slot_12": (-5, 5), "slot_15": (0, 1), "slot_28": (-1, None), "slot_30": (0, 50), "slot_31": (0, 1)}


@q("a21_bound_violations", sql(" union all ".join(f"select '{s}' as name, count(*) filter ({s} < {lo}) as below, " + (f"count(*) filter ({s} > {hi})" if hi is not None else "cast(0 as bigint)") + f" as above, min({s}) as least, max({s}) as most from sigs" for s, (lo, hi) in BOUNDS.items())))
def a21(spark, sf_dir):
    limits = F.array(*[F.struct(F.lit(s).alias("name"), F.col(s).alias("v"), F.lit(float(lo)).alias("lo"), F.lit(None if hi is None else float(hi)).cast("double").alias("hi")) for s, (lo, hi) in BOUNDS.items()])
    cells = sigs(spark, sf_dir).select(F.explode(limits).alias("c")).select("c.*")
    return cells.groupBy("name").agg(F.count(F.when(F.col("v") < F.col("lo"), 1)).alias("below"), F.count(F.when(F.col("v") > F.col("hi"), 1)).alias("above"), F.min("v").alias("least"), F.max("v").alias("most"))


@q("a22_distinct", "select count(distinct data_hash) as hashes, count(data_hash) - count(distinct data_hash) as repeats, count(distinct symbol) as symbols from signatures")
def a22(spark, sf_dir):
    return table(spark, sf_dir, "signatures").agg(F.count_distinct("data_hash").alias("hashes"), (F.count("data_hash") - F.count_distinct("data_hash")).alias("repeats"), F.count_distinct("symbol").alias("symbols"))


_PAIRS = [(a, b) for i, a in enumerate(_SLOTS16) for b in _SLOTS16[i + 1 :]]


@q("a23_correlations", sql("select * from (" + " union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as r from sigs" for a, b in _PAIRS) + ") t order by abs(r) desc, a, b limit 12"))
def a23(spark, sf_dir):
    """The 12 strongest of all slot correlations."""
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in _PAIRS])).alias("c")
    long = sigs(spark, sf_dir).select(pairs).select("c.*").groupBy("a", "b").agg(r6(W.corr(F.col("x"), F.col("y"))).alias("r"))
    return long.orderBy(F.abs("r").desc(), "a", "b").limit(12)


@q("a24_reconciliation", "select f.file_id, coalesce(f.n_rows, -1) as listed, coalesce(s.n, 0) as stored from signature_files f left join (select file_id, count(*) as n from signatures group by file_id) s on s.file_id = f.file_id where coalesce(f.n_rows, -1) <> coalesce(s.n, 0)")
def a24(spark, sf_dir):
    """Files whose listed row count (-1: none) isn't what is stored of them."""
    n = table(spark, sf_dir, "signatures").groupBy("file_id").agg(F.count("*").alias("n"))
    f = table(spark, sf_dir, "signature_files").join(n, "file_id", "left").withColumn("stored", F.coalesce("n", F.lit(0)))
    return f.withColumn("listed", F.coalesce("n_rows", F.lit(-1))).filter("listed <> stored").select("file_id", "listed", "stored")


_GATE_SQL = {"rows": "count(*) >= 1000", "slots_present": "count(*) filter (slot_15 is null) <= 0.01 * count(*)", "veto_in_bounds": "coalesce(min(veto) >= 0 and max(veto) <= 1, false)", "varied": "coalesce(stddev_samp(veto) > 0.001, false)", "hashes": "count(data_hash) >= 0.9 * count(*)", "embedded": "count(*) filter (slot_16 <> 0) >= 0.5 * count(*)"}


@q("a25_gates", sql(" union all ".join(f"select '{k}' as gate, {v} as passed from sigs" for k, v in _GATE_SQL.items())))
def a25(spark, sf_dir):
    n = F.count("*")
    checks = {
        "rows": n >= 1000,
        "slots_present": F.count(F.when(F.col("slot_15").isNull(), 1)) <= 0.01 * n,
        "veto_in_bounds": F.coalesce((F.min("veto") >= 0) & (F.max("veto") <= 1), F.lit(False)),
        "varied": F.coalesce(F.stddev_samp("veto") > 0.001, F.lit(False)),
        "hashes": F.count("data_hash") >= 0.9 * n,
        "embedded": F.count(F.when(F.col("slot_16") != 0, 1)) >= 0.5 * n,
    }
    one = sigs(spark, sf_dir).agg(*[c.alias(k) for k, c in checks.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("gate"), F.col(k).alias("passed")) for k in checks])).alias("g")).select("g.*")


_EMB = [f"slot_{i}" for i in range(16, 24)]


@q("a26_zero_embeddings", sql(f"select symbol, count(*) filter ({' and '.join(f'{s} = 0' for s in _EMB)}) as zero, count(*) filter ({' or '.join(f'{s} <> 0' for s in _EMB)}) as live from sigs group by symbol"))
def a26(spark, sf_dir):
    zero = reduce(lambda a, b: a & b, [F.col(s) == 0 for s in _EMB])
    live = reduce(lambda a, b: a | b, [F.col(s) != 0 for s in _EMB])
    return sigs(spark, sf_dir).groupBy("symbol").agg(F.count(F.when(zero, 1)).alias("zero"), F.count(F.when(live, 1)).alias("live"))


_FORMULA = "greatest(veto, (veto + conviction) / 2)"


@q("a27_formula_deviation", sql(f"select round(max(abs(quality - {_FORMULA})), 6) as worst, round(avg(case when abs(quality - {_FORMULA}) < 0.00001 then 100.0 else 0.0 end), 6) as exact_share from sigs where quality is not null and veto is not null and conviction is not null"))
def a27(spark, sf_dir):
    s = sigs(spark, sf_dir).dropna(subset=["quality", "veto", "conviction"])
    d = F.abs(F.col("quality") - F.greatest(F.col("veto"), (F.col("veto") + F.col("conviction")) / 2))
    return s.agg(r6(F.max(d)).alias("worst"), r6(F.avg(F.when(d < 0.00001, 100.0).otherwise(0.0))).alias("exact_share"))


@q("a28_two_groups", sql("select *, round(high_mean / nullif(low_mean, 0) - 1, 6) as lift from (select count(*) filter (veto < 0.65) as low_n, count(*) filter (veto >= 0.65) as high_n, max(case when veto < 0.65 then mfe end) as low_max, max(case when veto >= 0.65 then mfe end) as high_max, round(avg(case when veto < 0.65 then mfe end), 7) as low_mean, round(avg(case when veto >= 0.65 then mfe end), 7) as high_mean from sigs) t"))
def a28(spark, sf_dir):
    low, high = F.col("veto") < 0.65, F.col("veto") >= 0.65
    one = sigs(spark, sf_dir).agg(F.count(F.when(low, 1)).alias("low_n"), F.count(F.when(high, 1)).alias("high_n"), F.max(F.when(low, F.col("mfe"))).alias("low_max"), F.max(F.when(high, F.col("mfe"))).alias("high_max"), r6(F.avg(F.when(low, F.col("mfe"))), 7).alias("low_mean"), r6(F.avg(F.when(high, F.col("mfe"))), 7).alias("high_mean"))
    return one.withColumn("lift", r6(F.when(F.col("low_mean") != 0, F.col("high_mean") / F.col("low_mean") - 1)))


@q("a31_shares", sql("select symbol, round(avg(case when slot_00 < 0 then 1.0 else 0.0 end), 6) as short_share, round(avg(case when phylum <> -1 then 1.0 else 0.0 end), 6) as clustered_share, count(distinct case when phylum > 0 then phylum end) as phyla from sigs group by symbol"))
def a31(spark, sf_dir):
    return sigs(spark, sf_dir).groupBy("symbol").agg(r6(F.avg(F.when(F.col("slot_00") < 0, 1.0).otherwise(0.0))).alias("short_share"), r6(F.avg(F.when(F.col("phylum") != -1, 1.0).otherwise(0.0))).alias("clustered_share"), F.count_distinct(F.when(F.col("phylum") > 0, F.col("phylum"))).alias("phyla"))


_ALL = ["timestamp", "symbol", "interval", "year", "month", *_SLOTS16, "neural_conviction", "slot_28", "slot_31", "mfe", "mae", "recovery_factor", "data_hash"]


@q("a32_null_totals", " union all ".join(f"select '{c}' as name, count(*) filter (\"{c}\" is null) as nulls from signatures" for c in _ALL))
def a32(spark, sf_dir):
    one = table(spark, sf_dir, "signatures").agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in _ALL])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("nulls")) for c in _ALL])).alias("c")).select("c.*")


@q("a33_non_positive", "select symbol, count(*) filter (\"open\" <= 0) as opens, count(*) filter (\"high\" <= 0) as highs, count(*) filter (\"low\" <= 0) as lows, count(*) filter (\"close\" <= 0) as closes from ohlcv group by symbol")
def a33(spark, sf_dir):
    return table(spark, sf_dir, "ohlcv").groupBy("symbol").agg(*[F.count(F.when(F.col(c) <= 0, 1)).alias(f"{c}s") for c in ("open", "high", "low", "close")])


@q("a34_progress", "select symbol, count(*) as shards, count(*) filter (status = 'done') as done, round(100.0 * count(*) filter (status = 'done') / count(*), 6) as percent, sum(epoch(shard_end) - epoch(shard_start)) filter (status is distinct from 'done') as seconds_left from mining_shards group by symbol")
def a34(spark, sf_dir):
    done = F.col("status").eqNullSafe("done")
    length = F.unix_timestamp(F.col("shard_end").cast("timestamp")) - F.unix_timestamp(F.col("shard_start").cast("timestamp"))
    return table(spark, sf_dir, "mining_shards").groupBy("symbol").agg(F.count("*").alias("shards"), F.count(F.when(done, 1)).alias("done"), r6(100.0 * F.count(F.when(done, 1)) / F.count("*")).alias("percent"), F.sum(F.when(~done, length)).cast("double").alias("seconds_left"))


# ---- Order -----------------------------------------------------------------------------------------------------


@q("o02_top_quality", sql("select sig_id, quality from sigs where quality is not null order by quality desc, sig_id limit 5"))
def o02(spark, sf_dir):
    return sigs(spark, sf_dir).filter("quality is not null").orderBy(F.desc("quality"), "sig_id").limit(5).select("sig_id", "quality")


@q("o03_top_recovery", sql("select sig_id, rf from sigs where mae > 0.0001 and mfe > 0 and rf is not null order by rf desc, sig_id limit 10"))
def o03(spark, sf_dir):
    return sigs(spark, sf_dir).filter("mae > 0.0001 and mfe > 0 and rf is not null").orderBy(F.desc("rf"), "sig_id").limit(10).select("sig_id", "rf")


@q("o04_best_per_day", sql("select strftime(ts, '%Y-%m-%d') as day, sig_id from (select *, row_number() over (partition by cast(ts as date) order by quality desc, sig_id) as k from sigs where ts is not null and quality is not null) t where k = 1"))
def o04(spark, sf_dir):
    s = sigs(spark, sf_dir).filter("ts is not null and quality is not null")
    return s.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.max_by("sig_id", F.struct("quality", -F.col("sig_id"))).alias("sig_id"))


@q("o05_extremes", sql("select (select sig_id from sigs where mfe is not null order by mfe desc, sig_id limit 1) as best, (select sig_id from sigs where mae is not null order by mae desc, sig_id limit 1) as worst, (select sig_id from sigs where quality is not null order by quality, sig_id limit 1) as weakest"))
def o05(spark, sf_dir):
    top = lambda c: F.max_by("sig_id", F.when(F.col(c).isNotNull(), F.struct(c, -F.col("sig_id"))))
    low = F.min_by("sig_id", F.when(F.col("quality").isNotNull(), F.struct("quality", "sig_id")))
    return sigs(spark, sf_dir).agg(top("mfe").alias("best"), top("mae").alias("worst"), low.alias("weakest"))


@q("o06_composite_rank", sql("""select sig_id, round(0.4 * (quality - q0) / (q1 - q0) + 0.3 * (mfe - m0) / (m1 - m0) + 0.3 * (least(rf, r9) - r0) / (least(r1, r9) - r0), 6) as score from sigs,
 (select min(quality) as q0, max(quality) as q1, min(mfe) as m0, max(mfe) as m1, min(rf) as r0, max(rf) as r1, quantile_cont(rf, 0.99) as r9 from sigs where quality is not null and mfe is not null and rf is not null) e
 where quality is not null and mfe is not null and rf is not null order by score desc, sig_id limit 10"""))
def o06(spark, sf_dir):
    s = sigs(spark, sf_dir).dropna(subset=["quality", "mfe", "rf"])
    e = s.agg(*[x for c in ("quality", "mfe", "rf") for x in (F.min(c).alias(f"{c}0"), F.max(c).alias(f"{c}1"))]).join(one_row_quantiles(s, "rf", {"r9": 0.99}), F.lit(True)).first()
    if e is None or e["quality0"] is None:
        return s.select("sig_id", F.lit(None).cast("double").alias("score")).limit(0)
    scaled = lambda x, a, z: (x - a) / (z - a) if z > a else F.lit(0.0)
    score = 0.4 * scaled(F.col("quality"), e["quality0"], e["quality1"]) + 0.3 * scaled(F.col("mfe"), e["mfe0"], e["mfe1"]) + 0.3 * scaled(F.least("rf", F.lit(e["r9"])), e["rf0"], min(e["rf1"], e["r9"]))
    return s.select("sig_id", r6(score).alias("score")).orderBy(F.desc("score"), "sig_id").limit(10)


@q("o07_value_counts", sql("select round(slot_08, 2) as value, count(*) as n from sigs where slot_08 is not null group by 1 order by n desc, value limit 20"))
def o07(spark, sf_dir):
    g = sigs(spark, sf_dir).filter("slot_08 is not null").groupBy(r6("slot_08", 2).alias("value")).agg(F.count("*").alias("n"))
    return g.orderBy(F.desc("n"), "value").limit(20)


# ---- Sets ------------------------------------------------------------------------------------------------------


@q("u01_union_all", 'select symbol, "interval" as iv, epoch_us(datetime) as ts_us from ohlcv where datetime is not null union all select symbol, null as iv, epoch_us(datetime) as ts_us from funding where datetime is not null')
def u01(spark, sf_dir):
    a = table(spark, sf_dir, "ohlcv").filter("datetime is not null").select("symbol", F.col("interval").alias("iv"), us("datetime").alias("ts_us"))
    b = table(spark, sf_dir, "funding").filter("datetime is not null").select("symbol", us("datetime").alias("ts_us"))
    return a.unionByName(b, allowMissingColumns=True)


@q("u02_keep_one", sql("select sig_id from us", _US))
def u02(spark, sf_dir):
    return unique_sigs(spark, sf_dir).select("sig_id")


@q("u03_distinct_lists", sql("select symbol, count(distinct strftime(ts, '%m')) as months, min(strftime(ts, '%m')) as first_month from sigs where ts is not null group by symbol"))
def u03(spark, sf_dir):
    g = sigs(spark, sf_dir).filter("ts is not null").groupBy("symbol").agg(F.array_sort(F.collect_set(F.date_format("ts", "MM"))).alias("m"))
    return g.select("symbol", F.size("m").cast("long").alias("months"), F.element_at("m", 1).alias("first_month"))


@q("u04_month_difference", sql("select distinct symbol, strftime(ts, '%Y-%m') as month from bars except select symbol, strftime(ts, '%Y-%m') from sigs where quality >= 0.95"))
def u04(spark, sf_dir):
    a = bars(spark, sf_dir).select("symbol", F.date_format("ts", "yyyy-MM").alias("month"))
    return a.distinct().subtract(sigs(spark, sf_dir).filter("quality >= 0.95").select("symbol", F.date_format("ts", "yyyy-MM").alias("month")))


@q("j08_missing_months", sql("select e.symbol, e.month from (select distinct symbol, strftime(ts, '%Y-%m') as month from bars) e left join (select distinct symbol, strftime(ts, '%Y-%m') as month from sigs where ts is not null) p on p.symbol = e.symbol and p.month = e.month where p.month is null"))
def j08(spark, sf_dir):
    """Months of a symbol with bars but without signatures."""
    e = bars(spark, sf_dir).select("symbol", F.date_format("ts", "yyyy-MM").alias("month")).distinct()
    return e.join(sigs(spark, sf_dir).filter("ts is not null").select("symbol", F.date_format("ts", "yyyy-MM").alias("month")).distinct(), ["symbol", "month"], "left_anti")
