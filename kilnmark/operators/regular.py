"""Problem 6: irregular readings onto a regular grid.

A reading is valid from its instant until the next reading of its source, at most `hold` grid steps: a step function.
These validity intervals are cut at grid borders, which gives per grid slot the time-weighted average of the value and
the fraction of the slot that is covered. Sources are cut into stretches of time, each with the readings just beyond
its ends, so that a source with a third of the rows spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.instants import interval_seconds
from .spikes import usable

STRETCH = 2_048  # grid steps of one stretch
SECOND = 1_000_000


def grid_slots(ranges: DataFrame) -> DataFrame:
    """source, step (seconds), slot (Unix seconds of the slot start): every slot that lies in at least one range, once.

    ranges: source, interval, start, stop (half-open). Overlapping ranges give a slot once; empty or reversed ranges
    and rows with null bounds or an unreadable interval give none. Ranges are cut into stretches first, so that a
    long range isn't one task's work."""
    step = interval_seconds(F.col("interval"))
    r = ranges.select("source", step.alias("step"), F.unix_micros(F.col("start").cast("timestamp")).alias("a"), F.unix_micros(F.col("stop").cast("timestamp")).alias("z"))
    r = r.filter("step is not null and a < z and source is not null")
    r = r.select("source", "step", F.expr(f"(a + step * {SECOND} - 1) div (step * {SECOND})").alias("i"), F.expr(f"(z - step * {SECOND}) div (step * {SECOND})").alias("j")).filter("i <= j")
    # Overlaps are merged on the stretches that they touch, before any slot is made.
    parts = r.withColumn("stretch", F.explode(F.sequence(F.expr(f"i div {STRETCH}"), F.expr(f"j div {STRETCH}"))))
    parts = parts.select("source", "step", "stretch", F.greatest("i", F.col("stretch") * STRETCH).alias("i"), F.least("j", F.col("stretch") * STRETCH + STRETCH - 1).alias("j")).distinct()
    w = Window.partitionBy("source", "step", "stretch").orderBy("i", "j").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("from", F.greatest("i", F.coalesce(F.max("j").over(w) + 1, F.col("i")))).filter("from <= j")
    return parts.select("source", "step", "stretch", F.explode(F.sequence("from", "j")).alias("cell")).select("source", "step", "stretch", (F.col("cell") * F.col("step")).alias("slot"))


def readings_in_cells(readings: DataFrame, sources: DataFrame, hold: int) -> DataFrame:
    """Per source, step and slot: the time-weighted mean of the value and what share of the slot it covers.

    readings: source, at (timestamp), value (double, null: unusable), amount (double or null), version (orderable),
    one row per delivered reading. Of several usable readings at one instant the highest version counts. Returns
    source, step, slot, mean, covered, fresh (share covered by readings that began in the slot or less than one step
    before its moment), amount (sum over readings that began in the slot), started (their number)."""
    r = readings.filter("value is not null and at is not null").join(sources, "source")
    r = r.withColumn("t", F.unix_micros(F.col("at").cast("timestamp"))).withColumn("us", F.col("step") * SECOND)
    r = r.withColumn("home", F.expr(f"floor(t / (us * {STRETCH}))").cast("long"))
    # A reading is also shown to the stretch before, where it ends what is valid, and to the next, into which it holds.
    near = F.array_distinct(F.array(F.col("home"), F.expr(f"floor((t - us * {hold}) / (us * {STRETCH}))").cast("long"), F.expr(f"floor((t + us * {hold}) / (us * {STRETCH}))").cast("long")))
    r = r.select("source", "step", "us", "t", "value", "amount", "version", F.explode(near).alias("stretch"))
    r = r.groupBy("source", "step", "us", "stretch", "t").agg(F.max_by(F.struct("value", "amount"), "version").alias("v"))
    w = Window.partitionBy("source", "step", "stretch").orderBy("t")
    r = r.withColumn("until", F.least(F.coalesce(F.lead("t").over(w), F.col("t") + F.col("us") * hold), F.col("t") + F.col("us") * hold))
    first, last = F.expr("floor(t / us)"), F.expr("floor((until - 1) / us)")
    cells = r.withColumn("cell", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    cells = cells.filter(F.expr(f"floor(cell / {STRETCH})") == F.col("stretch"))
    lo, hi = F.greatest(F.col("t"), F.col("cell") * F.col("us")), F.least(F.col("until"), (F.col("cell") + 1) * F.col("us"))
    share = (hi - lo) / F.col("us")
    new = F.greatest(F.lit(0.0), (F.least(hi, F.col("t") + F.col("us")) - lo) / F.col("us"))
    here = F.expr("floor(t / us)") == F.col("cell")
    return cells.groupBy("source", "step", "stretch", (F.col("cell") * F.col("step")).alias("slot")).agg(
        (F.sum(share * F.col("v.value")) / F.sum(share)).alias("mean"),
        F.sum(share).alias("covered"),
        F.sum(new).alias("fresh"),
        F.sum(F.when(here, F.col("v.amount"))).alias("amount"),
        F.sum(here.cast("long")).alias("started"),
    )


def regular_bars(ohlcv: DataFrame, shards: DataFrame, hold: int = 3) -> DataFrame:
    """One row per symbol and grid slot within its shards: symbol, slot_epoch, close, volume, coverage, state.

    close is the time-weighted average of the usable closes valid in the slot, volume the sum of the volumes of the
    bars that began in it, coverage the share of the slot covered by valid closes. state: 'observed' if a usable bar
    began in the slot, 'filled' if only an earlier one still holds (for at most `hold` steps), 'missing' otherwise,
    with null close and volume. Unusable closes (null, non-finite, not above 0) and null datetimes don't count; of bars
    delivered again for the same instant the last received counts; non-finite or negative volumes count as null; a
    symbol without bars comes out with all slots missing, bars outside all shards don't come out, empty tables give
    an empty result; extra columns are ignored."""
    slots = grid_slots(shards.select(F.col("symbol").alias("source"), "interval", F.col("shard_start").alias("start"), F.col("shard_end").alias("stop")))
    sources = shards.select(F.col("symbol").alias("source"), interval_seconds(F.col("interval")).alias("step")).filter("step is not null").distinct()
    volume: Column = F.when((F.col("volume") >= 0) & ~F.isnan("volume") & (F.col("volume") != float("inf")), F.col("volume"))
    readings = ohlcv.select(F.col("symbol").alias("source"), F.col("datetime").alias("at"), F.when(usable("close"), F.col("close")).alias("value"), volume.alias("amount"), F.struct("received_at", "bar_id").alias("version"))
    cells = readings_in_cells(readings, sources, hold)
    got = slots.join(cells, ["source", "step", "stretch", "slot"], "left")
    state = F.when(F.col("started") > 0, "observed").when(F.col("covered") > 0, "filled").otherwise("missing")
    return got.select(F.col("source").alias("symbol"), F.col("slot").alias("slot_epoch"), F.col("mean").alias("close"), F.col("amount").alias("volume"), F.coalesce("covered", F.lit(0.0)).alias("coverage"), state.alias("state"))


def missing_slots(ohlcv: DataFrame, shards: DataFrame) -> DataFrame:
    """symbol, slot_epoch of the slots in which no usable bar began."""
    return regular_bars(ohlcv, shards).filter("state <> 'observed'").select("symbol", "slot_epoch")
