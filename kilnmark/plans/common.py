"""Tables as the reference-style queries read them, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.instants import instant
from ..operators.bars import clean_bars
from ..session import table

SLOTS = [f"slot_{i:02d}" for i in range(32)]
MEASURES = {"phylum": "slot_28", "quality": "slot_31", "veto": "slot_15", "conviction": "neural_conviction", "threshold": "conviction_threshold", "mfe": "mfe", "mae": "mae", "rf": "recovery_factor"}


def fine(c: str) -> Column:
    """c as a double, null where it isn't finite."""
    return F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c).cast("double"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_bars(table(spark, sf_dir, "ohlcv"))


def sigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures with ts (instant) and finite doubles under short names, and all slots as slot_NN."""
    t = table(spark, sf_dir, "signatures")
    return t.select("sig_id", "symbol", F.col("interval").alias("iv"), instant(F.col("timestamp")).alias("ts"), F.col("signature_flag").alias("flag"), "data_hash", "config_hash", "git_commit", "file_id", "ingested_at", *[fine(c).alias(k) for k, c in MEASURES.items()], *[fine(s).alias(s) for s in SLOTS])


def us(c: str | Column) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp") if isinstance(c, str) else c)


def r6(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + 0.0


_USABLE = lambda c: f"coalesce(isfinite({c}) and {c} > 0, false)"
BARS = f"""bars as (
  select symbol, iv, ts, epoch_us(ts) as ts_us, o as "open", case when {_USABLE('h')} then h else greatest(o, c) end as "high", case when {_USABLE('l')} then l else least(o, c) end as "low", c as "close",
    case when coalesce(isfinite(volume) and volume >= 0, false) then volume else 0.0 end as volume
  from (select symbol, "interval" as iv, datetime as ts, case when {_USABLE('"open"')} then "open" else "close" end as o, "high" as h, "low" as l, "close" as c, volume,
      row_number() over (partition by symbol, datetime order by received_at desc, bar_id desc) as rn
    from ohlcv where datetime is not null and symbol is not null and {_USABLE('"close"')}) t where rn = 1)"""

INSTANT = """case when regexp_matches(trim("timestamp"), '^-?[0-9]{9,15}$') then make_timestamp(cast(trim("timestamp") as bigint) * 1000)
 when regexp_matches(trim("timestamp"), '[+-][0-9][0-9]:[0-9][0-9]$') then try_cast(substr(trim("timestamp"), 1, length(trim("timestamp")) - 6) as timestamp)
  - to_minutes(cast(substr(trim("timestamp"), length(trim("timestamp")) - 5, 1) || '1' as bigint) * (60 * cast(substr(trim("timestamp"), length(trim("timestamp")) - 4, 2) as bigint) + cast(substr(trim("timestamp"), length(trim("timestamp")) - 1, 2) as bigint)))
 else try_cast(replace(trim("timestamp"), 'Z', '') as timestamp) end"""
_FINE = lambda c: f"case when isfinite({c}) then cast({c} as double) end"
SIGS = f"""sigs as (select sig_id, symbol, "interval" as iv, {INSTANT} as ts, signature_flag as flag, data_hash, config_hash, git_commit, file_id, ingested_at,
  {', '.join(f'{_FINE(c)} as {k}' for k, c in MEASURES.items())}, {', '.join(f'{_FINE(s)} as {s}' for s in SLOTS)} from signatures)"""


def no_minus_zero(text: str) -> str:
    """text with 0.0 added to every round(...), which one engine leaves at -0.0."""
    out, at = [], 0
    while (i := text.find("round(", at)) >= 0:
        depth, j = 0, i + 5
        while True:
            depth += {"(": 1, ")": -1}.get(text[j], 0)
            if not depth:
                break
            j += 1
        out.append(text[at:i] + "(" + "round(" + no_minus_zero(text[i + 6 : j]) + ") + 0.0)")
        at = j + 1
    return "".join(out) + text[at:]


def sql(body: str, *more: str) -> str:
    """A query over the tables bars and sigs; more: further common tables."""
    return no_minus_zero("with " + ", ".join([BARS, SIGS, *more]) + "\n" + body)


class Registry:
    """Queries by name, with the SQL that gives the same rows."""

    def __init__(self):
        self.queries, self.sql = {}, {}

    def __call__(self, name: str, text: str | None = None):
        def add(f):
            self.queries[name] = f
            if text:
                self.sql[name] = text
            return f

        return add
