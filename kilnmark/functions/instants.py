"""Reading instants and partition values that are spelled in several ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds of a bar by the spelling of its interval's unit.
UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def instant(text: Column) -> Column:
    """The timestamp that text spells: ISO date and time with or without offset (none: UTC), or epoch milliseconds.

    Null, blank and unreadable text give null. Independent of the session's time zone."""
    t = F.trim(text)
    iso = F.when(t.rlike(r"(?i)(Z|UTC|[+-]\d\d:?\d\d|[+-]\d\d)$") & t.contains(":"), t).otherwise(F.concat(t, F.lit("Z")))
    iso = F.when(t.rlike(r"^\d{4}-\d\d-\d\d$"), F.concat(t, F.lit(" 00:00:00Z"))).otherwise(iso)
    return F.when(t.rlike(r"^-?\d{9,15}$"), F.timestamp_millis(t.try_cast("long"))).otherwise(iso.try_cast("timestamp"))


def interval_seconds(interval: Column) -> Column:
    """Seconds of '5m', '1h', '1d'; null for anything else."""
    n = F.regexp_extract(interval, r"^(\d{1,6})([smhdw])$", 1)
    unit = F.regexp_extract(interval, r"^(\d{1,6})([smhdw])$", 2)
    scale = F.create_map(*[F.lit(x) for kv in UNIT_SECONDS.items() for x in kv])
    return F.when(n != "", n.try_cast("long") * F.try_element_at(scale, unit))
