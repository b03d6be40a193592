"""Time expressions; the present is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units of relative time and their seconds, largest first.
UNITS = (("year", 31_536_000), ("month", 2_592_000), ("day", 86_400), ("hour", 3_600), ("minute", 60))
RANGES = {"24h": 1, "7d": 7, "30d": 30}


def hours_between(a: Column, b: Column) -> Column:
    """Absolute difference in hours with its fraction."""
    return F.abs(F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / 3.6e9


def ago(as_of: Column, days: float = 0, hours: float = 0) -> Column:
    return as_of - F.make_dt_interval(F.lit(int(days)), F.lit(int(hours)), F.lit(0), F.lit(0))


def range_start(name: str, as_of: Column) -> Column | None:
    """The start of 24h, 7d or 30d before as_of; None for all time."""
    return ago(as_of, days=RANGES[name]) if name in RANGES else None


def relative(ts: Column, as_of: Column) -> Column:
    """struct(amount, unit): the rounded difference in the largest unit that it fills, minutes at least."""
    seconds = (F.unix_micros(ts.cast("timestamp")) - F.unix_micros(as_of.cast("timestamp"))) / 1e6
    pick, amount = None, None
    for name, size in UNITS:
        rounded = F.floor(seconds / size + 0.5).cast("long")  # halves go up, as on a number line
        fits = F.abs(seconds) >= size
        pick = F.when(fits, name) if pick is None else pick.when(fits, name)
        amount = F.when(fits, rounded) if amount is None else amount.when(fits, rounded)
    return F.struct(amount.otherwise(F.floor(seconds / 60 + 0.5).cast("long")).alias("amount"), pick.otherwise("minute").alias("unit"))
