"""Date and time expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The timestamp layouts found in station files.
TIMESTAMP_FORMATS = ["M/d/yyyy H:mm", "M/d/yyyy H:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm"]
_EPOCH = "1970-01-01 00:00:00"
# The warm season runs from June to September.
WARM_MONTHS = (6, 9)


def parse_timestamp(c: Column) -> Column:
    """First layout that reads the text; NULL if none does."""
    text = F.concat(F.trim(c), F.lit(" +00:00"))
    tries = [F.try_to_timestamp(text, F.lit(f"{f} XXX")) for f in TIMESTAMP_FORMATS]
    return from_utc(F.coalesce(*tries))


def as_utc(ts: Column) -> Column:
    """A zone-less time as the instant it names in UTC, whatever the session zone is."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit(_EPOCH).cast("timestamp_ntz"), ts))


def from_utc(ts: Column) -> Column:
    return F.timestamp_add("MICROSECOND", F.unix_micros(ts), F.lit(_EPOCH).cast("timestamp_ntz"))


def is_full_hour(ts: Column) -> Column:
    return (F.minute(ts) == 0) & (F.second(ts) == 0)


def nearest_hour(ts: Column) -> Column:
    return F.date_trunc("hour", ts + F.expr("INTERVAL 30 MINUTES")).cast("timestamp_ntz")


def floor_time(ts: Column, freq: str) -> Column:
    return F.window(ts, freq).start


def hours_between(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", earlier, later) / 3.6e9


def month_start(d: Column) -> Column:
    return F.trunc(d, "month")


def is_warm(d: Column) -> Column:
    return F.month(d).between(*WARM_MONTHS)


def day_angle(d: Column) -> Column:
    return F.lit(2 * math.pi) * F.dayofyear(d) / F.lit(365.25)


def month_angle(d: Column) -> Column:
    return F.lit(2 * math.pi) * F.month(d) / F.lit(12.0)


def clipped_doy(d: Column) -> Column:
    return F.least(F.dayofyear(d), F.lit(365))


def week_end(d: Column) -> Column:
    """The Sunday that ends the week of ``d``."""
    return F.next_day(F.date_sub(d, 1), "Sun")


def days_in_year(year: Column) -> Column:
    """Every fourth year is a leap year."""
    return F.when(year % 4 == 0, 366).otherwise(365)
