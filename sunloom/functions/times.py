"""Time functions. Session time zone is UTC; times count in microseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR, DAY = 3_600_000_000, 86_400_000_000


def micros(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp"))


def at_micros(n: Column) -> Column:
    return F.timestamp_micros(n).cast("timestamp_ntz")


def hours_between(a: Column, b: Column) -> Column:
    """b - a in hours."""
    return (micros(b) - micros(a)) / HOUR


def julian_date(t: Column) -> Column:
    """Days since noon of the first day of the Julian period."""
    return micros(t) / DAY + 2440587.5


def round_hours(t: Column, n: int) -> Column:
    """t to the nearest multiple of n hours of its day, half up; the last one rolls to the next day (M9)."""
    day = F.floor(micros(t) / DAY) * DAY
    steps = F.floor((micros(t) - day) / (n * HOUR) + 0.5)
    return at_micros((day + F.least(steps * (n * HOUR), F.lit(DAY))).cast("long"))


def round_day(t: Column) -> Column:
    """t to the nearest midnight, half up (M9)."""
    return at_micros((F.floor(micros(t) / DAY + 0.5) * DAY).cast("long"))


def rotation_relative(cr_earth: Column, lon: Column) -> Column:
    """Decimal rotation number of an observer at Carrington longitude lon, the one nearest to Earth's.

    Longitude falls by 360 in a rotation, so the number is -lon / 360 but for whole turns; of two as near, the greater.
    """
    part = -lon / 360
    return part + F.floor(cr_earth - part + 0.5)


#: First second of 1958-based atomic time from which so many leap seconds have passed.
LEAP_SECONDS = (
    (1972, 1, 10), (1972, 7, 11), (1973, 1, 12), (1974, 1, 13), (1975, 1, 14), (1976, 1, 15), (1977, 1, 16),
    (1978, 1, 17), (1979, 1, 18), (1980, 1, 19), (1981, 7, 20), (1982, 7, 21), (1983, 7, 22), (1985, 7, 23),
    (1988, 1, 24), (1990, 1, 25), (1991, 1, 26), (1992, 7, 27), (1993, 7, 28), (1994, 7, 29), (1996, 1, 30),
    (1997, 7, 31), (1999, 1, 32), (2006, 1, 33), (2009, 1, 34), (2012, 7, 35), (2015, 7, 36), (2017, 1, 37),
)


def utc_of_atomic(seconds: Column) -> Column:
    """UTC time of atomic seconds since 1958; before 1972 the first offset holds."""
    from datetime import datetime

    epoch = datetime(1958, 1, 1)
    offset = F.lit(10)
    for year, month, n in LEAP_SECONDS[1:]:
        start = (datetime(year, month, 1) - epoch).total_seconds() + n
        offset = F.when(seconds >= start, n).otherwise(offset)
    base = int((epoch - datetime(1970, 1, 1)).total_seconds())
    return at_micros(F.round((seconds - offset + base) * 1_000_000).cast("long"))


def path_of_time(text: Column) -> Column:
    """An index path without dashes and colons, with `_` for `T`."""
    return F.translate(F.regexp_replace(text, "[-:]", ""), "T", "_")
