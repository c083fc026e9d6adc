"""Times: GPS seconds, rounding to half hours and ticks, names of files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegrid.functions.basic import col

GPS_EPOCH = 315964800  # 1980-01-06 in POSIX seconds
ADJUSTED = 1_000_000_000  # what adjusted GPS time leaves out


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone, the latter taken as UTC."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")


def at_micros(us: Column) -> Column:
    """The timestamp without zone at these microseconds."""
    return F.timestamp_add("MICROSECOND", us, F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))


def gps_micros(seconds: str | Column, first: str | Column, leap_s: float = 0.0) -> Column:
    """UTC microseconds of GPS seconds; a scan whose first stamp is below 1e9 holds adjusted time."""
    s = col(seconds) + F.when(col(first) < ADJUSTED, F.lit(float(ADJUSTED))).otherwise(F.lit(0.0))
    return F.round((s + (GPS_EPOCH - leap_s)) * 1e6).cast("long")


def tick(seconds: Column, step: float, base: int = 0) -> Column:
    """Number of the step nearest to an elapsed time."""
    return F.round(seconds / F.lit(float(step))).cast("long") + F.lit(base)


def nearest(us: Column, step_us: int) -> Column:
    """Microseconds rounded to a step, half up."""
    return (F.floor((us + step_us // 2) / F.lit(step_us)) * F.lit(step_us)).cast("long")


def half_hour(ts: str) -> Column:
    """The nearest half hour: :15:00 gives :30, :45:00 the next hour."""
    return at_micros(nearest(micros(ts), 1_800_000_000))


def half_hour_by_minute(ts: str) -> Column:
    """The same map by the minute field alone, seconds dropped."""
    us = micros(ts)
    minute = F.floor(us / F.lit(60_000_000)) % 60
    return at_micros((us - F.pmod(us, F.lit(3_600_000_000)) + F.round(minute / 30).cast("long") * 1_800_000_000).cast("long"))


def half_second(ts: str) -> Column:
    return at_micros(nearest(micros(ts), 500_000))


def nearest_hour(ts: str) -> Column:
    return at_micros(nearest(micros(ts), 3_600_000_000))


def day(ts: str) -> Column:
    return F.date_trunc("DAY", F.col(ts).cast("timestamp_ntz")).cast("date")


def date_text(ts: str) -> Column:
    """Like 01-Mar-2024 14:30:00; at midnight the date alone."""
    whole = F.date_format(ts, "dd-MMM-yyyy HH:mm:ss")
    return F.when(F.date_format(ts, "HH:mm:ss.SSSSSS") == "00:00:00.000000", F.date_format(ts, "dd-MMM-yyyy")).otherwise(whole)


def seconds_of_name(name: str | Column, pattern: str = r"do-lidar_(\d+)\.laz$") -> Column:
    """POSIX seconds in a file's name, null where it has none."""
    return F.nullif(F.regexp_extract(col(name), pattern, 1), F.lit("")).try_cast("long")


def time_of_name(name: str | Column, year: int, pattern: str = r"(\d{4}_\d{4})") -> Column:
    """The time of a name that holds MMdd_HHmm, of a given year."""
    return F.try_to_timestamp(F.concat(F.lit(f"{year:04d}"), F.regexp_extract(col(name), pattern, 1)), F.lit("yyyyMMdd_HHmm")).cast("timestamp_ntz")
