"""Local calendars over UTC timestamps."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronicle.params import Params


def local_time(ts: Column, tz: str) -> Column:
    """The wall clock (TIMESTAMP_NTZ) that a UTC instant shows in `tz`; the session zone is UTC.

    `from_utc_timestamp` looks a literal zone up once, `convert_timezone` once per row.
    """
    shown = ts if tz == "UTC" else F.from_utc_timestamp(ts, tz)
    return shown.cast("timestamp_ntz")


def localise(wall: Column, tz: str) -> Column:
    """The UTC instant of a wall clock: the first of two, and gaps shifted forward."""
    return F.to_utc_timestamp(wall, tz)


def bucket(local: Column, granularity: str) -> Column:
    """First local day of the day, ISO week, month or year of `local`."""
    day = local.cast("date")
    return day if granularity == "day" else F.trunc(day, granularity).cast("date")


def with_local(df: DataFrame, params: Params) -> DataFrame:
    return df.withColumn("local_ts", local_time(F.col("ts"), params.tz))


def in_range(df: DataFrame, params: Params) -> DataFrame:
    """Keep rows whose local day lies in the range.

    The exact test works on a derived column, which no file format can use to skip data. No zone
    is further than a day from UTC, so a wider bound on the stored `ts` reaches the scan, and only
    rows near the bound are converted for the exact test.
    """
    day, one = F.col("local_ts").cast("date"), timedelta(days=1)
    if params.date_from:
        df = df.filter(F.col("ts") >= _instant(params.date_from - one))
        inside = F.col("ts") >= _instant(params.date_from + one)
        df = df.filter(inside | (day >= F.lit(params.date_from)))
    if params.date_to:
        df = df.filter(F.col("ts") < _instant(params.date_to + 2 * one))
        inside = F.col("ts") < _instant(params.date_to)
        df = df.filter(inside | (day <= F.lit(params.date_to)))
    return df


def _instant(day: date) -> Column:
    return F.lit(f"{day.isoformat()} 00:00:00").cast("timestamp")
