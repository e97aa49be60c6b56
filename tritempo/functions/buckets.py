"""Period buckets.

A bucket number counts unit boundaries since an anchor and is divided with
truncation toward zero, so for periods longer than one unit the bucket at the
anchor covers both sides of it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tritempo.functions.timecols import as_column, days_since, utc_to_zone, zone_to_utc

_SINGLE_UNIT = re.compile(r"P(?:T(?P<time>[1-9]\d*)(?P<time_unit>[HM])|(?P<date>[1-9]\d*)(?P<date_unit>[DWMY]))")
_UNITS = {"TH": "hour", "TM": "minute", "D": "day", "W": "week", "M": "month", "Y": "year"}


def bucket_unit(period: str) -> tuple[str, int]:
    """``PT6H`` -> ``("hour", 6)``; only single-unit periods without seconds are buckets."""
    match = _SINGLE_UNIT.fullmatch(period.strip().upper())
    if match is None:
        raise ValueError(f"unsupported aggregation period {period!r}")
    if match["time"]:
        return _UNITS["T" + match["time_unit"]], int(match["time"])
    return _UNITS[match["date_unit"]], int(match["date"])


def _truncated(number: Column, size: int) -> Column:
    """First unit of the bucket that ``number`` falls in."""
    if size == 1:
        return number
    return number - number % size  # % keeps the sign of the dividend: truncation toward zero


def bucket_start(
    column: Column | str, period: str, zone: Column | str | None = None, *, week_start: str = "sunday"
) -> Column:
    """Start of the period bucket a timestamp falls in, as a UTC timestamp.

    With a zone the buckets follow the wall clock of that zone.
    ``week_start="sunday"`` counts week boundaries on Sundays although the anchor
    is a Monday; ``"monday"`` counts them on Mondays.
    """
    unit, size = bucket_unit(period)
    if week_start not in ("sunday", "monday"):
        raise ValueError(f"unknown week start {week_start!r}")
    local = utc_to_zone(as_column(column), zone)
    anchor = F.expr("TIMESTAMP_NTZ '2000-01-01 00:00:00'")
    zero = F.lit(0)

    if unit in ("hour", "minute"):
        hours = days_since(local, "2000-01-01") * 24 + F.hour(local)
        if unit == "hour":
            start = anchor + F.make_dt_interval(zero, _truncated(hours, size))
        else:
            start = anchor + F.make_dt_interval(zero, zero, _truncated(hours * 60 + F.minute(local), size))
    elif unit == "day":
        start = anchor + F.make_dt_interval(_truncated(days_since(local, "2000-01-01"), size))
    elif unit == "week":
        days = days_since(local, "2000-01-02" if week_start == "sunday" else "2000-01-03")
        weeks = ((days - F.pmod(days, F.lit(7))) / 7).cast("int")
        monday = F.expr("TIMESTAMP_NTZ '2000-01-03 00:00:00'")
        start = monday + F.make_dt_interval(_truncated(weeks, size) * 7)
    else:
        months = (F.year(local) - 2000) * 12 + F.month(local) - 1
        number = months if unit == "month" else F.year(local) - 2000
        first = _truncated(number, size) * (1 if unit == "month" else 12)
        start = F.add_months(F.lit("2000-01-01").cast("date"), first).cast("timestamp_ntz")
    return zone_to_utc(start, zone)
