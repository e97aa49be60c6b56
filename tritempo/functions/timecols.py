"""Column functions on UTC wall-clock timestamps (``timestamp_ntz``).

None of them reads the session time zone: dates come from a cast to DATE, clock
fields from ``hour``/``minute``/``second``, both of which are zone-free on
``timestamp_ntz``.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from tritempo.functions.timebounds import zone_name


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def ntz(value: datetime) -> Column:
    """A ``timestamp_ntz`` literal."""
    return F.expr(f"TIMESTAMP_NTZ '{value.isoformat(sep=' ')}'")


def zone_column(zone: Column | str | None) -> Column:
    """A zone given by name becomes a literal; a zone column is used per row."""
    return zone if isinstance(zone, Column) else F.lit(zone_name(zone))


def _session_in_utc() -> Column:
    """Whether casts of this plan use UTC.

    Spark binds the zone of this expression where it binds the zone of the casts,
    and folds it to a constant, so only one branch of a choice by it is left to run.
    """
    return F.date_format(F.timestamp_seconds(F.lit(0)), "VV") == "UTC"


def utc_to_zone(column: Column | str, zone: Column | str | None) -> Column:
    """Wall clock of a UTC timestamp in ``zone``."""
    if _is_utc(zone):
        return as_column(column)
    value, target = as_column(column), zone_column(zone)
    # convert_timezone looks zones up per row; the other function does it once but needs casts that a UTC session
    # leaves unchanged
    direct = F.from_utc_timestamp(value.cast("timestamp"), target).cast("timestamp_ntz")
    return F.when(_session_in_utc(), direct).otherwise(F.convert_timezone(F.lit("UTC"), target, value))


def zone_to_utc(column: Column | str, zone: Column | str | None) -> Column:
    """UTC timestamp of a wall clock in ``zone``."""
    if _is_utc(zone):
        return as_column(column)
    value, origin = as_column(column), zone_column(zone)
    direct = F.to_utc_timestamp(value.cast("timestamp"), origin).cast("timestamp_ntz")
    return F.when(_session_in_utc(), direct).otherwise(F.convert_timezone(origin, F.lit("UTC"), value))


def plus_hours(column: Column, hours: Column | int) -> Column:
    amount = hours if isinstance(hours, Column) else F.lit(hours)
    return column + F.make_dt_interval(F.lit(0), amount.cast("int"))


def days_since(column: Column, anchor: str) -> Column:
    return F.datediff(column.cast("date"), F.lit(anchor).cast("date"))


def seconds_of_day(column: Column) -> Column:
    return F.hour(column) * 3600 + F.minute(column) * 60 + F.second(column)


def epoch_seconds(column: Column) -> Column:
    """Whole seconds since 1970-01-01, rounded down."""
    return days_since(column, "1970-01-01").cast("bigint") * 86400 + seconds_of_day(column)


def epoch_micros(column: Column) -> Column:
    day_and_minutes = days_since(column, "1970-01-01").cast("bigint") * 86400 + (
        F.hour(column) * 3600 + F.minute(column) * 60
    )
    seconds = F.extract(F.lit("SECOND"), column)
    return day_and_minutes * 1_000_000 + (seconds * 1_000_000).cast("bigint")


def quote_index(column: Column | str) -> Column:
    """``yyyymmdd`` of the UTC date."""
    value = as_column(column)
    return (F.year(value) * 10000 + F.month(value) * 100 + F.dayofmonth(value)).cast("int")


def _is_utc(zone: Column | str | None) -> bool:
    return not isinstance(zone, Column) and zone_name(zone) == "UTC"


def _rendered(plain: Column, ahead: Column | None, *, offset: bool) -> Column:
    """Response text from a wall clock cast to text and its distance from UTC (None: no distance).

    The text is ``yyyy-MM-dd HH:mm:ss[.f..]``, without trailing zeros in the fraction.
    """
    fraction = F.rpad(F.substring(plain, 21, 3), 3, "0")
    parts = [F.substring(plain, 1, 10), F.lit("T"), F.substring(plain, 12, 8), F.lit("."), fraction]
    if offset and ahead is None:
        parts.append(F.lit("+00:00"))
    elif offset:
        hours, minutes = F.extract(F.lit("HOUR"), ahead), F.extract(F.lit("MINUTE"), ahead)
        parts += [
            F.when(hours + minutes < 0, F.lit("-")).otherwise(F.lit("+")),
            F.lpad(F.abs(hours).cast("string"), 2, "0"),
            F.lit(":"),
            F.lpad(F.abs(minutes).cast("string"), 2, "0"),
        ]
    return F.concat(*parts)


def format_timestamp(column: Column | str, zone: Column | str | None = None, *, offset: bool = True) -> Column:
    """``yyyy-MM-ddTHH:mm:ss.SSS`` with the offset of ``zone``, as text.

    The text is cut from the wall clock's own text, so the session zone has no part in it.
    """
    utc = as_column(column)
    local = utc_to_zone(utc, zone)
    return _rendered(local.cast("string"), None if _is_utc(zone) else local - utc, offset=offset)


def format_timestamps(array: Column, zone: str | None = None, *, offset: bool = True) -> Column:
    """``format_timestamp`` of every element. Each step of an element is bound once, as lambdas are not compiled."""
    if _is_utc(zone):
        texts = F.transform(array, lambda utc: utc.cast("string"))
        return F.transform(texts, lambda text: _rendered(text, None, offset=offset))
    clocks = F.transform(array, lambda utc: F.struct(utc.alias("utc"), utc_to_zone(utc, zone).alias("local")))
    texts = F.transform(
        clocks,
        lambda clock: F.struct(
            clock["local"].cast("string").alias("text"), (clock["local"] - clock["utc"]).alias("ahead")
        ),
    )
    return F.transform(texts, lambda clock: _rendered(clock["text"], clock["ahead"], offset=offset))
