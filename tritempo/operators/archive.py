"""Hourly archive layout: decoding and filters on its integer time columns."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timedelta
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tritempo.constants import (
    DEFAULT_SERIES_ZONE,
    DELIVERY_END,
    DELIVERY_START,
    DELIVERY_START_NAMES,
    IDENTIFIER,
    REFERENCE_TIME,
)
from tritempo.functions.catalogcols import series_zone
from tritempo.functions.numbers import adaptive_round
from tritempo.functions.predicates import OPERATORS
from tritempo.functions.rdp import relative_delivery_period_by
from tritempo.functions.timebounds import Interval, add_calendar, to_local, zone_name
from tritempo.functions.timecols import as_column, plus_hours, utc_to_zone, zone_to_utc
from tritempo.operators.joins import lookup_join

#: ``(field, operator, UTC instant)`` or ``(field, "in", Interval)``
DeliveryBound = tuple[str, str, datetime | Interval]


def _midnight(year: str, month: str, day: str) -> Column:
    return F.make_timestamp_ntz(F.col(year), F.col(month), F.col(day), F.lit(0), F.lit(0), F.lit(0))


def archive_decode(
    df: DataFrame,
    *,
    zone: Column | str = DEFAULT_SERIES_ZONE,
    identifier: Column | str = "ts_id",
    null_as_zero: bool = False,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Archive rows as logical rows with UTC times, and the columns named in ``keep``.

    The reference time is local midnight of the quote date. Delivery starts at
    the stored clock fields minus the stored offset and ends one hour of wall
    clock later.
    """
    clock = F.make_timestamp_ntz(
        F.col("del_y"), F.col("del_m"), F.col("del_d"), F.col("del_h"), F.col("del_min"), F.lit(0)
    )
    start = clock - F.make_dt_interval(F.lit(0), F.col("del_offset"))
    end = zone_to_utc(plus_hours(utc_to_zone(start, zone), 1), zone)
    return df.select(
        as_column(identifier).alias(IDENTIFIER),
        zone_to_utc(_midnight("qte_y", "qte_m", "qte_d"), zone).alias(REFERENCE_TIME),
        start.alias(DELIVERY_START),
        end.alias(DELIVERY_END),
        F.lit(None).cast("bigint").alias("RelativeDeliveryPeriod"),
        adaptive_round("value", null_as_zero=null_as_zero).alias("Value"),
        F.lit(None).cast("bigint").alias("LegacyDeliveryBucketNumber"),
        *keep,
    )


def archive_rows(
    df: DataFrame, series: DataFrame, *, null_as_zero: bool = False, delivery_resolution: str = ""
) -> DataFrame:
    """Archive rows of catalogued series, decoded in the zone of each series.

    ``series`` has one row per series (``catalog.series_of``); its archive id
    finds the rows and its resolution gives the relative delivery period.
    """
    lookup = series.filter(F.trim(F.col("archive_id")) != "").select(
        F.col("archive_id").alias("ts_id"), "series_id", series_zone("timezone").alias("_zone"), "resolution"
    )
    known = lookup_join(df, lookup, "ts_id")
    rows = archive_decode(
        known, zone=F.col("_zone"), identifier="series_id", null_as_zero=null_as_zero, keep=("resolution",)
    )
    filled = with_relative_delivery_period(rows, "resolution", delivery_resolution=delivery_resolution)
    return filled.drop("resolution")


def with_relative_delivery_period(
    df: DataFrame, resolution: Column | str, *, delivery: str | None = None, delivery_resolution: str = ""
) -> DataFrame:
    """Fill RelativeDeliveryPeriod; rows of an unknown resolution keep what they have."""
    start = delivery or next(name for name in DELIVERY_START_NAMES if name in df.columns)
    period = relative_delivery_period_by(
        REFERENCE_TIME, start, resolution, delivery_resolution=delivery_resolution
    )
    return df.withColumn("RelativeDeliveryPeriod", F.coalesce(period, F.col("RelativeDeliveryPeriod")))


def _expanded(bounds: Iterable[DeliveryBound]) -> list[tuple[str, str, datetime]]:
    """Intervals as two half-open bounds."""
    result: list[tuple[str, str, datetime]] = []
    for field, op, value in bounds:
        if field.lower() not in (DELIVERY_START.lower(), DELIVERY_END.lower()):
            raise ValueError(f"{field!r} is not a delivery field")
        if isinstance(value, Interval):
            result += [(field, ">=", value.start), (field, "<", value.end)]
        elif op in OPERATORS:
            result.append((field, op, value))
        else:
            raise ValueError(f"unsupported filter operator {op!r}")
    return result


def _local_hour(field: str, instant: datetime, zone: str) -> datetime:
    hour = to_local(instant, zone).replace(minute=0, second=0, microsecond=0)
    return hour - timedelta(hours=1) if field.lower() == DELIVERY_END.lower() else hour


def _delivery_number() -> Column:
    """The stored local delivery hour as a number that orders like its four fields."""
    number = F.col("del_y").cast("bigint")
    for field in ("del_m", "del_d", "del_h"):
        number = number * 100 + F.col(field)
    return number


def _hour_number(hour: datetime) -> int:
    return ((hour.year * 100 + hour.month) * 100 + hour.day) * 100 + hour.hour


#: an hour and whether it is excluded
_Side = tuple[datetime, bool]


def _window(bounds: list[DeliveryBound], zone: str, one_sided_years: int | None) -> tuple[_Side | None, _Side | None]:
    """The tightest bound of each side, as local hours of a zone."""
    lower: _Side | None = None
    upper: _Side | None = None
    for field, op, instant in _expanded(bounds):
        hour = _local_hour(field, instant, zone)
        if op in ("=", ">=", ">"):
            candidate = (hour, op == ">")
            lower = candidate if lower is None else max(lower, candidate)
        if op in ("=", "<=", "<"):
            candidate = (hour, op == "<")
            upper = candidate if upper is None else min(upper, candidate, key=lambda side: (side[0], not side[1]))
    if one_sided_years is not None:
        if lower is None and upper is not None:
            lower = (add_calendar(upper[0], -12 * one_sided_years, 0), False)
        elif upper is None and lower is not None:
            upper = (add_calendar(lower[0], 12 * one_sided_years, 0), False)
    return lower, upper


def _years(first: int | None, last: int | None) -> Column:
    condition = F.lit(True)
    if first is not None:
        condition = condition & (F.col("del_y") >= F.lit(first))
    return condition if last is None else condition & (F.col("del_y") <= F.lit(last))


def delivery_hours(
    bounds: Iterable[DeliveryBound], zone: str = DEFAULT_SERIES_ZONE, *, one_sided_years: int | None = None
) -> Column:
    """Delivery bounds as a predicate on the stored local hours.

    Bounds are moved into ``zone`` once, as literals. The tightest bound of each
    side counts; a missing side is open, or lies ``one_sided_years`` away where
    such a cut is asked for. The implied range of ``del_y`` is added for the scan.
    """
    lower, upper = _window(list(bounds), zone_name(zone), one_sided_years)
    condition = _years(lower and lower[0].year, upper and upper[0].year)
    for side, loose, strict in ((lower, ">=", ">"), (upper, "<=", "<")):
        if side is not None:
            hour, is_strict = side
            condition = condition & OPERATORS[strict if is_strict else loose](
                _delivery_number(), F.lit(_hour_number(hour))
            )
    return condition


def delivery_hours_by_zone(
    bounds: Iterable[DeliveryBound], zone: Column | str, zones: Iterable[str], *, one_sided_years: int | None = None
) -> Column:
    """``delivery_hours`` for rows of several zones: each row by the bounds moved into its own.

    ``zones`` are the zones that occur; rows of other zones do not match. The range
    of ``del_y`` over all zones is stated on its own, for the scan.
    """
    bounds, zones = list(bounds), list(dict.fromkeys(zones))
    if not zones:
        return F.lit(False)
    windows = [_window(bounds, zone_name(name), one_sided_years) for name in zones]
    lowers, uppers = [lower for lower, _ in windows], [upper for _, upper in windows]
    hull = _years(
        None if None in lowers else min(hour.year for hour, _ in lowers),
        None if None in uppers else max(hour.year for hour, _ in uppers),
    )
    own = [
        (as_column(zone) == name) & delivery_hours(bounds, name, one_sided_years=one_sided_years) for name in zones
    ]
    return hull & reduce(or_, own)


def relative_delivery_hours() -> Column:
    """Wall-clock hours between the quote date and the delivery hour."""
    delivery = F.make_date(F.col("del_y"), F.col("del_m"), F.col("del_d"))
    quote = F.make_date(F.col("qte_y"), F.col("qte_m"), F.col("qte_d"))
    return F.datediff(delivery, quote) * 24 + F.col("del_h")


def relative_delivery(op: str, hours: int) -> Column:
    """``RelativeDeliveryPeriod op hours`` on archive rows."""
    if op not in OPERATORS:
        raise ValueError(f"unsupported filter operator {op!r}")
    return OPERATORS[op](relative_delivery_hours(), F.lit(int(hours)))


def _both(condition: Column, relative: Iterable[tuple[str, int]]) -> Column:
    return reduce(and_, [relative_delivery(op, hours) for op, hours in relative], condition)


def delivery_and_relative(
    bounds: Iterable[DeliveryBound],
    relative: Iterable[tuple[str, int]],
    zone: str = DEFAULT_SERIES_ZONE,
    *,
    one_sided_years: int | None = None,
) -> Column:
    """Both windows at once; nothing matches when they do not meet."""
    return _both(delivery_hours(bounds, zone, one_sided_years=one_sided_years), relative)


def delivery_and_relative_by_zone(
    bounds: Iterable[DeliveryBound],
    relative: Iterable[tuple[str, int]],
    zone: Column | str,
    zones: Iterable[str],
    *,
    one_sided_years: int | None = None,
) -> Column:
    """``delivery_and_relative`` for rows of several zones, see ``delivery_hours_by_zone``."""
    return _both(delivery_hours_by_zone(bounds, zone, zones, one_sided_years=one_sided_years), relative)
