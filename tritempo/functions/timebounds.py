"""Time bounds: plan-time constants for predicates.

Every function here turns text into naive UTC ``datetime`` values once, on the
driver, so that the predicate that reaches Spark compares a bare column with a
literal and can be pushed into the scan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from tritempo.constants import ZONE_ALIASES

_PERIOD = re.compile(
    r"P(?:(?P<years>\d+)Y)?(?:(?P<months>\d+)M)?(?:(?P<weeks>\d+)W)?(?:(?P<days>\d+)D)?"
    r"(?:T(?:(?P<hours>\d+)H)?(?:(?P<minutes>\d+)M)?(?:(?P<seconds>\d+)S)?)?"
)
_LOCAL_POINT = re.compile(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{3})?")
_OFFSET_POINT = re.compile(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})")

#: interval name -> its length
INTERVAL_LENGTHS = {"day": "P1D", "week": "P7D", "month": "P1M", "quarter": "P3M", "year": "P1Y"}


def zone_name(name: str | None) -> str:
    """IANA name for a zone argument; empty means UTC."""
    text = (name or "").strip()
    resolved = ZONE_ALIASES.get(text.lower(), text)
    try:
        ZoneInfo(resolved)
    except (ZoneInfoNotFoundError, ValueError, OSError) as error:
        raise ValueError(f"invalid time zone {name!r}") from error
    return resolved


@dataclass(frozen=True)
class Period:
    """An ISO-8601 period with the units Y, M, W, D, H, M, S."""

    months: int = 0
    days: int = 0
    seconds: int = 0

    @classmethod
    def parse(cls, text: str) -> Period:
        match = _PERIOD.fullmatch(text.strip())
        if match is None:
            raise ValueError(f"invalid ISO period {text!r}")
        part = {unit: int(count or 0) for unit, count in match.groupdict().items()}
        return cls(
            months=12 * part["years"] + part["months"],
            days=7 * part["weeks"] + part["days"],
            seconds=3600 * part["hours"] + 60 * part["minutes"] + part["seconds"],
        )

    def __neg__(self) -> Period:
        return Period(-self.months, -self.days, -self.seconds)


def as_period(period: Period | str) -> Period:
    """Accepts ``P1D``, ``+P1D``, ``-P1D`` or a Period."""
    if isinstance(period, Period):
        return period
    text = period.strip()
    if text.startswith("-"):
        return -Period.parse(text[1:])
    return Period.parse(text.removeprefix("+"))


def add_calendar(value: datetime, months: int, days: int) -> datetime:
    """Month and day addition in which an overlong day rolls into the next month."""
    total = value.year * 12 + value.month - 1 + months
    first = value.replace(year=total // 12, month=total % 12 + 1, day=1)
    return first + timedelta(days=value.day - 1 + days)


def to_utc(local: datetime, zone: str | None) -> datetime:
    """Naive wall clock in ``zone`` -> naive UTC; wall clocks skipped by DST are rejected."""
    info = ZoneInfo(zone_name(zone))
    instant = local.replace(tzinfo=info).astimezone(timezone.utc)
    if instant.astimezone(info).replace(tzinfo=None) != local:
        raise ValueError(f"{local.isoformat()} does not exist in {zone}")
    return instant.replace(tzinfo=None)


def to_local(utc: datetime, zone: str | None) -> datetime:
    """Naive UTC -> naive wall clock in ``zone``."""
    return utc.replace(tzinfo=timezone.utc).astimezone(ZoneInfo(zone_name(zone))).replace(tzinfo=None)


def shift(utc: datetime, period: Period | str, *, calendar: str = "utc", zone: str | None = None) -> datetime:
    """Add a signed period.

    ``calendar="utc"`` moves the UTC instant; ``calendar="local"`` moves the
    wall clock of ``zone`` for the month and day parts.
    """
    amount = as_period(period)
    if calendar == "utc":
        moved = add_calendar(utc, amount.months, amount.days)
    elif calendar == "local":
        moved = to_utc(add_calendar(to_local(utc, zone), amount.months, amount.days), zone)
    else:
        raise ValueError(f"unknown calendar {calendar!r}")
    return moved + timedelta(seconds=amount.seconds)


def point(text: str, zone: str | None = None, *, plus: Period | str | None = None, calendar: str = "utc") -> datetime:
    """A point in time as naive UTC.

    The text is a wall clock in ``zone`` unless it carries its own offset.
    """
    raw = text.strip()
    if _LOCAL_POINT.fullmatch(raw):
        utc = to_utc(datetime.fromisoformat(raw), zone)
    elif _OFFSET_POINT.fullmatch(raw):
        utc = datetime.fromisoformat(raw).astimezone(timezone.utc).replace(tzinfo=None)
    else:
        raise ValueError(f"invalid point in time {text!r}")
    return utc if plus is None else shift(utc, plus, calendar=calendar, zone=zone)


def now(*, at: datetime | None = None, plus: Period | str | None = None) -> datetime:
    """The current instant, or ``at`` when a caller needs a repeatable plan."""
    utc = at or datetime.now(timezone.utc).replace(tzinfo=None)
    return utc if plus is None else shift(utc, plus)


@dataclass(frozen=True)
class Interval:
    """Half-open interval of naive UTC instants."""

    start: datetime
    end: datetime

    @property
    def begin(self) -> datetime:
        return self.start

    def shifted(self, period: Period | str, *, calendar: str = "utc", zone: str | None = None) -> Interval:
        return Interval(
            shift(self.start, period, calendar=calendar, zone=zone),
            shift(self.end, period, calendar=calendar, zone=zone),
        )


def _instant(value: str | datetime, zone: str | None) -> datetime:
    return value if isinstance(value, datetime) else point(value, zone)


def interval(start: str | datetime, end: str | datetime, zone: str | None = None) -> Interval:
    """Explicit interval between two points."""
    return Interval(_instant(start, zone), _instant(end, zone))


def interval_of(
    unit: str, start: str | datetime, zone: str | None = None, *, calendar: str = "utc"
) -> Interval:
    """Day, week, month, quarter or year that begins at the point itself (no snapping)."""
    if unit not in INTERVAL_LENGTHS:
        raise ValueError(f"unknown interval unit {unit!r}")
    begin = _instant(start, zone)
    return Interval(begin, shift(begin, INTERVAL_LENGTHS[unit], calendar=calendar, zone=zone))


#: Gas day, week, month, quarter and year have the bounds of their plain namesakes.
gas_interval_of = interval_of


def gas_season(season: str, at: str | datetime, zone: str | None = None) -> Interval:
    """European gas season: summer starts 1 April 06:00, winter 1 October 06:00, local time."""
    local = to_local(_instant(at, zone), zone)

    def boundary(year: int, month: int) -> datetime:
        return to_utc(datetime(year, month, 1, 6), zone)

    if season == "summer":
        return Interval(boundary(local.year, 4), boundary(local.year, 10))
    if season == "winter":
        first = local.year if local.month >= 10 else local.year - 1
        return Interval(boundary(first, 10), boundary(first + 1, 4))
    raise ValueError(f"unknown gas season {season!r}")
