"""Bounds on the quote-date index implied by bounds on ReferenceTime.

Tables partitioned by ``quote_index`` are pruned by these bounds. By default
pruning never removes a row the ReferenceTime filter keeps.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date, datetime, time, timedelta
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tritempo.constants import DEFAULT_SERIES_ZONE, QUOTE_INDEX
from tritempo.functions.timebounds import Interval, add_calendar, to_local
from tritempo.functions.timecols import as_column

#: a bound is ``(operator, UTC instant)`` or an Interval
Bound = tuple[str, datetime] | Interval

# Days added around a bound so that every zone's dates are covered.
RECENT_PADDING = {"=": (-1, 1), ">=": (-2, None), ">": (-3, None), "<=": (None, 2), "<": (None, 3), "in": (-2, 2)}
OPEN_END_DAYS = 2


@dataclass(frozen=True)
class DayRange:
    """Inclusive range of dates; None is open, ``empty`` matches nothing."""

    first: date | None = None
    last: date | None = None
    empty: bool = False

    def narrowed(self, first: date | None = None, last: date | None = None) -> DayRange:
        starts = [day for day in (self.first, first) if day is not None]
        ends = [day for day in (self.last, last) if day is not None]
        return DayRange(max(starts, default=None), min(ends, default=None), self.empty)

    @property
    def is_empty(self) -> bool:
        return self.empty or (self.first is not None and self.last is not None and self.last < self.first)

    def predicate(self, field: Column | str = QUOTE_INDEX) -> Column:
        if self.is_empty:
            return F.lit(False)
        index = as_column(field)
        conditions = F.lit(True)
        if self.first is not None:
            conditions = conditions & (index >= index_of(self.first))
        if self.last is not None:
            conditions = conditions & (index <= index_of(self.last))
        return conditions


def index_of(day: date) -> int:
    return day.year * 10000 + day.month * 100 + day.day


def _years_from(day: date, years: int) -> date:
    return add_calendar(datetime.combine(day, time()), 12 * years, 0).date()


def _padded(day: date, padding: int | None) -> date | None:
    return None if padding is None else day + timedelta(days=padding)


def quote_index_range(
    bounds: Iterable[Bound], *, now: datetime | None = None, lookback_years: int | None = None
) -> DayRange:
    """Index dates of the recent layout; several bounds intersect.

    ``lookback_years`` cuts a range without a start that many years before its
    end, and ``now`` ends a range without an end two days after today. Both
    drop rows outside and are off unless asked for.
    """
    days = DayRange()
    for bound in bounds:
        op, start, end = ("in", bound.start, bound.end) if isinstance(bound, Interval) else (*bound, bound[1])
        before, after = RECENT_PADDING[op]
        days = days.narrowed(_padded(start.date(), before), _padded(end.date(), after))
    if days.first is None and days.last is not None and lookback_years is not None:
        days = days.narrowed(first=_years_from(days.last, -lookback_years))
    elif days.first is not None and days.last is None and now is not None:
        days = days.narrowed(last=max(now.date(), days.first) + timedelta(days=OPEN_END_DAYS))
    return days


def quote_day_range(
    bounds: Iterable[tuple[str, datetime]],
    zone: str = DEFAULT_SERIES_ZONE,
    *,
    now: datetime | None = None,
    lookback_years: int | None = None,
    span_years: int | None = None,
) -> DayRange:
    """Whole quote days of the archive whose local midnight satisfies every bound.

    Three cuts drop rows outside and are off unless asked for: with ``now`` an open
    end stops at today, with ``span_years`` that many years after the start, and
    with ``now`` and ``lookback_years`` an open start begins that many years
    before today.
    """
    days = DayRange()
    for op, instant in bounds:
        local = to_local(instant, zone)
        day, midnight = local.date(), local.time() == time()
        if op == "=":
            days = days.narrowed(day, day) if midnight else DayRange(empty=True)
        elif op in (">=", ">"):
            days = days.narrowed(first=day if op == ">=" and midnight else day + timedelta(days=1))
        elif op in ("<=", "<"):
            days = days.narrowed(last=day - timedelta(days=1) if op == "<" and midnight else day)
        else:
            raise ValueError(f"unsupported filter operator {op!r}")
        if days.empty:
            return days
    if days.first is None and now is not None and lookback_years is not None:
        days = days.narrowed(first=_years_from(now.date(), -lookback_years))
    if days.last is None and days.first is not None:
        ends = [now.date()] if now is not None else []
        ends += [_years_from(days.first, span_years)] if span_years is not None else []
        days = days.narrowed(last=min(ends, default=None))
    return days


def quote_days_by_zone(
    bounds: Iterable[tuple[str, datetime]], zone: Column | str, zones: Iterable[str], *,
    field: Column | str = QUOTE_INDEX, **cuts,
) -> Column:
    """``quote_day_range`` for rows of several zones: each row by the bounds of its own.

    ``zones`` are the zones that occur; rows of other zones do not match. The days
    from the first of any zone to the last of any are stated on their own, for
    pruning.
    """
    bounds = list(bounds)
    days = {name: quote_day_range(bounds, name, **cuts) for name in dict.fromkeys(zones)}
    full = [each for each in days.values() if not each.is_empty]
    if not full:
        return F.lit(False)
    firsts, lasts = [each.first for each in full], [each.last for each in full]
    hull = DayRange(None if None in firsts else min(firsts), None if None in lasts else max(lasts))
    own = [(as_column(zone) == name) & each.predicate(field) for name, each in days.items()]
    return hull.predicate(field) & reduce(or_, own)
