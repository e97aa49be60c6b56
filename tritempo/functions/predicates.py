"""Filter predicates. Each returns a Column; combine them with ``&``.

Time values are naive UTC datetimes from ``timebounds``, so predicates on stored
columns stay of the form ``column <op> literal`` and reach the scan.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from tritempo.constants import DELETED, REFERENCE_TIME
from tritempo.functions.timebounds import Interval, point
from tritempo.functions.timecols import as_column, ntz

OPERATORS: dict[str, Callable] = {
    "=": operator.eq,
    ">": operator.gt,
    ">=": operator.ge,
    "<": operator.lt,
    "<=": operator.le,
}


def compare(field: Column | str, op: str, value: object) -> Column:
    """``field op value`` for the five comparison operators."""
    if op not in OPERATORS:
        raise ValueError(f"unsupported filter operator {op!r}")
    if isinstance(value, datetime):
        value = ntz(value)
    elif not isinstance(value, Column):
        value = F.lit(value)
    return OPERATORS[op](as_column(field), value)


def numeric(field: Column | str, op: str, number: int | float | str) -> Column:
    """Numeric comparison; number text is a 64-bit integer unless it has a point."""
    if isinstance(number, str):
        number = float(number) if "." in number else int(number)
    kind = "bigint" if isinstance(number, int) else "double"
    return compare(field, op, F.lit(number).cast(kind))


def text(field: Column | str, op: str, value: str) -> Column:
    """Text comparison by code point."""
    return compare(field, op, value)


def at(field: Column | str, op: str, instant: datetime) -> Column:
    """Comparison of a time column with a point in time."""
    return compare(field, op, instant)


def within(field: Column | str, bounds: Interval) -> Column:
    """``start <= field < end``."""
    return at(field, ">=", bounds.start) & at(field, "<", bounds.end)


def lite_range(since: str, until: str | None = None, *, field: Column | str = REFERENCE_TIME) -> Column:
    """``field >= since [and field < until]`` for two UTC points."""
    start = point(since)
    condition = at(field, ">=", start)
    if until is None:
        return condition
    end = point(until)
    if end <= start:
        raise ValueError("the end of the range must be later than its start")
    return condition & at(field, "<", end)


def not_deleted(include_deleted: bool = False, *, field: Column | str = DELETED) -> Column:
    """Drops rows flagged deleted. Apply it after version selection."""
    return F.lit(True) if include_deleted else ~as_column(field)
