"""Relative delivery period: how many resolution units delivery lies after the reference time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tritempo.functions.timecols import as_column, days_since, epoch_micros, epoch_seconds

#: resolution -> length in seconds, counted on instants cut to that length
SECOND_UNITS = {"PT1H": 3600, "PT30M": 1800, "PT15M": 900, "PT5M": 300, "PT1M": 60, "PT4S": 4}
#: resolution -> length in months, counted on calendar periods of the year
MONTH_UNITS = {"P1M": 1, "P3M": 3, "P6M": 6, "P1Y": 12}
#: resolution -> delivery resolution under which both times move to the gas calendar first
GAS_CALENDAR = {"P6M": "Season", "P1Y": "Year"}
RESOLUTIONS = (*MONTH_UNITS, "P1W", "P1D", *SECOND_UNITS)


def _in_seconds(reference: Column, delivery: Column, unit: Column) -> Column:
    return F.floor(epoch_seconds(delivery) / unit) - F.floor(epoch_seconds(reference) / unit)


def _in_months(reference: Column, delivery: Column, unit: Column, *, gas: bool = False) -> Column:
    def period(column: Column) -> Column:
        time = _gas_shifted(column) if gas else column
        return F.floor((F.year(time) * 12 + F.month(time) - 1) / unit)

    return period(delivery) - period(reference)


def _gas_shifted(column: Column) -> Column:
    """Nine months earlier; a day the target month lacks rolls into the next month."""
    first = F.trunc(column.cast("date"), "MM")
    return F.date_add(F.add_months(first, -9), F.dayofmonth(column) - 1)


def _in_days(reference: Column, delivery: Column) -> Column:
    elapsed = epoch_micros(delivery) - epoch_micros(reference)
    day = F.lit(86_400_000_000)
    return (elapsed - elapsed % day) / day


def _in_weeks(reference: Column, delivery: Column) -> Column:
    def monday(column: Column) -> Column:
        return days_since(column, "1970-01-01") - F.weekday(column)

    return (monday(delivery) - monday(reference)) / 7


def relative_delivery_period(
    reference: Column | str, delivery: Column | str, resolution: str, *, delivery_resolution: str = ""
) -> Column:
    """Relative delivery period for one resolution, as bigint; null for an unknown resolution."""
    start, end = as_column(reference), as_column(delivery)
    if resolution in SECOND_UNITS:
        period = _in_seconds(start, end, F.lit(SECOND_UNITS[resolution]))
    elif resolution in MONTH_UNITS:
        gas = bool(delivery_resolution) and GAS_CALENDAR.get(resolution) == delivery_resolution
        period = _in_months(start, end, F.lit(MONTH_UNITS[resolution]), gas=gas)
    elif resolution == "P1W":
        period = _in_weeks(start, end)
    elif resolution == "P1D":
        period = _in_days(start, end)
    else:
        period = F.lit(None)
    return period.cast("bigint")


def _unit_of(resolution: Column, units: dict[str, int]) -> Column:
    table = F.create_map(*[F.lit(part) for item in units.items() for part in item])
    return F.try_element_at(table, resolution)


def relative_delivery_period_by(
    reference: Column | str, delivery: Column | str, resolution: Column | str, *, delivery_resolution: str = ""
) -> Column:
    """Relative delivery period with the rule picked per row by a resolution column."""
    start, end, chosen = as_column(reference), as_column(delivery), as_column(resolution)
    period = (
        F.when(chosen.isin(list(SECOND_UNITS)), _in_seconds(start, end, _unit_of(chosen, SECOND_UNITS)))
        .when(chosen == "P1W", _in_weeks(start, end))
        .when(chosen == "P1D", _in_days(start, end))
        .when(chosen.isin(list(MONTH_UNITS)), _in_months(start, end, _unit_of(chosen, MONTH_UNITS)))
    )
    for name, kind in GAS_CALENDAR.items():
        if delivery_resolution == kind:
            gas = relative_delivery_period(start, end, name, delivery_resolution=kind)
            period = F.when(chosen == name, gas).otherwise(period)
    return period.cast("bigint")
