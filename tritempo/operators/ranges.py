"""Joins of rows with ranges that differ from series to series.

A range covers instants from ``first`` up to, not including, ``last``; an end that is null is open. A row meets a range of its own key
that holds its instant. A plain join on the key would pair every row of a series with every range of it before it compares
instants, which for a series with many of both is far more than what meets.

Every range therefore has a level, the smallest whose bins are as wide as the range, so it touches two bins at most. Rows
are repeated once for every level that occurs (a handful: widths of neighbouring levels differ by a factor of 16), and the join
is one on equal key, level and bin; only then are instants compared. Ranges that are open at an end are
in a level of their own that has a single bin. The ranges are broadcast if they are measured to be small; otherwise the
join shuffles by key, level and bin, so a series with very many rows is spread over its bins.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tritempo.constants import DEFAULT_SERIES_ZONE
from tritempo.functions.catalogcols import series_zone
from tritempo.functions.timecols import epoch_seconds, utc_to_zone
from tritempo.operators.joins import has_checkpoint_dir, sized, stored

#: bins of level n are STEP ** n seconds wide
STEP, LEVELS = 16, 10
OPEN = -1


def _levels() -> list[int]:
    return [STEP**level for level in range(LEVELS)]


def _level(first: Column, last: Column) -> Column:
    """The smallest level whose bins are as wide as the range; ``OPEN`` without both ends."""
    width = last - first
    cases = F.when(width.isNull(), F.lit(OPEN))
    for level, size in enumerate(_levels()):
        cases = cases.when(width <= size, F.lit(level))
    return cases.otherwise(F.lit(OPEN))


def _bin(second: Column, level: int) -> Column:
    return F.lit(0).cast("bigint") if level == OPEN else F.floor(second / F.lit(_levels()[level])).cast("bigint")


def range_join(
    rows: DataFrame,
    ranges: DataFrame,
    keys: list[str],
    instant: Column | str,
    *,
    first: str = "first",
    last: str = "last",
    ahead: bool = True,
) -> DataFrame:
    """Rows with the columns of every range of their key that holds their instant.

    ``instant``, ``first`` and ``last`` are times without a zone. Rows with a null instant or key meet nothing, nor does an
    empty range anything. Columns of ``ranges`` other than the keys must not be columns of ``rows``. Ranges that are as many as
    the rows of a large table are neither kept nor measured with ``ahead=False``; rows are then repeated for every level there is.
    """
    shared = {name.lower() for name in rows.columns} & ({name.lower() for name in ranges.columns} - {key.lower() for key in keys})
    if shared:
        raise ValueError(f"both sides have the columns {sorted(shared)}")
    start, end = epoch_seconds(F.col(first)), epoch_seconds(F.col(last))
    held = ranges.filter(F.coalesce(F.col(first) < F.col(last), F.lit(True)))
    held = held.withColumn("_level", _level(start, end))
    ahead = ahead and has_checkpoint_dir(rows.sparkSession)
    if ahead:
        held = stored(held)
        levels = sorted(row["_level"] for row in held.select("_level").distinct().collect())
    else:
        levels = [OPEN, *range(LEVELS)]
    if not levels:
        return rows.join(ranges, keys).limit(0)
    low = F.coalesce(*[F.when(F.col("_level") == level, _bin(start, level)) for level in levels])
    high = F.coalesce(*[F.when(F.col("_level") == level, _bin(end, level)) for level in levels])
    held = held.withColumn("_bin", F.explode(F.sequence(low, high)))

    time = F.col(instant) if isinstance(instant, str) else instant
    second = epoch_seconds(F.col("_instant"))
    places = F.array(*[F.struct(F.lit(level).alias("_level"), _bin(second, level).alias("_bin")) for level in levels])
    dated = rows.withColumn("_instant", time).filter("_instant is not null")
    placed = dated.withColumn("_place", F.explode(places)).select("*", "_place.*").drop("_place")
    met = placed.join(sized(held) if ahead else held, [*keys, "_level", "_bin"])
    within = F.coalesce(F.col("_instant") >= F.col(first), F.lit(True)) & F.coalesce(F.col("_instant") < F.col(last), F.lit(True))
    return met.filter(within).drop("_level", "_bin", "_instant")


def _delivery_clock() -> Column:
    """The stored wall clock at which delivery starts, by the hour."""
    return F.make_timestamp_ntz(F.col("del_y"), F.col("del_m"), F.col("del_d"), F.col("del_h"), F.lit(0), F.lit(0))


def _quote_clock() -> Column:
    return F.make_timestamp_ntz(F.col("qte_y"), F.col("qte_m"), F.col("qte_d"), F.lit(0), F.lit(0), F.lit(0))


def _hour_in(instant: str, zone: Column) -> Column:
    return F.date_trunc("hour", utc_to_zone(F.col(instant), zone)).cast("timestamp_ntz")


def delivery_windows(archive: DataFrame, windows: DataFrame, *, key: str = "ts_id", default_zone: str = DEFAULT_SERIES_ZONE) -> DataFrame:
    """Archive rows in the delivery windows of their series.

    ``windows`` has a row per window: the key, ``first`` and ``last`` as UTC instants (first included, last not; null is open) and
    ``timezone``, the zone whose clock the series stores. Where it has ``least_hours`` or ``most_hours``, the hours from
    the quote date to delivery are bounded too, both included. A row in two windows of its series comes back for each;
    the columns of the window are appended.
    """
    zone = series_zone("timezone") if default_zone == DEFAULT_SERIES_ZONE else F.coalesce("timezone", F.lit(default_zone))
    own = windows.withColumns({"_first": _hour_in("first", zone), "_last": _hour_in("last", zone)})
    met = range_join(archive, own, [key], _delivery_clock(), first="_first", last="_last").drop("_first", "_last")
    hours = F.datediff(_delivery_clock().cast("date"), _quote_clock().cast("date")) * 24 + F.col("del_h")
    bounds = [hours >= F.col("least_hours")] if "least_hours" in windows.columns else []
    bounds += [hours <= F.col("most_hours")] if "most_hours" in windows.columns else []
    return met.filter(reduce(and_, [F.coalesce(bound, F.lit(True)) for bound in bounds])) if bounds else met


def quote_windows(archive: DataFrame, windows: DataFrame, *, key: str = "ts_id", default_zone: str = DEFAULT_SERIES_ZONE) -> DataFrame:
    """Archive rows whose quote day begins in the windows of their series; ``windows`` as for ``delivery_windows``.

    A quote day begins at midnight of the series' own zone.
    """
    zone = series_zone("timezone") if default_zone == DEFAULT_SERIES_ZONE else F.coalesce("timezone", F.lit(default_zone))
    own = windows.withColumns({"_first": utc_to_zone(F.col("first"), zone), "_last": utc_to_zone(F.col("last"), zone)})
    return range_join(archive, own, [key], _quote_clock(), first="_first", last="_last").drop("_first", "_last")
