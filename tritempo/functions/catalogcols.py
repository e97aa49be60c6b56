"""Column functions over mapping-catalog rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tritempo.constants import (
    ARCHIVE_ROUTABLE_ZONES,
    ARCHIVE_TABLES,
    CATEGORY_SPELLINGS,
    DEFAULT_SERIES_ZONE,
    SWITCHOVER_RECENT_PREFIX,
    SWITCHOVER_VERSIONED_PREFIX,
    ZONE_ALIASES,
)
from tritempo.functions.timecols import as_column


def _text(column: Column | str) -> Column:
    return F.coalesce(as_column(column), F.lit(""))


def _starts(column: Column | str, prefix: str) -> Column:
    return F.startswith(F.lower(_text(column)), F.lit(prefix.lower()))


def normalize_category(column: Column | str, fallback: Column | str | None = None) -> Column:
    """Category name from its spellings in any case, else the fallback."""
    word = F.lower(as_column(column))
    result = fallback if isinstance(fallback, Column) else F.lit(fallback).cast("string")
    for category, spellings in CATEGORY_SPELLINGS.items():
        result = F.when(word.isin(list(spellings)), F.lit(category)).otherwise(result)
    return result


def switchover_group(
    switchover: Column | str = "switchover",
    *,
    versioned_prefix: str = SWITCHOVER_VERSIONED_PREFIX,
    recent_prefix: str = SWITCHOVER_RECENT_PREFIX,
) -> Column:
    """``versioned``, ``recent`` or ``none`` from the prefix of the switchover text."""
    return (
        F.when(_starts(switchover, versioned_prefix), F.lit("versioned"))
        .when(_starts(switchover, recent_prefix), F.lit("recent"))
        .otherwise(F.lit("none"))
    )


def derive_source(
    versioned_id: Column | str = "versioned_id",
    switchover: Column | str = "switchover",
    archive_id: Column | str = "archive_id",
    *,
    versioned_prefix: str = SWITCHOVER_VERSIONED_PREFIX,
) -> Column:
    """Layout a series lives in: versioned, archive or recent."""
    return (
        F.when(as_column(versioned_id).isNotNull() | _starts(switchover, versioned_prefix), F.lit("versioned"))
        .when(_text(archive_id) != "", F.lit("archive"))
        .otherwise(F.lit("recent"))
    )


def series_zone(timezone: Column | str = "timezone", default: str = DEFAULT_SERIES_ZONE) -> Column:
    """Zone of a series, with a default where the catalog has none."""
    trimmed = F.trim(_text(timezone))
    result = F.when(trimmed == "", F.lit(default))
    for alias, zone in ZONE_ALIASES.items():
        if alias:
            result = result.when(F.lower(trimmed) == alias, F.lit(zone))
    return result.otherwise(trimmed)


def archive_table(archive_id: Column | str = "archive_id", tables: Iterable[tuple[str, str]] = ARCHIVE_TABLES) -> Column:
    """Archive table by the first token found in the archive id; null when none is."""
    word = F.lower(F.trim(_text(archive_id)))
    result = F.lit(None).cast("string")
    for token, table in reversed(list(tables)):
        result = F.when(F.contains(word, F.lit(token.lower())), F.lit(table)).otherwise(result)
    return result


def route_source(
    *,
    source: Column | str = "source",
    versioned_id: Column | str = "versioned_id",
    archive_id: Column | str = "archive_id",
    timezone: Column | str = "timezone",
    series_id: Column | str = "series_id",
    shape: bool = False,
    aggregation: bool = False,
    rank_over: bool = False,
    recent_only_ids: Iterable[int] = (),
) -> Column:
    """Layout that answers a request for a series, per catalog row.

    A source named ``external`` is passed through; versioned series stay
    versioned; requests the archive cannot answer go to the recent layout.
    """
    kind = as_column(source)
    needs_recent = F.lit(shape or aggregation or rank_over) | (kind == "recent") | (F.trim(_text(archive_id)) == "")
    needs_recent = needs_recent | ~F.lower(F.trim(_text(timezone))).isin(list(ARCHIVE_ROUTABLE_ZONES))
    pinned = list(recent_only_ids)
    if pinned:
        needs_recent = needs_recent | as_column(series_id).isin(pinned)
    return (
        F.when(kind == "external", F.lit("external"))
        .when(as_column(versioned_id).isNotNull() | (kind == "versioned"), F.lit("versioned"))
        .when(needs_recent, F.lit("recent"))
        .otherwise(F.lit("archive"))
    )
