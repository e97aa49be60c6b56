"""Orderings. ``orderBy`` range-partitions, so no order needs a single task."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tritempo.constants import DELIVERY_START, IDENTIFIER, REFERENCE_TIME
from tritempo.functions.mapped import Mapping, unique_by


def order_names(mapping: Mapping, *, keep_identifier: bool = True) -> list[str]:
    """Columns with a key ordering or a priority, else ReferenceTime and DeliveryStart."""
    columns = [column for column in mapping if keep_identifier or not column.is_identifier]
    ordered = [c for c in columns if c.order_priority is not None or c.key_ordering is not None]
    if not ordered:
        fallback = (REFERENCE_TIME.lower(), DELIVERY_START.lower())
        ordered = sorted(
            (c for c in columns if c.logical.lower() in fallback), key=lambda c: fallback.index(c.logical.lower())
        )
    ordered = sorted(ordered, key=lambda column: column.rank)
    return [column.output for column in unique_by(ordered, lambda column: column.output)]


def order_names_latest(mapping: Mapping) -> list[str]:
    """Columns by priority alone, else ReferenceTime: the order at the latest reference time."""
    ordered = [column for column in mapping if column.order_priority is not None]
    ordered.sort(key=lambda column: (column.order_priority, column.logical))
    return [column.output for column in unique_by(ordered, lambda c: c.output)] or [REFERENCE_TIME]


def sort_mapped(df: DataFrame, mapping: Mapping) -> DataFrame:
    return df.orderBy(*order_names(mapping))


def sort_versioned(df: DataFrame, mapping: Mapping, *, latest: bool = False, keep_identifier: bool = False) -> DataFrame:
    names = order_names_latest(mapping) if latest else order_names(mapping, keep_identifier=keep_identifier)
    return df.orderBy(*names)


def sort_output(df: DataFrame) -> DataFrame:
    """CSV order; columns the rows do not have take no part.

    The id comes last: series that quote the same times can then be split over tasks.
    """
    return df.orderBy(*[name for name in (REFERENCE_TIME, DELIVERY_START, IDENTIFIER) if name in df.columns])


def sort_aggregated(df: DataFrame, bucket: str = "DeliveryBucket") -> DataFrame:
    return df.orderBy(*[name for name in (REFERENCE_TIME, bucket, IDENTIFIER) if name in df.columns])
