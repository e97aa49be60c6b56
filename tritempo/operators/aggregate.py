"""Aggregation into period buckets, and per-series limits."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tritempo.constants import DELIVERY_END, DELIVERY_START, IDENTIFIER, REFERENCE_TIME
from tritempo.functions.buckets import bucket_start, bucket_unit
from tritempo.functions.mapped import Mapping

FUNCTIONS = {"AVG": F.avg, "SUM": F.sum, "MIN": F.min, "MAX": F.max, "COUNT": F.count}
#: names that a result column may have
_PLAIN = re.compile(r"[a-zA-Z0-9]+")

#: ``(function, column or "*", alias)``
Value = tuple[str, str, str]


def aggregation_problems(values: Sequence[Value], bucket_alias: str, mapping: Mapping | None = None) -> list[str]:
    """Everything that is wrong with the values of an aggregation: each rule names the values that break it."""
    keys = {name.lower(): column.is_key for column in mapping or () for name in (column.logical, column.physical or column.logical)}
    uses = Counter([bucket_alias.lower(), *(alias.lower() for _, _, alias in values)])
    rules = {
        "no such function of a column": lambda name, column, alias: name.upper() not in FUNCTIONS or (column == "*" and name.upper() != "COUNT"),
        "result names have letters and digits only": lambda name, column, alias: not _PLAIN.fullmatch(alias),
        "result names occur once": lambda name, column, alias: uses[alias.lower()] > 1,
        "values are columns that the series maps": lambda name, column, alias: mapping is not None and column != "*" and column.lower() not in keys,
        "keys are not values": lambda name, column, alias: keys.get(column.lower(), False),
    }
    broken = {rule: [f"{name}({column}) as {alias}" for name, column, alias in values if breaks(name, column, alias)] for rule, breaks in rules.items()}
    return [f"{rule}: {', '.join(named)}" for rule, named in broken.items() if named] + ([] if values else ["an aggregation has at least one value"])


def check_aggregation(values: Sequence[Value], bucket_alias: str, mapping: Mapping | None = None) -> None:
    problems = aggregation_problems(values, bucket_alias, mapping)
    if problems:
        raise ValueError("; ".join(problems))


def _value(function: str, column: str, alias: str) -> Column:
    argument = F.lit(1) if column == "*" else F.col(column)
    return FUNCTIONS[function.upper()](argument).alias(alias)


def aggregate_delivery(
    df: DataFrame,
    period: str,
    values: Sequence[Value],
    *,
    alias: str = "DeliveryBucket",
    bucket_of: str = DELIVERY_START,
    zone: str | None = None,
    week_start: str = "sunday",
    group_by: Sequence[str] = (),
    id_col: str = IDENTIFIER,
    versioned: bool = False,
    mapping: Mapping | None = None,
) -> DataFrame:
    """Aggregate per series, reference time and period bucket.

    Next to the bucket and the values the result carries the series id, the
    smallest reference time and delivery start, the largest delivery end and the
    two empty contract columns. Bucketing ``ReferenceTime`` replaces the
    reference time in the output; ``group_by`` adds plain key columns.
    """
    check_aggregation(values, alias, mapping)
    bucket_unit(period)
    bucket = bucket_start(F.col(bucket_of), period, zone, week_start=week_start)
    keys = [F.col(id_col).alias(IDENTIFIER), F.col(REFERENCE_TIME).alias("_reference"), bucket.alias("_bucket")]
    keys += [F.col(name) for name in group_by]
    carried = [
        F.min(REFERENCE_TIME).alias("_first_reference"),
        F.min(DELIVERY_START).alias(DELIVERY_START),
        F.max(DELIVERY_END).alias(DELIVERY_END),
    ]
    grouped = df.groupBy(*keys).agg(*carried, *[_value(*value) for value in values])

    buckets_reference = bucket_of == REFERENCE_TIME
    output = [
        F.col(IDENTIFIER),
        F.col("_bucket" if buckets_reference else "_first_reference").alias(REFERENCE_TIME),
        F.col(DELIVERY_START),
        F.col(DELIVERY_END),
        F.lit(None).cast("bigint").alias("RelativeDeliveryPeriod"),
    ]
    if not versioned:
        output.append(F.lit(None).cast("bigint").alias("LegacyDeliveryBucketNumber"))
    if not (buckets_reference and alias == REFERENCE_TIME):
        output.append(F.col("_bucket").alias(alias))
    output += [F.col(name) for name in group_by]
    output += [F.col(name) for _, _, name in values]
    return grouped.select(*output)


def filter_limits(df: DataFrame, *, id_col: str = IDENTIFIER, delivery: str = DELIVERY_START) -> DataFrame:
    """Smallest and largest reference time and delivery start per series."""
    return df.groupBy(id_col).agg(
        F.min(REFERENCE_TIME).alias("MinReferenceTime"),
        F.max(REFERENCE_TIME).alias("MaxReferenceTime"),
        F.min(delivery).alias("MinDeliveryStart"),
        F.max(delivery).alias("MaxDeliveryStart"),
    )
