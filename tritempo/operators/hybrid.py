"""Unions of archive, recent and per-category rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tritempo.constants import IDENTIFIER, REFERENCE_TIME
from tritempo.operators.joins import sized
from tritempo.operators.versions import at_max_reference_time, max_reference_time


def watermarks(recent: DataFrame, *, id_col: str = IDENTIFIER) -> DataFrame:
    """Newest reference time the recent layout has, per series."""
    return max_reference_time(recent, id_col, output="Watermark")


def latest_global(df: DataFrame, *, id_col: str = IDENTIFIER) -> DataFrame:
    """Rows at the watermark of their series."""
    return at_max_reference_time(df, id_col)


def _only_eligible(marks: DataFrame, series: DataFrame, id_col: str) -> DataFrame:
    """Watermarks of the series that may be split.

    A series that may not be split but has an archive id has no watermark, so the
    archive alone answers it; for one without an archive id the watermark lies
    before all times, so the recent layout does.
    """
    known = series.select(
        F.col("series_id").alias(id_col),
        (F.trim(F.coalesce("archive_id", F.lit(""))) != "").alias("_archived"),
        F.coalesce("split_query", F.lit(True)).alias("_split"),
    )
    every = marks.join(known, id_col, "full")
    mark = F.when(~F.col("_archived"), F.expr("TIMESTAMP_NTZ '0001-01-01 00:00:00'")).when(
        F.coalesce("_split", F.lit(True)), F.col("Watermark")
    )
    return every.select(id_col, mark.alias("Watermark")).filter("Watermark is not null")


def hybrid_union(
    archive: DataFrame, recent: DataFrame, marks: DataFrame | None = None, *, series: DataFrame | None = None,
    id_col: str = IDENTIFIER,
) -> DataFrame:
    """Archive rows before the watermark of their series and recent rows from it on.

    Series without a watermark are answered by the archive alone. ``series``
    (``catalog.series_of``) names those that may be split; without it all may.
    Filters put on the result reach both sides. Where the session has a
    checkpoint folder, watermarks are computed while the plan is built; callers
    that have them at hand pass ``marks``.
    """
    marks = watermarks(recent, id_col=id_col) if marks is None else marks
    if series is not None:
        marks = _only_eligible(marks, series, id_col)
    marks = sized(marks.select(F.col(id_col), F.col("Watermark").alias("_mark")))
    older = (
        archive.join(marks, id_col, "left")
        .filter(F.col("_mark").isNull() | (F.col(REFERENCE_TIME) < F.col("_mark")))
        .drop("_mark")
    )
    newer = recent.join(marks, id_col).filter(F.col(REFERENCE_TIME) >= F.col("_mark")).drop("_mark")
    return older.unionByName(newer, allowMissingColumns=True)


def union_requests(*results: DataFrame) -> DataFrame:
    """All rows of all results; a column a result lacks is null there."""
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), results)


def unified_header(*results: DataFrame) -> list[str]:
    """Column names of several results in first-seen order, ignoring case."""
    names: dict[str, str] = {}
    for result in results:
        for name in result.columns:
            names.setdefault(name.lower(), name)
    return list(names.values())
