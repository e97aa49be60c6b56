"""Version selection and latest reference time.

Selecting a reference time per series commutes with selecting the newest
version per key, because the reference time is part of the key. The operators
here therefore find the reference time with a map-side-combined aggregate over
two columns, reduce the rows with it, and select versions last, on what is left.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tritempo.constants import CREATED_ON, DELETED, REFERENCE_TIME, VERSIONED_IDENTIFIER
from tritempo.functions.predicates import at, not_deleted
from tritempo.operators.joins import lookup_join

DEFAULT_KEYS = (VERSIONED_IDENTIFIER, REFERENCE_TIME)


def latest_version(
    df: DataFrame,
    keys: tuple[str, ...] = DEFAULT_KEYS,
    *,
    created: str = CREATED_ON,
    tiebreak: tuple[str, ...] = (),
) -> DataFrame:
    """Newest version per key.

    A row number with a bound of one is cut down to one row per key inside every
    map task before the shuffle, so a hot key sends one row per task.
    """
    newest = Window.partitionBy(*keys).orderBy(*[F.col(name).desc() for name in (created, *tiebreak)])
    return df.withColumn("_version", F.row_number().over(newest)).filter("_version = 1").drop("_version")


def version_as_of(
    df: DataFrame,
    as_of: datetime,
    keys: tuple[str, ...] = DEFAULT_KEYS,
    *,
    include_deleted: bool = False,
    created: str = CREATED_ON,
    deleted: str = DELETED,
    tiebreak: tuple[str, ...] = (),
) -> DataFrame:
    """Newest version per key among those created up to ``as_of``.

    A newest version that is deleted hides its key.
    """
    known = df.filter(at(created, "<=", as_of))
    newest = latest_version(known, keys, created=created, tiebreak=tiebreak)
    return newest.filter(not_deleted(include_deleted, field=deleted))


def max_reference_time(
    df: DataFrame, id_col: str, *, reference: str = REFERENCE_TIME, output: str = "MaxReferenceTime"
) -> DataFrame:
    """Largest reference time per series."""
    return df.groupBy(id_col).agg(F.max(reference).alias(output))


def at_max_reference_time(
    df: DataFrame,
    id_col: str = VERSIONED_IDENTIFIER,
    *,
    of: DataFrame | None = None,
    reference: str = REFERENCE_TIME,
) -> DataFrame:
    """Rows of ``df`` at the largest reference time of their series in ``of`` (default: ``df``).

    Where the session has a checkpoint folder, the largest times are computed while
    the plan is built and stay as they were then.
    """
    top = max_reference_time(df if of is None else of, id_col, reference=reference)
    top = top.select(F.col(id_col), F.col("MaxReferenceTime").alias(reference))
    return lookup_join(df, top, [id_col, reference], "left_semi")


def latest_reference_time(
    df: DataFrame,
    keys: tuple[str, ...] = DEFAULT_KEYS,
    *,
    as_of: datetime | None = None,
    include_deleted: bool = False,
    id_col: str = VERSIONED_IDENTIFIER,
    created: str = CREATED_ON,
    deleted: str = DELETED,
    reference: str = REFERENCE_TIME,
    tiebreak: tuple[str, ...] = (),
) -> DataFrame:
    """Latest versions at the newest reference time of each series, optionally as of a version time.

    The newest reference time is taken before deleted rows are dropped.
    """
    known = df if as_of is None else df.filter(at(created, "<=", as_of))
    rows = at_max_reference_time(known, id_col, reference=reference)
    newest = latest_version(rows, keys, created=created, tiebreak=tiebreak)
    return newest.filter(not_deleted(include_deleted, field=deleted))


def latest_before(
    df: DataFrame,
    op: str,
    instant: datetime,
    keys: tuple[str, ...] = DEFAULT_KEYS,
    *,
    as_of: datetime | None = None,
    include_deleted: bool = False,
    id_col: str = VERSIONED_IDENTIFIER,
    created: str = CREATED_ON,
    deleted: str = DELETED,
    reference: str = REFERENCE_TIME,
    tiebreak: tuple[str, ...] = (),
) -> DataFrame:
    """Latest versions at the largest reference time that satisfies ``op instant``, per series.

    Neither the deleted flag nor other filters influence which reference time is picked.
    """
    known = df if as_of is None else df.filter(at(created, "<=", as_of))
    candidates = known.filter(at(reference, op, instant))
    rows = at_max_reference_time(candidates, id_col, reference=reference)
    newest = latest_version(rows, keys, created=created, tiebreak=tiebreak)
    return newest.filter(not_deleted(include_deleted, field=deleted))
