"""What was known at many different times, answered in one job.

Requests and versions are laid on one line per key, by time, and a request takes what the line has shown up to it: the newest
version, or the largest value so far. Versions are never paired with requests.

A line may hold a large part of all rows, so it is cut into spans of time. Within its span a request sees the versions
before it; of every earlier span it needs only what that span ends with, a row per key and span, summed up within the map
tasks. Those few rows are what a window over a whole key reads.

A request of a whole series, which takes the newest version of each of its keys, isn't repeated for the keys. Every version has
a time from which and one up to which it is the newest of its key, and a request meets those of its series that hold its time.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tritempo.constants import CREATED_ON, DELETED, REFERENCE_TIME, VERSIONED_IDENTIFIER
from tritempo.functions.predicates import at as at_time
from tritempo.functions.predicates import not_deleted
from tritempo.functions.timecols import epoch_seconds
from tritempo.operators.ranges import range_join
from tritempo.operators.versions import DEFAULT_KEYS

AS_OF = "AsOf"
#: seconds of a span; choose shorter ones where one key has more rows in a day than a task should hold
SPAN = 86_400


def _running(
    requests: DataFrame, versions: DataFrame, keys: Sequence[str], time: str, created: str, value: Column, tiebreak: Sequence[str], largest: bool, output: str, span: int
) -> DataFrame:
    """Requests with what ``value`` has come to at their time: the last, or the largest so far; null if there is nothing yet."""
    order = [F.col(created).alias("_t"), *(F.col(name).alias(f"_tie{place}") for place, name in enumerate(tiebreak))]
    ties = [f"_tie{place}" for place in range(len(tiebreak))]
    keyed = [F.col(name).alias(f"_key{place}") for place, name in enumerate(keys)]
    own = [f"_key{place}" for place in range(len(keys))]
    place = F.floor(epoch_seconds(F.col("_t")) / span).alias("_span")

    shown = versions.filter(F.col(created).isNotNull()).select(*keyed, *order, value.alias("_value")).select("*", place)
    asked = requests.select(F.struct(*[f"`{name}`" for name in requests.columns]).alias("_request"), *keyed, F.col(time).alias("_t")).select("*", place)
    line = shown.withColumn("_kind", F.lit(0)).unionByName(asked.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    # a version of the very time of a request counts
    before = Window.partitionBy(*own, "_span").orderBy("_t", "_kind", *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summary = F.max("_value") if largest else F.last("_value", ignorenulls=True)
    within = line.withColumn("_within", summary.over(before)).filter("_kind = 1").select("_request", *own, "_span", "_within")

    ends = F.max("_value") if largest else F.max_by("_value", F.struct("_t", *ties))
    ends = shown.groupBy(*own, "_span").agg(ends.alias("_value"))
    spans = ends.unionByName(asked.select(*own, "_span").distinct(), allowMissingColumns=True).groupBy(*own, "_span").agg(F.max("_value").alias("_value"))
    earlier = Window.partitionBy(*own).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.withColumn("_carried", summary.over(earlier)).filter("_carried is not null").select(*own, "_span", "_carried")
    renamed = carried.withColumnsRenamed({name: f"{name}_c" for name in [*own, "_span"]})
    same = within["_span"] == renamed["_span_c"]
    for name in own:
        same = same & within[name].eqNullSafe(renamed[f"{name}_c"])
    met = within.join(renamed, same, "left")
    found = F.greatest("_within", "_carried") if largest else F.coalesce("_within", "_carried")
    return met.select("_request.*", found.alias(output))


def as_of_join(
    requests: DataFrame,
    versions: DataFrame,
    keys: Sequence[str],
    *,
    at: str = AS_OF,
    created: str = CREATED_ON,
    columns: Sequence[str] | None = None,
    tiebreak: Sequence[str] = (),
    how: str = "inner",
    span: int = SPAN,
) -> DataFrame:
    """Requests with the columns of the newest version of their keys that was created up to ``at``.

    Without such a version, or with a null ``at``, a request has nulls with ``how="left"`` and is left out otherwise. Null keys
    are equal. Of versions of one time the largest by ``tiebreak`` counts. Requests may repeat.
    """
    columns = list(columns or [name for name in versions.columns if name not in keys])
    taken = {name.lower() for name in requests.columns} & {name.lower() for name in columns}
    if taken:
        raise ValueError(f"both sides have the columns {sorted(taken)}")
    found = _running(requests, versions, keys, at, created, F.struct(*[f"`{name}`" for name in columns]), tiebreak, False, "_found", span)
    found = found if how == "left" else found.filter("_found is not null")
    return found.select(*[f"`{name}`" for name in requests.columns], "_found.*")


def held_until(
    versions: DataFrame, keys: Sequence[str] = DEFAULT_KEYS, *, created: str = CREATED_ON, tiebreak: Sequence[str] = (), span: int = SPAN, output: str = "_until"
) -> DataFrame:
    """Versions with the time at which the next of their keys was created, null for the last one; versions of no time are left out.

    Null keys are equal. Of versions of one time all but the largest by ``tiebreak`` end when they begin. A window reads a key's versions of a span
    and, as its last row, the time of the first one after it.
    """
    own = [*keys, "_span"]
    dated = versions.filter(F.col(created).isNotNull()).withColumn("_span", F.floor(epoch_seconds(F.col(created)) / span))
    firsts = dated.groupBy(*own).agg(F.min(created).alias("_first"))
    after = F.lead("_first").over(Window.partitionBy(*keys).orderBy("_span"))
    ends = firsts.select(*own, after.alias(created)).filter(F.col(created).isNotNull()).withColumn("_end", F.lit(True))
    line = dated.withColumn("_end", F.lit(False)).unionByName(ends, allowMissingColumns=True)
    upwards = Window.partitionBy(*own).orderBy(created, *tiebreak)
    return line.withColumn(output, F.lead(created).over(upwards)).filter("not _end").drop("_span", "_end")


def _newest_at(
    requests: DataFrame, versions: DataFrame, keys: Sequence[str], shared: Sequence[str], at: str, created: str, columns: Sequence[str] | None, kept: Column, **options
) -> DataFrame:
    """Requests with the newest known version of every key that has their values of the ``shared`` columns, if it is ``kept``."""
    columns = list(columns or [name for name in versions.columns if name not in keys])
    rest = [f"`{name}`" for name in [*[name for name in keys if name not in shared], *columns]]
    held = held_until(versions, keys, created=created, **options).filter(kept)
    held = held.select(*shared, *rest, F.col(created).alias("_from"), "_until")
    met = range_join(requests, held, list(shared), at, first="_from", last="_until", ahead=False)
    return met.select(*shared, *[f"`{name}`" for name in requests.columns if name not in shared], *rest)


def versions_as_of(
    versions: DataFrame,
    requests: DataFrame,
    keys: Sequence[str] = DEFAULT_KEYS,
    *,
    at: str = AS_OF,
    id_col: str = VERSIONED_IDENTIFIER,
    include_deleted: bool = False,
    deleted: str = DELETED,
    created: str = CREATED_ON,
    columns: Sequence[str] | None = None,
    **options,
) -> DataFrame:
    """``version_as_of`` for a table of (id, as of, ...): for every request the newest known version of each key of its series.

    A newest version that is deleted hides its key. Null keys other than the id are equal.
    """
    return _newest_at(requests, versions, keys, [id_col], at, created, columns, not_deleted(include_deleted, field=deleted), **options)


def latest_reference_times_as_of(
    versions: DataFrame,
    requests: DataFrame,
    keys: Sequence[str] = DEFAULT_KEYS,
    *,
    before: tuple[str, datetime] | None = None,
    at: str = AS_OF,
    id_col: str = VERSIONED_IDENTIFIER,
    reference: str = REFERENCE_TIME,
    created: str = CREATED_ON,
    include_deleted: bool = False,
    deleted: str = DELETED,
    span: int = SPAN,
    **options,
) -> DataFrame:
    """``latest_reference_time`` and, with ``before``, ``latest_before`` for a table of (id, as of, ...).

    The largest reference time that a series had by then, found by the largest so far, then the newest version of each key at that time;
    deleted versions count for the former.
    """
    known = versions if before is None else versions.filter(at_time(reference, *before))
    newest = _running(requests, known, [id_col], at, created, F.col(reference), (), True, reference, span).filter(F.col(reference).isNotNull())
    kept = not_deleted(include_deleted, field=deleted)
    if any(name not in (id_col, reference) for name in keys):
        return _newest_at(newest, known, keys, [id_col, reference], at, created, options.pop("columns", None), kept, span=span, **options)
    return as_of_join(newest, known, keys, at=at, created=created, span=span, **options).filter(kept)
