"""Joins of large row sets with per-series lookups.

A lookup has one row per series (or per group). Planned blindly, such a join
shuffles the large side even if the lookup turns out to be tiny, because its size
is only known once both sides are running. Where the session has a checkpoint
folder, the lookup is therefore computed once, kept there, measured, and
broadcast if its rows and bytes are within bounds. That starts jobs while the
plan is being built, and the lookup is a snapshot from then on. Without such a
folder nothing runs ahead: the join is left to Spark and its adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: most lookup rows and bytes that are broadcast
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20


def has_checkpoint_dir(spark: SparkSession) -> bool:
    """Whether results can be checkpointed: in the context's folder or the one the session names."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return True
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        return False
    context.setCheckpointDir(configured)
    return True


def stored(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared checkpoint folder where there is one."""
    return df.checkpoint() if has_checkpoint_dir(df.sparkSession) else df


def _width(field: T.StructField) -> Column:
    """Bytes of a value, about."""
    value = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 8
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.length(F.to_json(F.struct(value)))
    return F.lit(8)


def fits(df: DataFrame, limit: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether rows and bytes are within the limits; every partition sends two numbers."""
    width = F.lit(8)
    for field in df.schema.fields:
        width = width + _width(field)
    rows, size = df.agg(F.count(F.lit(1)), F.sum(width)).first()
    return rows <= limit and (size or 0) <= most_bytes


def sized(lookup: DataFrame, limit: int = BROADCAST_ROWS, *, select: Column | None = None) -> DataFrame:
    """The lookup, kept and measured where it can be kept, and marked for broadcast if it is small.

    ``select`` is a condition on what was kept, which the plan then shows.
    """
    if not has_checkpoint_dir(lookup.sparkSession):
        return lookup if select is None else lookup.filter(select)
    lookup = stored(lookup)
    found = lookup if select is None else lookup.filter(select)
    return F.broadcast(found) if fits(lookup, limit) else found


def lookup_join(rows: DataFrame, lookup: DataFrame, on, how: str = "inner", *, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a lookup that is broadcast if it is small enough; see above for what runs ahead.

    A condition in ``on`` may only name lookup columns that ``rows`` does not have.
    """
    return rows.join(sized(lookup, limit), on, how)
