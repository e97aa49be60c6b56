"""Chunked output: column batches per series.

"Streaming" here is output in chunks of at most n rows of one series; there is
no event-time processing in it.

Cutting a series into batches needs the position of each row in its series,
which ``positions.with_positions`` finds by sorted partitions and prefix sums:
no task holds a series, however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tritempo.constants import DEFAULT_BATCH_ROWS, DELIVERY_START, IDENTIFIER, REFERENCE_TIME, VERSIONED_IDENTIFIER
from tritempo.functions.timecols import format_timestamps
from tritempo.operators.positions import with_positions

#: largest batch that may be asked for
MOST_BATCH_ROWS = 1_000_000


def row_positions(df: DataFrame, id_col: str, order: list[str], *, output: str = "_position") -> DataFrame:
    """Rows with their zero-based position in their series by the order columns, nulls first.

    Rows that tie on all of them are put in an order by their other columns, the same in every run.
    """
    return with_positions(df, [id_col], [F.col(name).asc() for name in order], output=output)


def _listed(field: T.StructField, zone: str | None) -> Column:
    values = F.col(f"_rows.{field.name}")
    return format_timestamps(values, zone) if isinstance(field.dataType, T.TimestampNTZType) else values


def column_batches(
    df: DataFrame,
    *,
    id_col: str = IDENTIFIER,
    order: list[str] | None = None,
    size: int = DEFAULT_BATCH_ROWS,
    zone: str | None = None,
) -> DataFrame:
    """Batches of at most ``size`` rows of one series: id, batch number, rows and a list per column.

    Lists keep nulls and follow the order columns; timestamps are texts with offsets.
    """
    if size > MOST_BATCH_ROWS:
        raise ValueError(f"a batch is one value and may have {MOST_BATCH_ROWS} rows at most")
    if size <= 0:
        size = DEFAULT_BATCH_ROWS
    order = order or [name for name in (REFERENCE_TIME, DELIVERY_START) if name in df.columns]
    placed = row_positions(df, id_col, order)
    fields = [field for field in df.schema.fields if field.name not in (id_col, VERSIONED_IDENTIFIER)]
    row = F.struct("_position", *[field.name for field in fields])
    batches = placed.groupBy(
        F.col(id_col).cast("bigint").alias(IDENTIFIER), F.floor(F.col("_position") / size).alias("batch")
    ).agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    lists = [_listed(field, zone).alias(field.name) for field in fields]
    return batches.select(IDENTIFIER, "batch", F.size("_rows").alias("rows"), *lists)


def ndjson_lines(batches: DataFrame) -> DataFrame:
    """One JSON text per batch, names in code-point order."""
    names = sorted(name for name in batches.columns if name not in ("batch", "rows"))
    text = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    return batches.select(IDENTIFIER, "batch", text.alias("value"))


def write_ndjson(
    df: DataFrame,
    path: str,
    *,
    id_col: str = IDENTIFIER,
    order: list[str] | None = None,
    size: int = DEFAULT_BATCH_ROWS,
    zone: str | None = None,
    mode: str = "errorifexists",
) -> None:
    """Write NDJSON column batches; read in file-name order the batches of a series follow each other."""
    lines = ndjson_lines(column_batches(df, id_col=id_col, order=order, size=size, zone=zone))
    lines.orderBy(IDENTIFIER, "batch").select("value").write.mode(mode).text(path)
