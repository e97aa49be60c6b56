"""Row outputs: CSV and row JSON."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tritempo.constants import (
    CSV_ABSENT,
    CSV_NULL,
    DELIVERY_START_NAMES,
    IDENTIFIER,
    REFERENCE_TIME,
    VERSIONED_IDENTIFIER,
)
from tritempo.functions.mapped import Mapping, output_order
from tritempo.functions.numbers import format_number
from tritempo.functions.timecols import format_timestamp, utc_to_zone
from tritempo.operators.hybrid import unified_header
from tritempo.operators.sort import sort_output
from tritempo.sinks.merged import merge_files

JSON_MODES = ("json", "json_stream", "ndjson")
CSV_MODES = ("csv", "csv_stream")


def includes_offset(mode: str, offset: bool | None = None) -> bool:
    """JSON outputs carry offsets; CSV outputs only when asked to."""
    if mode in JSON_MODES:
        return True
    if mode in CSV_MODES:
        return bool(offset)
    raise ValueError(f"unknown output mode {mode!r}")


def generic_target_zone(
    zone: str | None = None, *, offset: bool | None = None, aggregated: bool = False
) -> str | None:
    """Target zone of a generic request: UTC unless it aggregates, names a zone or wants offsets."""
    if zone:
        return zone
    return None if offset or aggregated else "UTC"


def _utc_time(field: T.StructField) -> Column | None:
    """A time column as UTC wall clock; one with a session zone is moved. None for other columns."""
    value = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.TimestampType):
        return F.convert_timezone(F.current_timezone(), F.lit("UTC"), value.cast("timestamp_ntz"))
    return value if isinstance(field.dataType, T.TimestampNTZType) else None


def to_target_zone(df: DataFrame, zone: Column | str | None) -> DataFrame:
    """Every timestamp column as wall clock of the target zone."""
    times = {field.name: _utc_time(field) for field in df.schema.fields}
    moved = {name: utc_to_zone(value, zone) for name, value in times.items() if value is not None}
    return df.withColumns(moved) if moved else df


def output_value(field: T.StructField, zone: Column | str | None, *, offset: bool) -> Column:
    """A column as JSON shows it: timestamps as text, everything else as it is."""
    instant = _utc_time(field)
    return F.col(f"`{field.name}`") if instant is None else format_timestamp(instant, zone, offset=offset)


def csv_text(field: T.StructField, zone: Column | str | None, *, offset: bool) -> Column:
    """A column as CSV text. A 32-bit number shows its own digits, not those of its 64-bit value."""
    if isinstance(field.dataType, T.FloatType):
        text = format_number(F.col(f"`{field.name}`").cast("string").cast("double"))
    elif isinstance(field.dataType, T.DoubleType):
        text = format_number(f"`{field.name}`")
    else:
        text = output_value(field, zone, offset=offset).cast("string")
    return F.coalesce(text, F.lit(CSV_NULL))


def _csv_columns(df: DataFrame, columns: list[str], zone: Column | str | None, offset: bool) -> list[Column]:
    fields = {field.name.lower(): field for field in df.schema.fields}

    def text(name: str) -> Column:
        field = fields.get(name.lower())
        return (F.lit(CSV_ABSENT) if field is None else csv_text(field, zone, offset=offset)).alias(name)

    return [text(name) for name in columns]


def csv_rows(
    df: DataFrame, columns: list[str] | None = None, *, zone: Column | str | None = None, offset: bool = False
) -> DataFrame:
    """All columns as CSV texts; a null is ``null``, a column the rows do not have is ``N/A``."""
    return df.select(*_csv_columns(df, columns or df.columns, zone, offset))


def mapped_header(*mappings: Mapping) -> list[str]:
    """Header of a request that names no columns: keys and projectable columns of its mappings, each name once."""
    names: dict[str, str] = {}
    for mapping in mappings:
        for column in output_order(mapping):
            if column.is_key or column.is_projectable:
                names.setdefault(column.output.lower(), column.output)
    return list(names.values())


def _sort_keys(df: DataFrame) -> list[Column]:
    """Reference time and delivery start as instants, and the id; null where the rows have none."""
    fields = {field.name: field for field in df.schema.fields}
    start = next((name for name in DELIVERY_START_NAMES if name in fields), None)
    times = [_utc_time(fields[name]) if name in fields else None for name in (REFERENCE_TIME, start)]
    none = F.lit(None)
    keys = [(none if value is None else value).cast("timestamp_ntz") for value in times]
    return [*keys, (F.col(IDENTIFIER) if IDENTIFIER in fields else none).cast("bigint")]


def union_categories(
    *results: DataFrame, zone: Column | str | None = None, offset: bool = False, header: list[str] | None = None,
    ordered: bool = False,
) -> DataFrame:
    """CSV rows of several results under one header.

    ``ordered`` sorts the rows of all results by instant, before times become texts:
    texts of a zone do not sort like instants.
    """
    header = header or unified_header(*results)
    keys = ["_reference", "_start", "_id"]
    parts = [
        result.select(
            *_csv_columns(result, header, zone, offset),
            *([key.alias(name) for key, name in zip(_sort_keys(result), keys, strict=True)] if ordered else []),
        )
        for result in results
    ]
    rows = reduce(DataFrame.unionByName, parts)
    return rows.orderBy(*keys).drop(*keys) if ordered else rows


def _write_texts(texts: DataFrame, path: str, mode: str, *, header: bool = True) -> None:
    texts.write.mode(mode).csv(path, header=header, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False,
                               ignoreTrailingWhiteSpace=False)


def write_csv(
    df: DataFrame,
    path: str,
    columns: list[str] | None = None,
    *,
    zone: Column | str | None = None,
    offset: bool = False,
    ordered: bool = True,
    mode: str = "errorifexists",
) -> None:
    """Write CSV files with a header each; read in file-name order they are in CSV order."""
    rows = sort_output(df) if ordered else df
    _write_texts(csv_rows(rows, columns, zone=zone, offset=offset), path, mode)


def write_csv_file(
    df: DataFrame,
    target: str,
    columns: list[str] | None = None,
    *,
    zone: Column | str | None = None,
    offset: bool = False,
) -> int:
    """Write one CSV file in order, with one header even if there are no rows; how many parts it was put together from.

    Tasks write parts of the sorted rows, see ``merged.merge_files`` for how these become a file.
    """
    texts = csv_rows(sort_output(df), columns, zone=zone, offset=offset)
    folder = f"{target.rstrip('/')}.parts-{uuid.uuid4().hex}"
    _write_texts(texts, folder, "errorifexists", header=False)
    names = [f'"{name.replace(chr(34), chr(34) * 2)}"' if set(name) & set(',"\n\r') else name for name in texts.columns]
    return merge_files(df.sparkSession, folder, target, header=",".join(names), suffix=".csv")


def write_csv_categories(
    results: list[DataFrame], path: str, header: list[str] | None = None, *, zone: Column | str | None = None,
    offset: bool = False, mode: str = "errorifexists",
) -> None:
    """Write several results as one CSV output, in the order of their instants; see ``mapped_header`` for the header."""
    _write_texts(union_categories(*results, zone=zone, offset=offset, header=header, ordered=True), path, mode)


def json_rows(df: DataFrame, *, id_col: str = IDENTIFIER, zone: Column | str | None = None) -> DataFrame:
    """One JSON text per row: the id as a scalar, every other field as a one-element list.

    Fields that are lists already stay as they are; names are in code-point order.
    """
    fields = {field.name: field for field in df.schema.fields if field.name not in (id_col, VERSIONED_IDENTIFIER)}
    values: dict[str, Column] = {IDENTIFIER: F.col(id_col).cast("bigint")}
    for name, field in fields.items():
        value = output_value(field, zone, offset=True)
        values[name] = value if isinstance(field.dataType, T.ArrayType) else F.array(value)
    ordered = [values[name].alias(name) for name in sorted(values)]
    return df.select(F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"}).alias("value"))


def write_json_rows(
    df: DataFrame, path: str, *, id_col: str = IDENTIFIER, zone: Column | str | None = None, mode: str = "errorifexists"
) -> None:
    json_rows(df, id_col=id_col, zone=zone).write.mode(mode).text(path)
