"""Projections: select lists built from a mapping at plan time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tritempo.constants import (
    ARCHIVE_CONTRACT,
    CREATED_ON,
    IDENTIFIER,
    REFERENCE_TIME,
    VERSIONED_IDENTIFIER,
)
from tritempo.functions.mapped import (
    MappedColumn,
    Mapping,
    check_requested,
    find,
    is_requested,
    json_values,
    output_order,
    unique_by,
)


def selected_columns(mapping: Mapping, requested: list[str] | None = None) -> Mapping:
    """Keys always; projectable columns if requested or if nothing is; in output order."""
    wanted = requested or []
    chosen = [
        column
        for column in mapping
        if column.is_key or (column.is_projectable and (not wanted or is_requested(column, wanted)))
    ]
    return output_order(chosen)


def project_mapped(df: DataFrame, mapping: Mapping, requested: list[str] | None = None) -> DataFrame:
    """Physical columns of the recent layout under their logical names."""
    check_requested(mapping, requested or [], versioned=False)
    stored = [column for column in mapping if column.physical]
    columns = unique_by(selected_columns(stored, requested), lambda column: column.physical)
    if not columns:
        return df
    return df.select(*[F.col(f"`{column.physical}`").alias(column.output) for column in columns])


def requested_names(
    mapping: Mapping, requested: list[str] | None = None, *, keep_identifier: bool = False
) -> list[str]:
    """Output names of a request.

    Nothing requested: every mapped column. Only CreatedOn: every mapped column
    and CreatedOn. Otherwise: all non-projectable columns, then the requested
    ones. The id is left out unless the output is CSV.
    """
    wanted = [name.strip() for name in requested or []]
    mapped = [column.logical for column in mapping]
    only_created = [name.lower() for name in wanted] == [CREATED_ON.lower()]
    if not wanted or only_created:
        names = mapped + ([CREATED_ON] if only_created else [])
    else:
        known = {name.lower(): name for name in mapped if name} | {CREATED_ON.lower(): CREATED_ON}
        names = [column.logical for column in mapping if not column.is_projectable]
        names += [known[name.lower()] for name in wanted if name.lower() in known]
    hidden = () if keep_identifier else (IDENTIFIER.lower(), VERSIONED_IDENTIFIER.lower())
    unique: dict[str, str] = {}
    for name in names:
        if name and name.lower() not in hidden:
            unique.setdefault(name.lower(), name)
    return list(unique.values())


def project_requested(
    df: DataFrame, mapping: Mapping, requested: list[str] | None = None, *, keep_identifier: bool = False
) -> DataFrame:
    """Logical columns of a request, by the request rule."""
    return df.select(*requested_names(mapping, requested, keep_identifier=keep_identifier))


def _key(column: MappedColumn) -> Column:
    return F.col(f"`{VERSIONED_IDENTIFIER if column.is_identifier else column.source}`")


def logical_versioned(df: DataFrame, mapping: Mapping, payload: str) -> DataFrame:
    """All rows with logical keys, typed JSON values and the version columns still attached."""
    values = unique_by([column for column in mapping if not column.is_key], lambda column: column.output)
    extracted = json_values(payload, {column.output: column.data_type for column in values})
    keys = {column.output: _key(column) for column in mapping if column.is_key}
    return df.withColumns({name: value for name, value in {**keys, **extracted}.items()})


def project_versioned(
    df: DataFrame,
    mapping: Mapping,
    payload: str,
    requested: list[str] | None = None,
    *,
    keep_identifier: bool = False,
) -> DataFrame:
    """Keys from columns, values from the JSON text, CreatedOn last when requested."""
    wanted = check_requested(mapping, requested or [], versioned=True)
    columns = [c for c in selected_columns(mapping, wanted) if keep_identifier or not c.is_identifier]
    columns = unique_by(columns, lambda column: column.output)
    values = json_values(payload, {c.output: c.data_type for c in columns if not c.is_key})
    output = [(_key(c) if c.is_key else values[c.output]).alias(c.output) for c in columns]
    if any(name.lower() == CREATED_ON.lower() for name in wanted):
        output.append(F.col(CREATED_ON))
    return df.select(*output)


def project_latest_timeseries(
    df: DataFrame,
    mapping: Mapping,
    payload: str,
    requested: list[str] | None = None,
    *,
    keep_identifier: bool = False,
) -> DataFrame:
    """Keys and positional values ``Property0..n`` of a time series at its latest reference time.

    Without a mapped value column the JSON field ``Value`` is used. Requesting
    CreatedOn keeps every value.
    """
    wanted = check_requested(mapping, requested or [], versioned=True)
    asks_created = any(name.lower() == CREATED_ON.lower() for name in wanted)
    keys = [c for c in mapping if c.is_key and (keep_identifier or not c.is_identifier)]
    keys.sort(key=lambda column: column.rank)
    reserved = (IDENTIFIER.lower(), REFERENCE_TIME.lower())
    values = [c for c in mapping if not c.is_key and c.is_projectable and c.logical.lower() not in reserved]
    if wanted and not asks_created:
        values = [c for c in values if is_requested(c, wanted)]
    values = sorted(values or [MappedColumn("Value", "Value")], key=lambda column: column.rank)
    extracted = json_values(payload, {c.output: c.data_type for c in values})
    output = [_key(c).alias(IDENTIFIER if c.is_identifier else c.source) for c in keys] or [F.col(REFERENCE_TIME)]
    output += [extracted[c.output].alias(f"Property{place}") for place, c in enumerate(values)]
    if asks_created:
        output.append(F.col(CREATED_ON))
    return df.select(*output)


def project_aggregated(df: DataFrame, requested: list[str] | None = None) -> DataFrame:
    """Columns of an aggregate result, all of them or the requested ones."""
    wanted = {name.strip().lower() for name in requested or []}
    return df.select(*[name for name in df.columns if not wanted or name.lower() in wanted])


def archive_contract_columns(df: DataFrame, requested: list[str] | None = None) -> DataFrame:
    """Requested columns first, then whatever is missing of the archive contract."""
    names = list(requested or [])
    present = {name.lower() for name in names}
    names += [name for name in ARCHIVE_CONTRACT if name.lower() not in present]
    available = {name.lower(): name for name in df.columns}
    return df.select(*[available[name.lower()] for name in names if name.lower() in available])


def column_named(mapping: Mapping, name: str) -> str:
    """Logical name of a mapped column."""
    return find(mapping, name).output
