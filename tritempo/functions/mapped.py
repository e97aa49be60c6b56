"""Mapped columns: the logical <-> physical column list of a series, and JSON values."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from tritempo.constants import CREATED_ON, FLOAT_TYPES, IDENTIFIER, INTEGER_TYPES, VERSIONED_IDENTIFIER

_NAME = re.compile(r"[a-zA-Z0-9]+")


@dataclass(frozen=True)
class MappedColumn:
    """One column of a mapping: its logical and physical name, type and flags."""

    logical: str
    physical: str = ""
    data_type: str = ""
    is_key: bool = False
    is_projectable: bool = True
    order_priority: int | None = None
    key_ordering: int | None = None
    value_ordering: int | None = None

    @property
    def source(self) -> str:
        return self.physical or self.logical

    @property
    def output(self) -> str:
        return self.logical or self.physical

    @property
    def is_identifier(self) -> bool:
        special = {IDENTIFIER.lower(), VERSIONED_IDENTIFIER.lower()}
        return self.logical.lower() in special or self.physical.lower() in special

    def named(self, name: str) -> bool:
        return name.strip().lower() in (self.logical.lower(), self.physical.lower())

    @property
    def rank(self) -> int:
        """Place in the output: keys, then priorities, then values, then the rest."""
        if self.key_ordering is not None:
            return self.key_ordering
        if self.order_priority is not None:
            return 1000 + self.order_priority
        if self.value_ordering is not None:
            return 2000 + self.value_ordering
        return 3000


Mapping = list[MappedColumn]


def output_order(mapping: Mapping) -> Mapping:
    """Columns in output order; equal ranks go by logical name."""
    return sorted(mapping, key=lambda column: (column.rank, column.logical))


def unique_by(mapping: Mapping, key) -> Mapping:
    """First column of every case-insensitive key, in order."""
    first: dict[str, MappedColumn] = {}
    for column in mapping:
        first.setdefault(key(column).lower(), column)
    return list(first.values())


def _by_name(mapping: Mapping) -> dict[str, MappedColumn]:
    """Columns by both of their names in lower case; the first column of a name counts."""
    named: dict[str, MappedColumn] = {}
    for column in mapping:
        for name in (column.logical, column.physical):
            named.setdefault(name.lower(), column)
    return named


def find(mapping: Mapping, name: str) -> MappedColumn:
    column = _by_name(mapping).get(name.strip().lower())
    if column is None:
        raise ValueError(f"no mapped column is called {name}")
    return column if column.physical else replace(column, physical=column.logical)


def check_requested(mapping: Mapping, requested: list[str], *, versioned: bool) -> list[str]:
    """The names asked for, if they are names of mapped columns; versioned series have their creation time as well."""
    known = _by_name(mapping).keys() | ({CREATED_ON.lower()} if versioned else set())
    odd = [name for name in requested if not _NAME.fullmatch(name)]
    strange = [name for name in requested if name not in odd and name.strip().lower() not in known]
    problems = [f"{what}: {', '.join(names)}" for what, names in (("not a column name", odd), ("not a mapped column", strange)) if names]
    if problems:
        raise ValueError("; ".join(problems))
    return requested


def is_requested(column: MappedColumn, requested: list[str]) -> bool:
    return any(column.named(name) for name in requested)


def json_type(data_type: str) -> str:
    kind = data_type.strip().lower()
    if kind in INTEGER_TYPES:
        return "bigint"
    return "double" if kind in FLOAT_TYPES else "string"


def json_value(payload: Column | str, field: str, data_type: str = "") -> Column:
    """One typed field of a JSON text column; see ``json_values``."""
    return json_values(payload, {field: data_type})[field]


#: up to so many fields are looked up one by one, which reads past the others; beyond, the object is parsed once into a map
FEW_FIELDS = 2


def json_values(payload: Column | str, fields: dict[str, str]) -> dict[str, Column]:
    """Typed fields of a JSON text column.

    Texts that are no JSON objects have no fields. Of a name that an object has more than once
    the first value that isn't null counts, however many fields are asked for.
    """
    document = F.col(payload) if isinstance(payload, str) else payload
    if len(fields) <= FEW_FIELDS:
        found = {name: F.get_json_object(document, f"$['{name}']") for name in fields if "'" not in name}
    else:
        found = {}
    if len(found) < len(fields):
        parsed = F.from_json(document, "map<string,string>", {"allowNonNumericNumbers": "false"})
        there = F.map_filter(parsed, lambda _, value: value.isNotNull())
        found = {name: F.try_element_at(there, F.lit(name)) for name in fields}
    return {name: found[name].cast(json_type(kind)) for name, kind in fields.items()}
