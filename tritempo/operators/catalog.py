"""Mapping catalog: flat rows, one per (series, column), in two variants.

``recent`` rows and ``versioned`` rows share the columns of
``sources.layouts.CATALOG`` once ``versioned_rows`` has been applied.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tritempo.constants import IDENTIFIER
from tritempo.functions.catalogcols import derive_source, switchover_group
from tritempo.functions.mapped import MappedColumn, Mapping
from tritempo.operators.joins import lookup_join

#: attributes that belong to the series, not to one of its columns
SERIES_COLUMNS = (
    "series_id", "category", "source", "resolution", "archive_id",
    "versioned_id", "switchover", "split_query", "timezone",
)
#: attributes of one mapped column
COLUMN_COLUMNS = (
    "column_ordinal", "logical", "physical", "data_type", "is_key", "is_projectable",
    "order_priority", "key_ordering", "value_ordering",
)
#: most columns a single mapping may have when it is read to the driver
MAX_MAPPED_COLUMNS = 10_000


def catalog_rows(df: DataFrame) -> DataFrame:
    """Recent catalog rows with their derived source and missing attributes as nulls."""
    rows = df.withColumn("source", derive_source())
    return _uniform(rows)


def versioned_rows(df: DataFrame) -> DataFrame:
    """Versioned catalog rows in the uniform shape.

    A column is a key when it has a key ordering and projectable when it is not
    a key; the series is its own versioned id and may be split.
    """
    is_key = F.col("key_ordering").isNotNull()
    rows = df.withColumns(
        {
            "physical": F.col("logical"),
            "is_key": is_key,
            "is_projectable": ~is_key,
            "split_query": F.lit(True),
            "versioned_id": F.col("series_id"),
            "source": F.lit("versioned"),
        }
    )
    return _uniform(rows)


_TYPES = {
    "resolution": "string", "archive_id": "string", "versioned_id": "bigint", "switchover": "string",
    "split_query": "boolean", "timezone": "string", "order_priority": "int", "key_ordering": "int",
    "value_ordering": "int",
}


def _uniform(df: DataFrame) -> DataFrame:
    def column(name: str):
        return F.col(name) if name in df.columns else F.lit(None).cast(_TYPES[name]).alias(name)

    return df.select(*[column(name) for name in SERIES_COLUMNS + COLUMN_COLUMNS])


def mapping_nest(rows: DataFrame) -> DataFrame:
    """One record per series: scalars of its first column row, and the ordered column list.

    The list is as long as the series has mapped columns, not as it has data.
    """
    scalars = [name for name in SERIES_COLUMNS if name != "series_id"]
    first = F.min_by(F.struct(*scalars), F.col("column_ordinal")).alias("_first")
    columns = F.sort_array(F.collect_list(F.struct(*COLUMN_COLUMNS))).alias("columns")
    nested = rows.groupBy("series_id").agg(first, columns)
    fields = [F.col(f"_first.{name}").alias(name) for name in scalars if name != "split_query"]
    split = F.coalesce(F.col("_first.split_query"), F.lit(True)).alias("split_query")
    return nested.select("series_id", *fields, split, "columns")


def mapping_of(rows: DataFrame, series_id: int) -> Mapping:
    """Column list of one series as plan-time objects; its length is checked."""
    wanted = rows.filter(F.col("series_id") == series_id).select(*COLUMN_COLUMNS)
    found = sorted(wanted.limit(MAX_MAPPED_COLUMNS + 1).collect(), key=lambda row: row["column_ordinal"])
    if len(found) > MAX_MAPPED_COLUMNS:
        raise ValueError(f"series {series_id} maps more than {MAX_MAPPED_COLUMNS} columns")
    if not found:
        raise ValueError(f"the catalog lists no column of series {series_id}")
    return [
        MappedColumn(
            row["logical"], row["physical"] or "", row["data_type"] or "", bool(row["is_key"]),
            bool(row["is_projectable"]), row["order_priority"], row["key_ordering"], row["value_ordering"],
        )
        for row in found
    ]


def mapping_enrich(versioned: DataFrame, originals: DataFrame) -> DataFrame:
    """Versioned rows with the switchover, and the zone where missing, of their original.

    An original belongs to a versioned series by its versioned id, or by its own
    id when it has none; of several originals the first by id counts.
    """
    by_target = (
        originals.groupBy(F.coalesce("versioned_id", "series_id").alias("series_id"))
        .agg(
            F.min_by(
                F.struct(F.lit(True).alias("found"), "switchover", "timezone"),
                F.struct(F.col("series_id"), F.col("column_ordinal")),
            ).alias("_original")
        )
    )
    joined = versioned.join(by_target, "series_id", "left")
    found = F.coalesce(F.col("_original.found"), F.lit(False))
    own_zone = F.nullif(F.col("timezone"), F.lit(""))
    return joined.withColumns(
        {
            "switchover": F.when(found, F.col("_original.switchover")).otherwise(F.col("switchover")),
            "timezone": F.when(found, F.coalesce(own_zone, F.col("_original.timezone"))).otherwise(F.col("timezone")),
        }
    ).select(*versioned.columns)


def force_recent(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"versioned_id": F.lit(None).cast("bigint"), "source": F.lit("recent")})


def _of_group(rows: DataFrame, group: str) -> DataFrame:
    return rows.filter(switchover_group("switchover") == group)


def _taken_from(versioned: DataFrame, targets: DataFrame) -> DataFrame:
    return versioned.join(targets, "series_id", "left_semi")


def resolve_regular(recent: DataFrame, versioned: DataFrame) -> DataFrame:
    """Regular stage.

    Series switched to the versioned layout, and series without a switchover
    that have a versioned id, take their versioned mapping; series switched to
    the recent layout are forced onto it; the others stay as they are.
    """
    group = switchover_group("switchover")
    has_target = F.col("versioned_id").isNotNull()
    moved = recent.filter((group == "versioned") | ((group == "none") & has_target))
    target = F.when(group == "versioned", F.coalesce("versioned_id", "series_id")).otherwise(F.col("series_id"))
    targets = moved.select(target.alias("series_id"))
    resolved = mapping_enrich(_taken_from(versioned, targets), _of_group(recent, "versioned"))
    kept = recent.filter((group == "none") & ~has_target)
    return resolved.unionByName(force_recent(_of_group(recent, "recent"))).unionByName(kept)


def resolve_migration(recent: DataFrame, versioned: DataFrame) -> DataFrame:
    """Migration stage: the mirror image.

    Series switched to the recent layout and series without a switchover take
    their versioned mapping; series switched to the versioned layout stay recent.
    """
    group = switchover_group("switchover")
    target = F.when(group == "recent", F.coalesce("versioned_id", "series_id")).otherwise(F.col("series_id"))
    targets = recent.filter(group != "versioned").select(target.alias("series_id"))
    resolved = mapping_enrich(_taken_from(versioned, targets), _of_group(recent, "recent"))
    return resolved.unionByName(force_recent(_of_group(recent, "versioned")))


def resolve_by_stage(
    recent: DataFrame, versioned: DataFrame, stage: str, *, ids: DataFrame | None = None
) -> DataFrame:
    """Mapping rows of the requested ids (all when None) at a named stage."""
    name = stage.lower()
    if ids is not None:
        wanted = ids.select(F.col(ids.columns[0]).alias("series_id"))
        recent = recent.join(wanted, "series_id", "left_semi")
    if "design" in name or "validation" in name:
        return versioned if ids is None else versioned.join(wanted, "series_id", "left_semi")
    if "migration" in name:
        return resolve_migration(recent, versioned)
    return resolve_regular(recent, versioned)


def series_of(rows: DataFrame) -> DataFrame:
    """One row per series with its scalars, from the first of its column rows."""
    scalars = [name for name in SERIES_COLUMNS if name != "series_id"]
    first = F.min_by(F.struct(*scalars), F.col("column_ordinal")).alias("_first")
    grouped = rows.groupBy("series_id").agg(first)
    return grouped.select("series_id", *[F.col(f"_first.{name}").alias(name) for name in scalars])


def with_mapping(
    df: DataFrame, series: DataFrame, attributes: list[str], *, id_col: str = IDENTIFIER
) -> DataFrame:
    """Data rows with attributes of their series; rows of unmapped series are dropped."""
    lookup = series.select(F.col("series_id").alias(id_col), *attributes)
    return lookup_join(df, lookup, id_col)


def distinct_ids(df: DataFrame, id_col: str = "series_id") -> DataFrame:
    """Every id once."""
    return df.select(F.col(id_col)).distinct()
