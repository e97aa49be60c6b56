"""Reading and writing the physical layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tritempo.constants import QUOTE_INDEX, VERSIONED_IDENTIFIER
from tritempo.functions.catalogcols import archive_table
from tritempo.functions.mapped import Mapping
from tritempo.functions.timecols import quote_index
from tritempo.operators.ids import with_ids
from tritempo.operators.project import logical_versioned, project_mapped


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Any file layout Spark reads."""
    return spark.read.format(fmt).options(**options).load(path)


def read_wide_column(spark: SparkSession, fmt: str, keyspace: str, table: str, **options: str) -> DataFrame:
    """An archive table behind a wide-column connector on the class path."""
    return spark.read.format(fmt).option("keyspace", keyspace).option("table", table).options(**options).load()


def scan_recent(
    df: DataFrame, mapping: Mapping, ids: list[int] | DataFrame | None = None, *, id_field: str = "series_fid",
    requested: list[str] | None = None,
) -> DataFrame:
    """Rows of the recent layout for the ids, under logical names."""
    rows = df if ids is None else with_ids(df, ids, id_col=id_field)
    return project_mapped(rows, mapping, requested)


def scan_versioned(
    df: DataFrame, mapping: Mapping, ids: list[int] | DataFrame | None = None, *, payload: str = "payload"
) -> DataFrame:
    """Rows of the versioned layout for the ids, with logical keys and typed JSON values."""
    rows = df if ids is None else with_ids(df, ids, id_col=VERSIONED_IDENTIFIER)
    return logical_versioned(rows, mapping, payload)


def scan_catalog(df: DataFrame, ids: list[int] | DataFrame | None = None) -> DataFrame:
    """Mapping rows of the ids."""
    return df if ids is None else with_ids(df, ids, id_col="series_id")


def with_archive_table(df: DataFrame, archive_id: str = "ts_id") -> DataFrame:
    """Archive rows with the table their id belongs to; a filter on it prunes a table partitioned by it."""
    return df.withColumn("archive_table", archive_table(archive_id))


def write_by_quote_index(df: DataFrame, path: str, *, reference: str = "ReferenceTime", mode: str = "errorifexists") -> None:
    """Write parquet partitioned by quote date.

    The rebalance hint puts a day into few files and splits a day that is much
    larger than the others over several tasks.
    """
    rows = df if QUOTE_INDEX in df.columns else df.withColumn(QUOTE_INDEX, quote_index(F.col(reference)))
    rows.hint("rebalance", QUOTE_INDEX).write.mode(mode).partitionBy(QUOTE_INDEX).parquet(path)
