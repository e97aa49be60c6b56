"""Restriction to requested series ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tritempo.constants import IDENTIFIER
from tritempo.operators.joins import lookup_join

#: up to this many ids are written into the predicate, where the scan can use them
INLINE_IDS = 1000


def check_ids(ids: list[int]) -> list[int]:
    """Ids must be positive and unique."""
    if not ids:
        raise ValueError("no identifier given")
    if any(value <= 0 for value in ids):
        raise ValueError("identifiers must be positive")
    if len(set(ids)) != len(ids):
        raise ValueError("identifiers must be unique")
    return ids


def id_table(spark: SparkSession, ids: list[int], id_col: str = IDENTIFIER) -> DataFrame:
    schema = T.StructType([T.StructField(id_col, T.LongType(), False)])
    return spark.createDataFrame([(int(value),) for value in ids], schema)


def with_ids(df: DataFrame, ids: list[int] | DataFrame, *, id_col: str = IDENTIFIER) -> DataFrame:
    """Keep the rows of the requested ids.

    A short list becomes a pushed-down IN; a longer list, or the first column of a
    DataFrame, becomes a semi join.
    """
    if isinstance(ids, DataFrame):
        return lookup_join(df, ids.select(F.col(ids.columns[0]).alias(id_col)).distinct(), id_col, "left_semi")
    if len(check_ids(ids)) <= INLINE_IDS:
        return df.filter(F.col(id_col).isin(ids))
    # Spark knows the size of a list
    return df.join(id_table(df.sparkSession, ids, id_col), id_col, "left_semi")
