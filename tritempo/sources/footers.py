"""Limits read from Parquet footers.

Smallest and largest values and row counts of a stored table stand in its files' footers. Spark answers an aggregate of
them without reading a column where it is told to push aggregates down: over whole files, or grouped by the columns that
the files are partitioned by. Times without a zone are none of the types that it pushes; a quote-date index is. It grows with the
reference time, so the largest index names the one stored day that holds the newest reference time, and only that
day is read for it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tritempo.constants import QUOTE_INDEX, REFERENCE_TIME
from tritempo.operators.joins import stored

#: types of which footers have limits that Spark uses
LIMITED = ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date")


@contextmanager
def pushed_aggregates(spark: SparkSession) -> Iterator[None]:
    """Within it plans read Parquet by the source that pushes aggregates."""
    wanted = {"spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text", "spark.sql.parquet.aggregatePushdown": "true"}
    before = {name: spark.conf.get(name, None) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def footer_limits(
    spark: SparkSession, path: str, columns: Sequence[str], *, by: Sequence[str] = (), partitioned_by: Sequence[str] | None = None, run: bool = True
) -> DataFrame:
    """(by, min_<column>, max_<column>, n) of a stored table, from its footers.

    ``partitioned_by`` names all columns that the table is partitioned by where ``by`` is only some of them: footers are then
    summed up by all, and those few rows by ``by``. The result is computed at once and kept (a row for each partition at most) unless ``run``
    is false, which gives the plan. Raises where Spark would read columns after all.
    """
    stored_by = list(by if partitioned_by is None else partitioned_by)
    missing = [name for name in by if name not in stored_by]
    if missing:
        raise ValueError(f"the layout has no limits by {', '.join(missing)}")
    with pushed_aggregates(spark):
        rows = spark.read.parquet(path)
        kinds = dict(rows.dtypes)
        unfit = [name for name in columns if kinds.get(name) not in LIMITED]
        if unfit:
            raise ValueError(f"footers give no limits of {', '.join(unfit)}")
        limits = [part.alias(f"{kind}_{name}") for name in columns for kind, part in (("min", F.min(name)), ("max", F.max(name)))]
        found = rows.groupBy(*stored_by).agg(*limits, F.count("*").alias("n"))
        plan = found._jdf.queryExecution().sparkPlan().toString()
        if "PushedAggregation: [" not in plan or "PushedAggregation: []" in plan:
            raise ValueError(f"{path} is not partitioned by {', '.join(stored_by) or 'nothing'}")
        if stored_by != list(by):
            again = [part(f"{kind}_{name}").alias(f"{kind}_{name}") for name in columns for kind, part in (("min", F.min), ("max", F.max))]
            found = found.groupBy(*by).agg(*again, F.sum("n").alias("n"))
        return stored(found) if run else found


def newest_day(spark: SparkSession, path: str, *, index: str = QUOTE_INDEX) -> int | None:
    """The largest quote-date index of a stored table; None if it has none."""
    return footer_limits(spark, path, [index]).first()[f"max_{index}"]


def newest_reference_time(spark: SparkSession, path: str, *, index: str = QUOTE_INDEX, reference: str = REFERENCE_TIME) -> DataFrame:
    """(MaxReferenceTime): a row, from the one day that has it."""
    return at_newest_day(spark, path, index=index).agg(F.max(reference).alias("MaxReferenceTime"))


def at_newest_day(spark: SparkSession, path: str, *, index: str = QUOTE_INDEX) -> DataFrame:
    """Rows of the newest stored day; files of other days are skipped by the same statistics."""
    day = newest_day(spark, path, index=index)
    condition: Column = F.lit(False) if day is None else F.col(index) == day
    return spark.read.parquet(path).filter(condition)


def latest_global_rows(spark: SparkSession, path: str, *, index: str = QUOTE_INDEX, reference: str = REFERENCE_TIME) -> DataFrame:
    """Rows at the newest reference time of the whole table."""
    rows = at_newest_day(spark, path, index=index)
    newest = rows.agg(F.max(reference).alias("_newest"))
    top = newest.first()["_newest"]
    return rows.filter(F.lit(False) if top is None else F.col(reference) == F.lit(top))
