"""Stored layouts that are read in part: partitions chosen at run time by a lookup, and buckets that joins don't shuffle.

**Partitions.** The archive is stored by table and quote period. Which of them a request needs follows from its series and
days, which are only known when the lookup has run; Spark then skips the other partitions' files (dynamic pruning). For that the
lookup must be on the small side of a broadcast join on the partition columns. It is measured before it is broadcast; beyond the
bound its distinct partitions - one row for each stored partition at most - are what prunes, and the rows are joined by a shuffle.

**Buckets.** Rows and catalogue stored in the same number of buckets by the series id are joined bucket by bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tritempo.constants import QUOTE_INDEX
from tritempo.functions.catalogcols import archive_table
from tritempo.operators.joins import BROADCAST_ROWS, fits, has_checkpoint_dir, sized, stored

ARCHIVE_TABLE, QUOTE_PERIOD = "archive_table", "quote_period"
#: index digits that a stored period leaves out
PERIODS = {"day": 1, "month": 100, "year": 10_000}


def quote_period(period: str, index: Column | str = QUOTE_INDEX) -> Column:
    """The stored period of a quote-date index: ``yyyymmdd``, ``yyyymm`` or ``yyyy``."""
    value = F.col(index) if isinstance(index, str) else index
    return F.floor(value / F.lit(PERIODS[period])).cast("int")


def write_archive(df: DataFrame, path: str, *, period: str = "day", archive_id: str = "ts_id", mode: str = "errorifexists") -> None:
    """Parquet partitioned by the archive table of the id and the quote period.

    A partition's rows are sorted by id, so that files skip ids by their statistics too. The rebalance hint splits
    a partition that is much larger than the others and joins small ones.
    """
    rows = df.withColumns({ARCHIVE_TABLE: archive_table(archive_id), QUOTE_PERIOD: quote_period(period)})
    rows = rows.hint("rebalance", ARCHIVE_TABLE, QUOTE_PERIOD).sortWithinPartitions(ARCHIVE_TABLE, QUOTE_PERIOD, archive_id)
    rows.write.mode(mode).partitionBy(ARCHIVE_TABLE, QUOTE_PERIOD).parquet(path)


def archive_of(
    archive: DataFrame, wanted: DataFrame, *, period: str = "day", archive_id: str = "ts_id", index: str = QUOTE_INDEX, limit: int = BROADCAST_ROWS
) -> DataFrame:
    """Rows of a stored archive for the (id, quote day) pairs in ``wanted``, read from the partitions that those need.

    Ids without an archive table have no rows. Columns of ``wanted`` beside the two are appended; a pair that is listed twice
    gives its rows twice. A lookup of up to ``limit`` rows is broadcast.
    """
    table, own_id, own_day, own_period = "_table", "_id", "_day", "_period"
    rest = [name for name in wanted.columns if name.lower() not in (archive_id.lower(), index.lower())]
    lookup = wanted.select(
        archive_table(archive_id).alias(table), quote_period(period, index).alias(own_period), F.col(archive_id).alias(own_id), F.col(index).alias(own_day), *rest
    )
    # the condition tells Spark that the lookup selects; it must not hold of the stored rows already, or Spark drops it
    chosen = F.col(own_day) > 0
    same = (F.col(ARCHIVE_TABLE) == F.col(table)) & (F.col(QUOTE_PERIOD) == F.col(own_period))
    if has_checkpoint_dir(archive.sparkSession):
        lookup = stored(lookup)
    if fits(lookup, limit):
        chosen = F.broadcast(lookup.filter(chosen))
    else:
        partitions = sized(lookup.select(table, own_period).distinct(), select=F.col(own_period) > 0)
        archive, chosen = archive.join(partitions, same, "left_semi"), lookup.filter(chosen)
    met = archive.join(chosen, same & (archive[archive_id] == F.col(own_id)) & (archive[index] == F.col(own_day)))
    return met.drop(table, own_id, own_day, own_period)


def write_bucketed(df: DataFrame, name: str, *, buckets: int, id_col: str, path: str | None = None, mode: str = "errorifexists") -> DataFrame:
    """A table in so many buckets by id, each sorted by it; the rows as they are read back.

    Rows are dealt out by the same hash that the buckets use, so every bucket is one file. A series that holds much of the table
    makes a large bucket: leave such tables unbucketed and let the adaptive join split them.
    """
    writer = df.repartition(buckets, id_col).write.mode(mode).bucketBy(buckets, id_col).sortBy(id_col)
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def bucketed_join(rows: DataFrame, catalog: DataFrame, id_col: str, catalog_id: str, how: str = "inner") -> DataFrame:
    """Rows with the catalogue's columns. Where both are bucketed alike by id neither side is shuffled, whatever their sizes.

    The merge hint keeps Spark from broadcasting a catalogue that its estimate takes for small.
    """
    return rows.join(catalog.hint("merge"), rows[id_col] == catalog[catalog_id], how).drop(catalog[catalog_id])


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")
