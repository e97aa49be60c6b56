"""Places of rows in the order of their group, and ranks, without a task that holds a group.

**Places.** Rows are range-partitioned and sorted by group and order, and by a hash of all their columns last, so equal rows of the
order are dealt out like any others and a place is the same in every run. A row's number in its partition needs
no window. How many rows of a group each partition has is a small table (a row for each group and partition that has it); its
prefix sums say where a partition's part of the group begins. The sorted rows are kept in the checkpoint folder, as both
the counts and the result read them; without such a folder a window numbers each group.

**Ranks.** Rows with the same values of the order share a rank, so ranks belong to values: the distinct values of a group with
the number of their rows, summed up within the map tasks. Ties of any size are one value. The values are numbered as above,
weighted by their rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tritempo.operators.joins import has_checkpoint_dir, sized, stored

#: bits of a row's number that count within its partition (a fixed value of monotonically_increasing_id)
WITHIN = 33


def _sorted(df: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    keys = [*(F.col(name) for name in group), *order]
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def any_order(df: DataFrame) -> Column:
    """A column that orders rows by nothing in particular, but always in the same way.

    Rows that are equal in all columns are equal here as well, and alike.
    """
    kinds = dict(df.dtypes)
    return F.xxhash64(*[F.to_json(F.col(f"`{name}`")) if "map<" in kinds[name] else F.col(f"`{name}`") for name in df.columns])


def _parts(numbered: DataFrame, group: Sequence[str], weight: Column) -> DataFrame:
    """(group, _part, _base, _before): of each group in each partition the first number, and what stands in earlier partitions."""
    sums = numbered.groupBy(*group, "_part").agg(F.min("_number").alias("_base"), F.sum(weight).alias("_weight"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn("_before", F.coalesce(F.sum("_weight").over(earlier), F.lit(0))).drop("_weight")


def _joined(numbered: DataFrame, parts: DataFrame, group: Sequence[str]) -> DataFrame:
    """Null group values are equal to one another."""
    renamed = {name: f"_own_{place}" for place, name in enumerate(group)}
    parts = sized(parts.withColumnsRenamed({**renamed, "_part": "_own_part"}))
    same = numbered["_part"] == parts["_own_part"]
    for name, own in renamed.items():
        same = same & numbered[name].eqNullSafe(parts[own])
    return numbered.join(parts, same).drop(*renamed.values(), "_own_part")


def with_positions(df: DataFrame, group: Sequence[str], order: Sequence[Column], *, output: str = "_position") -> DataFrame:
    """Rows with their zero-based place in their group by the order; rows that tie in it have a fixed order too.

    Rows that are equal in all columns stay in one partition: the one thing that ranges can't part.
    """
    order = [*order, any_order(df)]
    if not has_checkpoint_dir(df.sparkSession):
        place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
        return df.withColumn(output, (place - 1).cast("bigint"))
    numbered = _sorted(df, group, order).withColumn("_number", F.monotonically_increasing_id())
    numbered = stored(numbered).withColumn("_part", F.shiftright("_number", WITHIN))
    placed = _joined(numbered, _parts(numbered, group, F.lit(1)), group)
    place = F.col("_before") + F.col("_number") - F.col("_base")
    return placed.withColumn(output, place.cast("bigint")).drop("_number", "_part", "_base", "_before")


def value_ranks(df: DataFrame, group: Sequence[str], values: Sequence[str], order: Sequence[Column], *, output: str = "_rank") -> DataFrame:
    """(group, values, rank): the rank of every value of the order in its group, from one, with gaps after ties."""
    counted = df.groupBy(*dict.fromkeys([*group, *values])).agg(F.count(F.lit(1)).alias("_rows"))
    if not has_checkpoint_dir(df.sparkSession):
        before = F.sum("_rows").over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
        return counted.withColumn(output, F.coalesce(before, F.lit(0)) + 1).drop("_rows")
    numbered = _sorted(counted, group, order).withColumn("_number", F.monotonically_increasing_id())
    numbered = stored(numbered).withColumn("_part", F.shiftright("_number", WITHIN))
    # a partition's part of a group is what a task holds
    within = Window.partitionBy(*group, "_part").orderBy("_number").rowsBetween(Window.unboundedPreceding, -1)
    summed = numbered.withColumn("_within", F.coalesce(F.sum("_rows").over(within), F.lit(0)))
    ranked = _joined(summed, _parts(numbered, group, F.col("_rows")), group)
    return ranked.withColumn(output, F.col("_before") + F.col("_within") + 1).drop("_rows", "_number", "_part", "_base", "_before", "_within")
