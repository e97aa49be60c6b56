"""Rank-over filtering: keep rows by their RANK within a group.

A rank with an upper bound of up to ``EARLY_CUT`` is a plain window: Spark cuts every group to the rows that can be within the
bound inside each map task, before the shuffle. Ranks *n and more* are what the ranks before n leave over; up to the same bound
those are found the same way, on the distinct order values.

Any other rank is one of the group's distinct order values (``positions.value_ranks``): these are counted within the map
tasks, so a tie of any size is one value, and numbered by prefix sums over sorted partitions, so no task holds a group. Rows are
then kept by a semi join with the values that lie within the bounds, or an anti join with those ahead where that is the smaller
set of ranks. Nothing follows the join that needs its partitions, so Spark may split a value that very many rows have.
"""

from __future__ import annotations

from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tritempo.constants import IDENTIFIER, VERSIONED_IDENTIFIER
from tritempo.functions.mapped import Mapping
from tritempo.operators.positions import value_ranks

Order = tuple[str, str]
#: up to this rank Spark cuts groups before the shuffle (its own limit for that)
EARLY_CUT = 1000
#: columns that neither group nor order: the group is per series anyway, and the relative period follows from other columns
EXCLUDED = frozenset(name.lower() for name in (IDENTIFIER, VERSIONED_IDENTIFIER, "RelativeDeliveryPeriod"))
DIRECTIONS = {"": False, "asc": False, "desc": True}


class Use(NamedTuple):
    """How a rank uses a column, and what the column must be for that."""

    role: str
    name: str
    needs_key: bool


def rank_problems(mapping: Mapping, partition_by: list[str], order_by: list[Order]) -> list[str]:
    """Everything that is wrong with the columns of a rank, in the order in which they are named."""
    columns = {name.lower(): column for column in mapping for name in (column.logical, column.physical or column.logical)}
    problems = []
    for use in [*(Use("group", name, True) for name in partition_by), *(Use("order", name, False) for name, _ in order_by)]:
        column = columns.get(use.name.lower())
        if use.name.lower() in EXCLUDED:
            problems.append(f"a rank does not {use.role} by {use.name}")
        elif column is None:
            problems.append(f"a rank needs the column {use.name}, which the series does not map")
        elif use.needs_key and not column.is_key:
            problems.append(f"a rank groups by keys; {use.name} is a value")
    return problems


def check_rank_over(mapping: Mapping, partition_by: list[str], order_by: list[Order]) -> None:
    problems = rank_problems(mapping, partition_by, order_by)
    if problems:
        raise ValueError("; ".join(problems))


def _limits(bounds: tuple | None) -> tuple[int, int | None]:
    """``None`` -> rank 1, ``(n,)`` -> exactly n, ``(n, m)`` -> n..m, ``(n, "last")`` -> n and up."""
    low, high = {0: lambda: (1, 1), 1: lambda: (bounds[0], bounds[0])}.get(len(bounds or ()), lambda: bounds)()
    is_open = isinstance(high, str) and high.lower() == "last"
    return int(low), None if is_open else int(high)


def _order(order_by: list[Order]) -> list[Column]:
    unknown = [way for _, way in order_by if way.lower() not in DIRECTIONS]
    if unknown:
        raise ValueError(f"an order goes asc or desc, not {', '.join(unknown)}")
    return [F.col(name).desc() if DIRECTIONS[way.lower()] else F.col(name).asc() for name, way in order_by]


def _first_ranks(df: DataFrame, group: list[str], keys: list[str], order: list[Column], low: int) -> DataFrame:
    """(keys, rank) of the first values of each group, as many as can have a rank below ``low``."""
    window = Window.partitionBy(*group).orderBy(*order)
    values = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    values = values.withColumn("_place", F.row_number().over(window)).filter(F.col("_place") < low)
    before = F.sum("_rows").over(window.rowsBetween(Window.unboundedPreceding, -1))
    return values.select(*keys, (F.coalesce(before, F.lit(0)) + 1).alias("_rank"))


def rank_over(
    df: DataFrame,
    partition_by: list[str],
    order_by: list[Order],
    bounds: tuple | None = None,
    *,
    id_col: str = IDENTIFIER,
    early_cut: int = EARLY_CUT,
) -> DataFrame:
    """Rows whose rank (ties share a rank, gaps follow) lies within the bounds.

    Ranks are per series: the id is always part of the group. Apply other
    filters first.
    """
    if not partition_by or not order_by:
        raise ValueError("a rank needs columns to group by and columns to order by")
    order = _order(order_by)
    low, high = _limits(bounds)
    group = list(dict.fromkeys([id_col, *partition_by]))
    if high is not None and high <= early_cut:
        rank = F.rank().over(Window.partitionBy(*group).orderBy(*order))
        return df.withColumn("_rank", rank).filter(F.col("_rank").between(low, high)).drop("_rank")
    if high is None and low <= 1:
        return df
    names = [name for name, _ in order_by]
    keys = list(dict.fromkeys([*group, *names]))
    ahead = high is None  # what the ranks ahead leave over
    ranked = _first_ranks(df, group, keys, order, low) if ahead and low <= early_cut else value_ranks(df, group, names, order)
    chosen = ranked.filter(F.col("_rank") < low if ahead else F.col("_rank").between(low, high))
    chosen = chosen.select(*[F.col(name).alias(f"_{place}") for place, name in enumerate(keys)])
    match = reduce(and_, [F.col(name).eqNullSafe(F.col(f"_{place}")) for place, name in enumerate(keys)])
    return df.join(chosen, match, "left_anti" if ahead else "left_semi")
