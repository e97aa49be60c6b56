import random
from datetime import datetime as dt, timedelta

import pytest
from conftest import partition_sizes
from pyspark.sql import functions as F

from tritempo.functions.mapped import MappedColumn
from tritempo.operators import versions as v
from tritempo.operators.rank import check_rank_over, rank_over
from tritempo.plans import fixtures as fx

KEYS = ("MdoId", "ReferenceTime")
SCHEMA = "MdoId long, ReferenceTime timestamp_ntz, CreatedOn timestamp_ntz, Deleted boolean, Value double"
DAY1, DAY2 = dt(2024, 1, 1), dt(2024, 1, 2)


@pytest.fixture
def versions(spark):
    return spark.createDataFrame([
        (1, DAY1, dt(2024, 1, 3), False, 1.0),
        (1, DAY1, dt(2024, 1, 4), False, 2.0),
        (1, DAY2, dt(2024, 1, 3), False, 3.0),
        (1, DAY2, dt(2024, 1, 5), True, 4.0),
        (2, DAY1, dt(2024, 1, 3), False, 5.0),
    ], SCHEMA)


def values(df):
    return sorted(row.Value for row in df.collect())


def test_versions(versions):
    assert values(v.latest_version(versions)) == [2.0, 4.0, 5.0]
    assert values(v.version_as_of(versions, dt(2024, 1, 3))) == [1.0, 3.0, 5.0]
    # a deleted newest version hides its key
    assert values(v.version_as_of(versions, dt(2030, 1, 1))) == [2.0, 5.0]
    assert values(v.version_as_of(versions, dt(2030, 1, 1), include_deleted=True)) == [2.0, 4.0, 5.0]
    assert values(v.version_as_of(versions, dt(2020, 1, 1))) == []


def test_latest_reference_time_ignores_the_deleted_flag(versions):
    assert values(v.latest_reference_time(versions)) == [5.0]
    assert values(v.latest_reference_time(versions, include_deleted=True)) == [4.0, 5.0]
    assert values(v.latest_reference_time(versions, as_of=dt(2024, 1, 4))) == [3.0, 5.0]
    assert values(v.latest_before(versions, "<", DAY2)) == [2.0, 5.0]
    assert values(v.latest_before(versions, "<=", DAY2)) == [5.0]
    assert values(v.latest_before(versions, "<=", DAY2, as_of=dt(2024, 1, 3))) == [3.0, 5.0]
    assert values(v.latest_before(versions, ">", DAY2)) == []


def test_as_of_the_far_future_is_the_latest_version(spark, sf):
    rows = fx.versions(spark, sf)
    newest = v.latest_version(rows, KEYS, tiebreak=("event_id",))
    far = v.version_as_of(rows, dt(2100, 1, 1), KEYS, include_deleted=True, tiebreak=("event_id",))
    assert newest.count() > 0 and newest.exceptAll(far).isEmpty() and far.exceptAll(newest).isEmpty()


def test_version_selection_is_cut_before_the_shuffle(spark, sf, physical_plan):
    text = physical_plan(v.latest_version(fx.versions(spark, sf), KEYS, tiebreak=("event_id",)))
    assert text.index("Final") < text.index("Exchange hashpartitioning") < text.index("Partial")


# --- rank ----------------------------------------------------------------

@pytest.fixture
def points(spark):
    """One series and one group hold most rows; order values tie and are missing."""
    generator = random.Random(11)
    data = []
    for n in range(1500):
        series = 1 if n % 3 else generator.randrange(2, 9)
        day = DAY1 + timedelta(days=generator.randrange(4)) if n % 50 else None
        price = float(generator.randrange(25)) if n % 40 else None
        data.append((n, series, day, price, generator.choice("ab")))
    return spark.createDataFrame(data, "n int, Identifier long, ReferenceTime timestamp_ntz, Price double, Side string")


def expected_ranks(rows, group, order):
    """Row number -> rank, by sorting each group; missing values are smallest."""
    def key(row):
        return tuple((0, 0) if row[name] is None else (1, row[name]) for name, _ in order)

    ranks = {}
    groups = {}
    for row in rows:
        groups.setdefault(tuple(row[name] for name in group), []).append(row)
    for members in groups.values():
        for name, way in reversed(order):
            members.sort(key=lambda row, name=name: (0, 0) if row[name] is None else (1, row[name]), reverse=way == "desc")
        previous, rank = None, 0
        for place, row in enumerate(members, 1):
            if key(row) != previous:
                previous, rank = key(row), place
            ranks[row.n] = rank
    return ranks


ORDERS = [
    [("Price", "desc")],
    [("Price", "asc")],
    [("Price", "desc"), ("Side", "asc")],
    [("Side", ""), ("Price", "desc")],
]


@pytest.mark.parametrize("early_cut", [1000, 0])
@pytest.mark.parametrize("order", ORDERS)
@pytest.mark.parametrize("bounds, keep", [
    (None, lambda r: r == 1), ((7,), lambda r: r == 7), ((2, 40), lambda r: 2 <= r <= 40),
    ((3, "last"), lambda r: r >= 3), ((1, "last"), lambda r: True),
])
def test_rank_over_equals_sorting(points, order, bounds, keep, early_cut):
    rows = points.collect()
    ranks = expected_ranks(rows, ["Identifier", "ReferenceTime"], [(n, w or "asc") for n, w in order])
    found = {row.n for row in rank_over(points, ["ReferenceTime"], order, bounds, early_cut=early_cut).collect()}
    assert found == {n for n, rank in ranks.items() if keep(rank)}


@pytest.mark.parametrize("bounds, keep", [
    ((1500, 3000), lambda r: 1500 <= r <= 3000), ((2500, "last"), lambda r: r >= 2500), ((4001,), lambda r: r == 4001),
])
def test_high_ranks(spark, bounds, keep):
    rows = spark.range(6000).select(
        F.lit(1).cast("bigint").alias("Identifier"), F.lit(0).alias("Group"), (F.col("id") * 7919 % 6007).alias("Price"),
        F.col("id").cast("int").alias("n"))
    rows = rows.union(rows.filter("n % 10 = 0").withColumn("n", F.col("n") + 10000))  # ties
    ranks = expected_ranks(rows.collect(), ["Identifier", "Group"], [("Price", "desc")])
    found = {row.n for row in rank_over(rows, ["Group"], [("Price", "desc")], bounds).collect()}
    assert found == {n for n, rank in ranks.items() if keep(rank)}


def test_high_ranks_hold_no_group_in_a_task(spark, physical_plan):
    """A group with two thirds of all rows, half of them one tie: values are ranked in even parts."""
    from tritempo.operators import positions

    rows = spark.range(60_000).selectExpr("if(id % 3 > 0, 1L, id % 50) as Identifier", "0 as Group", "if(id % 2 = 0, 7L, id) as Price", "cast(id as int) as n")
    expected = expected_ranks(rows.collect(), ["Identifier", "Group"], [("Price", "asc")])
    for bounds, keep in (((1, 5000), lambda r: r <= 5000), ((20_002, 25_000), lambda r: 20_002 <= r <= 25_000), ((30_000, "last"), lambda r: r >= 30_000)):
        found = rank_over(rows, ["Group"], [("Price", "asc")], bounds)
        assert {row.n for row in found.collect()} == {n for n, rank in expected.items() if keep(rank)}
        assert "row_number" not in physical_plan(found) and " rank(" not in physical_plan(found)
    values = rows.groupBy("Identifier", "Group", "Price").count()
    sizes = partition_sizes(spark, positions._sorted(values, ["Identifier", "Group"], [F.col("Price")]))
    assert max(sizes) < 2 * values.count() / 8


def test_null_groups_and_values_have_ranks(spark):
    rows = spark.createDataFrame([(None, None, None, 0), (None, None, 1.0, 1), (None, None, 1.0, 2), (1, None, None, 3), (1, None, None, 4)], "Identifier long, Group int, Price double, n int")
    for early_cut in (1000, 0):
        found = rank_over(rows, ["Group"], [("Price", "asc")], (1, 2), early_cut=early_cut)
        assert sorted(row.n for row in found.collect()) == [0, 1, 2, 3, 4]
        assert sorted(row.n for row in rank_over(rows, ["Group"], [("Price", "asc")], (2,), early_cut=early_cut).collect()) == [1, 2]


def test_large_lookups_are_joined_by_shuffle(points, physical_plan):
    from tritempo.operators.joins import fits, lookup_join

    top = points.groupBy("Identifier").agg(F.max("Price").alias("Price"))
    assert fits(top) and not fits(top, limit=1) and not fits(top, most_bytes=10)
    small, large = (lookup_join(points, top, ["Identifier", "Price"], "left_semi", limit=limit) for limit in (10**6, 0))
    assert "BroadcastHashJoin" in physical_plan(small)
    assert sorted(row.n for row in small.collect()) == sorted(row.n for row in large.collect())


def test_first_and_the_rest_are_complete(points):
    first = rank_over(points, ["ReferenceTime"], [("Price", "desc")])
    rest = rank_over(points, ["ReferenceTime"], [("Price", "desc")], (2, "last"))
    assert first.union(rest).exceptAll(points).isEmpty()
    assert first.count() + rest.count() == points.count()


def test_rank_guards(points):
    mapping = [MappedColumn("Identifier", "fid", is_key=True), MappedColumn("ReferenceTime", "t", is_key=True),
               MappedColumn("Price", "p"), MappedColumn("RelativeDeliveryPeriod", "r", is_key=True)]
    check_rank_over(mapping, ["ReferenceTime"], [("Price", "desc")])
    for partition, order in (
        (["Price"], [("Price", "desc")]), (["Identifier"], [("Price", "desc")]), (["Missing"], [("Price", "desc")]),
        (["ReferenceTime"], [("RelativeDeliveryPeriod", "asc")]), (["ReferenceTime"], [("Missing", "asc")]),
    ):
        with pytest.raises(ValueError):
            check_rank_over(mapping, partition, order)
    with pytest.raises(ValueError):
        rank_over(points, [], [("Price", "desc")])
    with pytest.raises(ValueError):
        rank_over(points, ["ReferenceTime"], [("Price", "sideways")])


def test_ranks_are_cut_before_the_shuffle_and_nothing_is_stored(points, physical_plan):
    plan = physical_plan(rank_over(points, ["ReferenceTime"], [("Price", "desc")], (2, 5)))
    assert "WindowGroupLimit" in plan and "Partial" in plan and "Join" not in plan
    rest = physical_plan(rank_over(points, ["ReferenceTime"], [("Price", "desc")], (3, "last")))
    assert "LeftAnti" in rest
    # the only stored rows are those of the fixture
    assert rest.count("ExistingRDD") <= 2 * plan.count("ExistingRDD")
