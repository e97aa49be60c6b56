"""Stored layouts that are read in part, and joins with ranges per series."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tritempo.operators.ranges import range_join
from tritempo.plans import fixtures as fx
from tritempo.plans.layouts import shared_path, wanted_days
from tritempo.sources import stored

START = datetime(2020, 1, 1)


def files_of(rows):
    return {row.file for row in rows.select(F.input_file_name().alias("file")).distinct().collect()}


@pytest.fixture(scope="module")
def archive(spark, sf):
    path = shared_path(spark, "archive-test")
    stored.write_archive(fx.archive_hours(spark, sf).filter("qte_y = 1996"), path, period="day")
    return spark.read.parquet(path)


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_partitions_are_chosen_at_run_time(spark, sf, archive, physical_plan, limit):
    wanted = wanted_days(spark, sf).withColumn("tag", F.col("quote_index") % 10)
    found = stored.archive_of(archive, wanted, limit=limit)
    assert "dynamicpruning" in physical_plan(found) and ("LeftSemi" in physical_plan(found)) == (limit == 0)
    days = Counter(map(tuple, wanted.collect()))
    expected = [(*row, row.quote_index % 10) for row in archive.collect() if (row.ts_id, row.quote_index, row.quote_index % 10) in days]
    assert expected and Counter(map(tuple, found.collect())) == Counter(expected)
    read = found._jdf.queryExecution().executedPlan()
    files = sum(metric(node, "numFiles") for node in leaves(read))
    assert 0 < files < 0.5 * len(files_of(archive))


def leaves(plan):
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return leaves(plan.executedPlan())
    if plan.getClass().getSimpleName().endswith("QueryStageExec"):
        return leaves(plan.plan())
    children = plan.children()
    return [plan] if not children.size() else [leaf for at in range(children.size()) for leaf in leaves(children.apply(at))]


def metric(node, name):
    found = node.metrics().get(name)
    return found.get().value() if found.isDefined() and "FileSourceScan" in node.getClass().getSimpleName() else 0


def test_periods_and_ids_without_a_table(spark):
    rows = spark.createDataFrame([("power:1", 20200131, 1.0), ("gas:2", 20200201, 2.0), ("water:3", 20200201, 3.0)], "ts_id string, quote_index int, value double")
    for period in stored.PERIODS:
        path = shared_path(spark, f"archive-{period}")
        stored.write_archive(rows, path, period=period)
        wanted = spark.createDataFrame([("power:1", 20200131), ("gas:2", 20200131), ("water:3", 20200201), ("gas:2", 20200201), ("gas:2", 20200201)], "ts_id string, quote_index int")
        found = stored.archive_of(spark.read.parquet(path), wanted, period=period)
        assert sorted(row.value for row in found.collect()) == [1.0, 2.0, 2.0]


def test_buckets_join_without_a_shuffle(spark, physical_plan):
    name = "bucket_test"
    for table in (f"{name}_rows", f"{name}_series"):
        stored.drop_table(spark, table)
    rows = spark.range(10_000).select((F.col("id") % 97).alias("Identifier"), F.col("id").alias("value"))
    rows = stored.write_bucketed(rows, f"{name}_rows", buckets=6, id_col="Identifier", path=shared_path(spark, "rows"))
    series = spark.range(90).select(F.col("id").alias("series_id"), (F.col("id") * 2).alias("twice"))
    series = stored.write_bucketed(series, f"{name}_series", buckets=6, id_col="series_id", path=shared_path(spark, "series"))
    found = stored.bucketed_join(rows, series, "Identifier", "series_id")
    text = physical_plan(found)
    assert "SortMergeJoin" in text and "Exchange" not in text and "SelectedBucketsCount: 6 out of 6" in text
    assert found.count() == rows.filter("Identifier < 90").count() and found.filter("twice <> 2 * Identifier").count() == 0
    # what aggregates by the id goes on without a shuffle as well
    assert "Exchange" not in physical_plan(found.groupBy("Identifier").count())
    for table in (f"{name}_rows", f"{name}_series"):
        stored.drop_table(spark, table)


@pytest.fixture(scope="module")
def sides(spark):
    """1,000 series with windows of very different lengths, and a series that holds a third of the rows."""
    chosen = random.Random(9)
    moment = lambda: START + timedelta(seconds=chosen.randrange(90 * 86_400), microseconds=chosen.randrange(10**6))
    windows = []
    for key in range(1000):
        for part in range(chosen.randrange(1, 4)):
            first = moment()
            last = first + timedelta(seconds=int(10 ** chosen.uniform(0, 7.3)))
            windows.append((key, None if chosen.random() < 0.05 else first, None if chosen.random() < 0.05 else last, part))
    windows += [(1, START, START, 9), (2, START + timedelta(1), START, 9), (None, START, None, 9), (3, None, None, 9)]
    rows = [(0 if n % 3 == 0 else chosen.randrange(1000), moment(), n) for n in range(6000)] + [(5, None, -1), (None, START, -2)]
    rows += [(key, first, -3) for key, first, _, _ in windows[:300] if first] + [(key, last, -4) for key, _, last, _ in windows[:300] if last]
    rows += [(7, datetime(1800, 1, 1), -5), (3, datetime(1800, 1, 1), -6), (3, datetime(9999, 1, 1), -7)]
    return (
        spark.createDataFrame(rows, "key long, at timestamp_ntz, n long"),
        spark.createDataFrame(windows, "key long, first timestamp_ntz, last timestamp_ntz, part int"),
        Counter(
            (key, n, part) for key, at, n in rows for own, first, last, part in windows
            if key is not None and at is not None and key == own and (first is None or first <= at) and (last is None or at < last)
        ),
    )


@pytest.mark.parametrize("broadcast", [True, False])
def test_range_join_equals_the_plain_comparison(sides, monkeypatch, physical_plan, broadcast):
    from tritempo.operators import joins

    if not broadcast:
        monkeypatch.setattr(joins.fits, "__defaults__", (0, 0))
    rows, windows, expected = sides
    found = range_join(rows, windows, ["key"], "at")
    text = physical_plan(found)
    assert ("BroadcastHashJoin" if broadcast else "SortMergeJoin") in text and "NestedLoop" not in text and "Cartesian" not in text
    assert Counter((row.key, row.n, row.part) for row in found.collect()) == expected
    assert found.columns == ["key", "at", "n", "first", "last", "part"]


def test_range_join_refuses_columns_of_both_sides_and_takes_empty_sides(spark, sides):
    rows, windows, _ = sides
    with pytest.raises(ValueError, match="part"):
        range_join(rows.withColumn("part", F.lit(1)), windows, ["key"], "at")
    for some in (windows.filter("part = 77"), windows.filter("first > last")):
        found = range_join(rows, some, ["key"], "at")
        assert found.count() == 0 and found.columns == ["key", "at", "n", "first", "last", "part"]
    assert range_join(rows.filter("n = 10000000"), windows, ["key"], "at").count() == 0


def test_ranges_as_many_as_rows_are_not_kept(sides, spark, sf, physical_plan):
    rows, windows, expected = sides
    found = range_join(rows, windows, ["key"], "at", ahead=False)
    assert Counter((row.key, row.n, row.part) for row in found.collect()) == expected
    events = fx.table(spark, sf, "events")
    ranges = events.selectExpr("user_id", "ts as first", "cast(null as timestamp_ntz) as last")
    kept = [physical_plan(range_join(events, ranges, ["user_id"], "ts", ahead=ahead)).count("Scan ExistingRDD") for ahead in (True, False)]
    assert kept == [1, 0]


@pytest.mark.parametrize("ahead", [True, False])
def test_rows_of_no_time_meet_no_open_range(sides, ahead):
    rows, windows, expected = sides
    unplaced = rows.withColumn("at", F.when(F.col("n") < 0, F.col("at")))
    found = range_join(unplaced, windows.filter("key = 3"), ["key"], "at", ahead=ahead)
    assert Counter((row.key, row.n, row.part) for row in found.collect()) == Counter({each: count for each, count in expected.items() if each[0] == 3 and each[1] < 0})
