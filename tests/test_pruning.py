from datetime import date, datetime as dt, timedelta

import pytest
from pyspark.sql import functions as F

from tritempo.functions import timebounds as tb
from tritempo.functions.predicates import OPERATORS, at, within
from tritempo.functions.timecols import quote_index
from tritempo.operators.pruning import DayRange, index_of, quote_day_range, quote_index_range
from tritempo.sources.scans import write_by_quote_index

Z = "Europe/Zurich"


def indices(days):
    return (days.first and index_of(days.first), days.last and index_of(days.last))


def test_recent_vectors():
    three_days = tb.Interval(dt(2023, 1, 1), dt(2023, 1, 3))
    assert indices(quote_index_range([three_days])) == (20221230, 20230105)
    assert indices(quote_index_range([("=", dt(2023, 3, 1, 23))])) == (20230228, 20230302)
    both = [(">=", dt(2023, 1, 2, 10)), ("<=", dt(2023, 1, 4, 12))]
    assert indices(quote_index_range(both)) == (20221231, 20230106)
    assert indices(quote_index_range([(">", dt(2023, 1, 10)), ("<", dt(2023, 1, 20))])) == (20230107, 20230123)


def test_recent_open_sides_are_lossless_unless_asked():
    upper = [("<=", dt(2024, 6, 1))]
    assert indices(quote_index_range(upper)) == (None, 20240603)
    assert indices(quote_index_range(upper, lookback_years=3)) == (20210603, 20240603)
    lower = [(">=", dt(2024, 6, 1))]
    assert indices(quote_index_range(lower)) == (20240530, None)
    assert indices(quote_index_range(lower, now=dt(2024, 6, 10, 9))) == (20240530, 20240612)
    assert indices(quote_index_range(lower, now=dt(2020, 1, 1))) == (20240530, 20240601)
    assert quote_index_range([(">=", dt(2024, 6, 9)), ("<=", dt(2024, 6, 1))]).is_empty


def test_archive_vectors():
    span = [(">=", dt(2025, 8, 22, 22)), ("<=", dt(2025, 8, 24, 22))]
    assert indices(quote_day_range(span, Z)) == (20250823, 20250825)
    assert indices(quote_day_range([span[0], ("<", span[1][1])], Z)) == (20250823, 20250824)
    assert indices(quote_day_range([("=", tb.point("2024-04-26T00:00:00", Z))], Z)) == (20240426, 20240426)
    assert quote_day_range([("=", tb.point("2024-04-26T22:00:00", Z))], Z).is_empty
    before = [("<", dt(2026, 6, 10, 22))]
    now = dt(2026, 6, 10, 9)
    assert indices(quote_day_range(before, Z, now=now, lookback_years=3)) == (20230610, 20260610)
    assert indices(quote_day_range(before, Z)) == (None, 20260610)
    # a start inside a day begins with the next day; all bounds intersect
    assert indices(quote_day_range([(">", dt(2024, 1, 1)), (">=", dt(2023, 1, 1))], "UTC")) == (20240102, None)
    assert indices(quote_day_range([(">=", dt(2024, 1, 1))], "UTC", now=now)) == (20240101, 20260610)
    assert indices(quote_day_range([(">=", dt(2000, 1, 1))], "UTC", now=now)) == (20000101, 20260610)
    assert indices(quote_day_range([(">=", dt(2000, 1, 1))], "UTC", now=now, span_years=20)) == (20000101, 20200101)
    assert quote_day_range([(">=", dt(2000, 1, 1))], "UTC").last is None
    with pytest.raises(ValueError):
        quote_day_range([("!=", dt(2024, 1, 1))], Z)


def test_pruning_never_removes_a_matching_row():
    """Every day that can satisfy a bound in any zone stays inside the index range."""
    for op, compare in OPERATORS.items():
        bound = dt(2024, 6, 15, 7, 30)
        days = quote_index_range([(op, bound)])
        for hours in range(-24 * 10, 24 * 10):
            instant = bound + timedelta(hours=hours)
            if compare(instant, bound):
                assert days.first is None or days.first <= instant.date()
                assert days.last is None or instant.date() <= days.last


def test_empty_range_matches_nothing(spark):
    frame = spark.range(3).select(F.lit(20240101).alias("quote_index"))
    assert frame.filter(DayRange(empty=True).predicate()).count() == 0
    assert frame.filter(DayRange(date(2024, 1, 1), date(2024, 1, 1)).predicate()).count() == 3


def test_partitioned_table_is_pruned(spark, tmp_path, physical_plan):
    from tritempo.plans.fixtures import curve_points

    points = curve_points(spark, "/root/testdata/sf0.001")
    path = str(tmp_path / "by_day")
    write_by_quote_index(points, path)
    stored = spark.read.parquet(path)
    span = tb.interval("1998-06-01T00:00:00", "1998-07-01T00:00:00")
    days = quote_index_range([(">=", span.start), ("<", span.end)])
    pruned = stored.filter(within("ReferenceTime", span) & days.predicate())
    text = physical_plan(pruned)
    assert "PartitionFilters: [isnotnull(quote_index" in text
    assert "PushedFilters: [IsNotNull(ReferenceTime), GreaterThanOrEqual(ReferenceTime" in text
    expected = points.filter(within("ReferenceTime", span)).count()
    assert expected > 0 and pruned.count() == expected
    assert stored.filter(at("ReferenceTime", "<", span.start)).count() > 0
    assert points.filter(quote_index("ReferenceTime") != F.col("quote_index")).count() == 0
