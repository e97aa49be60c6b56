from datetime import datetime as dt
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tritempo.functions import timebounds as tb
from tritempo.operators.archive import (
    archive_decode,
    delivery_and_relative,
    delivery_hours,
    delivery_hours_by_zone,
    relative_delivery,
    with_relative_delivery_period,
)
from tritempo.sources.layouts import ARCHIVE

Z = "Europe/Zurich"


def rows(spark, *items):
    """Each item: (quote date, delivery date-hour, offset, value)."""
    data = [
        ("power:1", q.year, q.month, q.day, q.year * 10000 + q.month * 100 + q.day, q, d.year, d.month, d.day, d.hour,
         d.minute, offset, value)
        for q, d, offset, value in items
    ]
    return spark.createDataFrame(data, ARCHIVE)


def test_decode_across_dst(spark):
    data = rows(
        spark,
        (dt(2024, 4, 26), dt(2025, 11, 10, 13), 1, 1.00000000005),
        (dt(2024, 3, 31), dt(2024, 3, 31, 1), 1, None),
        (dt(2024, 10, 27), dt(2024, 10, 27, 2), 2, 3.0),
        (dt(2024, 10, 27), dt(2024, 10, 27, 2), 1, 4.0),
    )
    found = archive_decode(data, zone=Z).collect()
    first, spring, summer_hour, winter_hour = found
    assert (first.ReferenceTime, first.DeliveryStart, first.DeliveryEnd) == (
        dt(2024, 4, 25, 22), dt(2025, 11, 10, 12), dt(2025, 11, 10, 13))
    assert first.Value == 1.0000000001 and first.RelativeDeliveryPeriod is None
    assert (spring.DeliveryStart, spring.DeliveryEnd, spring.Value) == (dt(2024, 3, 31), dt(2024, 3, 31, 1), None)
    assert (summer_hour.DeliveryStart, winter_hour.DeliveryStart) == (dt(2024, 10, 27), dt(2024, 10, 27, 1))
    assert summer_hour.DeliveryEnd == dt(2024, 10, 27, 2) and winter_hour.DeliveryEnd == dt(2024, 10, 27, 2)
    assert archive_decode(data, zone=Z, null_as_zero=True).collect()[1].Value == 0.0


def test_zone_may_come_from_a_column(spark):
    data = rows(spark, (dt(2024, 1, 1), dt(2024, 1, 1, 5), 9, 1.0)).withColumn("tz", F.lit("Asia/Tokyo"))
    row = archive_decode(data, zone=F.col("tz")).first()
    assert (row.ReferenceTime, row.DeliveryStart, row.DeliveryEnd) == (
        dt(2023, 12, 31, 15), dt(2023, 12, 31, 20), dt(2023, 12, 31, 21))


def hours_kept(data, condition):
    return sorted(row.del_h for row in data.filter(condition).select("del_h").collect())


def test_delivery_windows(spark):
    day = rows(spark, *[(dt(2025, 7, 7), dt(2025, 7, 7, hour), 2, 1.0) for hour in range(24)])
    start, end = ("DeliveryStart", ">=", dt(2025, 7, 7, 10)), ("DeliveryEnd", "<=", dt(2025, 7, 7, 13))
    assert hours_kept(day, delivery_hours([start, end], Z)) == [12, 13, 14]
    assert hours_kept(day, relative_delivery(">=", 1)) == list(range(1, 24))
    later = ("DeliveryStart", ">=", dt(2025, 7, 7, 3))
    assert hours_kept(day, delivery_and_relative([later], [("<=", 5)], Z)) == [5]
    assert hours_kept(day, delivery_and_relative([start], [("<", 1)], Z)) == []
    assert hours_kept(day, delivery_hours([("DeliveryStart", "=", dt(2025, 7, 7, 10, 59))], Z)) == [12]
    assert hours_kept(day, delivery_hours([("DeliveryStart", ">", dt(2025, 7, 7, 10))], Z)) == list(range(13, 24))
    assert hours_kept(day, delivery_hours([("DeliveryStart", "<", dt(2025, 7, 7, 0))], Z)) == [0, 1]
    span = tb.interval(dt(2025, 7, 7, 10), dt(2025, 7, 7, 12))
    assert hours_kept(day, delivery_hours([("DeliveryStart", "in", span)], Z)) == [12, 13]
    # the strict bound wins over the loose one at the same hour
    both = [start, ("DeliveryStart", ">", dt(2025, 7, 7, 10)), ("DeliveryStart", "<=", dt(2025, 7, 7, 13)),
            ("DeliveryStart", "<", dt(2025, 7, 7, 13))]
    assert hours_kept(day, delivery_hours(both, Z)) == [13, 14]


def test_one_sided_windows_are_cut_only_on_request(spark):
    data = rows(spark, *[(dt(2000, 1, 1), dt(year, 6, 1, 12), 2, 1.0) for year in (1970, 2000, 2019, 2021, 2090)])
    late, early = [("DeliveryStart", ">=", dt(2000, 1, 1))], [("DeliveryStart", "<", dt(2000, 1, 1))]
    assert data.filter(delivery_hours(late, Z)).count() == 4
    assert data.filter(delivery_hours(early, Z)).count() == 1
    assert data.filter(delivery_and_relative(late, [(">=", 0)], Z)).count() == 4
    assert data.filter(delivery_hours(late, Z, one_sided_years=20)).count() == 2


def test_each_row_by_the_bounds_of_its_zone(spark):
    data = rows(spark, *[(dt(2025, 7, 7), dt(2025, 7, 7, hour), 2, 1.0) for hour in range(24)])
    zones = [Z, "Asia/Tokyo", "Nowhere/Else"]
    both = reduce(DataFrame.union, [data.withColumn("zone", F.lit(zone)) for zone in zones])
    bounds = [("DeliveryStart", ">=", dt(2025, 7, 7, 10)), ("DeliveryStart", "<", dt(2025, 7, 7, 12))]
    kept = both.filter(delivery_hours_by_zone(bounds, "zone", zones[:2])).select("zone", "del_h").collect()
    assert sorted(map(tuple, kept)) == sorted([(Z, 12), (Z, 13), ("Asia/Tokyo", 19), ("Asia/Tokyo", 20)])
    assert both.filter(delivery_hours_by_zone(bounds, "zone", [])).count() == 0


def test_delivery_window_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "archive")
    rows(spark, (dt(2025, 7, 7), dt(2025, 7, 7, 1), 2, 1.0)).write.parquet(path)
    condition = delivery_hours([("DeliveryStart", ">=", dt(2025, 7, 7))], Z)
    formatted = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    text = spark.read.parquet(path).filter(condition)._jdf.queryExecution().explainString(formatted)
    assert "GreaterThanOrEqual(del_y,2025)" in text and "LessThanOrEqual(del_y" not in text
    zones = delivery_hours_by_zone([("DeliveryStart", ">=", dt(2025, 7, 7))], F.lit(Z), [Z, "Asia/Tokyo"])
    text = spark.read.parquet(path).filter(zones)._jdf.queryExecution().explainString(formatted)
    assert "GreaterThanOrEqual(del_y,2025)" in text


def test_guards(spark):
    with pytest.raises(ValueError):
        delivery_hours([("Value", ">=", dt(2025, 7, 7))], Z)
    with pytest.raises(ValueError):
        delivery_hours([("DeliveryStart", "!=", dt(2025, 7, 7))], Z)
    with pytest.raises(ValueError):
        relative_delivery("<>", 1)


def test_relative_delivery_period_is_filled(spark):
    data = archive_decode(rows(spark, (dt(2024, 4, 26), dt(2024, 4, 26, 3), 2, 1.0)), zone=Z)
    assert with_relative_delivery_period(data, F.lit("PT1H")).first().RelativeDeliveryPeriod == 3
    assert with_relative_delivery_period(data, F.lit("unknown")).first().RelativeDeliveryPeriod is None
