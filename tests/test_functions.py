import math
import random
from datetime import datetime as dt, timedelta

import pytest
from pyspark.sql import functions as F

from tritempo.functions import timebounds as tb
from tritempo.functions.buckets import bucket_start, bucket_unit
from tritempo.functions.catalogcols import archive_table, normalize_category, route_source
from tritempo.functions.mapped import json_value, json_values
from tritempo.functions.numbers import adaptive_round, format_number
from tritempo.functions.predicates import compare, lite_range, numeric
from tritempo.functions.rdp import RESOLUTIONS, relative_delivery_period, relative_delivery_period_by
from tritempo.functions.shape import Shape
from tritempo.functions.timecols import format_timestamp, format_timestamps, quote_index, utc_to_zone, zone_to_utc
from zoneinfo import ZoneInfo


@pytest.fixture
def instants(spark):
    generator = random.Random(7)
    values = [dt(1990, 1, 1) + timedelta(seconds=generator.randrange(20 * 365 * 86400)) for _ in range(400)]
    values += [dt(1999, 12, 31, 23, 30), dt(2000, 1, 1), dt(2000, 1, 2), dt(1999, 12, 26), dt(2024, 3, 31, 1, 0, 0, 1),
               dt(2024, 10, 27, 0, 30), dt(2024, 2, 29, 23, 59, 59, 999999), dt(1969, 12, 31, 23, 59, 58)]
    return values


def frame(spark, values):
    return spark.createDataFrame([(n, value) for n, value in enumerate(values)], "n int, x timestamp_ntz")


def truncated_div(number, size):
    return int(number / size) if abs(number) < 2**50 else math.trunc(number / size)


def expected_bucket(x, unit, size, week_start="sunday"):
    anchor = dt(2000, 1, 1)
    if unit in ("hour", "minute"):
        step = timedelta(hours=1) if unit == "hour" else timedelta(minutes=1)
        floor = x.replace(minute=0, second=0, microsecond=0) if unit == "hour" else x.replace(second=0, microsecond=0)
        return anchor + truncated_div((floor - anchor) // step, size) * size * step
    if unit == "day":
        return anchor + timedelta(days=truncated_div((x.date() - anchor.date()).days, size) * size)
    if unit == "week":
        first = dt(2000, 1, 2) if week_start == "sunday" else dt(2000, 1, 3)
        weeks = (x.date() - first.date()).days // 7
        return dt(2000, 1, 3) + timedelta(weeks=truncated_div(weeks, size) * size)
    months = (x.year - 2000) * 12 + x.month - 1 if unit == "month" else x.year - 2000
    months = truncated_div(months, size) * size * (1 if unit == "month" else 12)
    return dt(2000 + months // 12, months % 12 + 1, 1)


@pytest.mark.parametrize("period", ["PT1H", "PT6H", "PT1M", "PT90M", "P1D", "P3D", "P1W", "P2W", "P1M", "P5M", "P1Y", "P3Y"])
def test_buckets_count_boundaries_and_truncate(spark, instants, period):
    unit, size = bucket_unit(period)
    for start in ("sunday", "monday"):
        rows = frame(spark, instants).select("x", bucket_start("x", period, week_start=start).alias("b")).collect()
        assert all(row.b == expected_bucket(row.x, unit, size, start) for row in rows)


def test_zone_buckets_follow_the_wall_clock(spark):
    rows = frame(spark, [dt(2024, 3, 30, 22, 59), dt(2024, 3, 30, 23), dt(2024, 3, 31, 21, 59), dt(2024, 3, 31, 22)])
    starts = [row.b for row in rows.orderBy("n").select(bucket_start("x", "P1D", "Europe/Zurich").alias("b")).collect()]
    assert starts == [dt(2024, 3, 29, 23), dt(2024, 3, 30, 23), dt(2024, 3, 30, 23), dt(2024, 3, 31, 22)]


@pytest.mark.parametrize("period", ["PT1S", "P1Y2M", "P0D", "PT0H", "1D", "P1DT1H", ""])
def test_other_periods_are_not_buckets(period):
    with pytest.raises(ValueError):
        bucket_unit(period)


def expected_rdp(ref, dlv, resolution, gas=False):
    def shifted(x):
        return tb.add_calendar(x, -9, 0) if gas else x

    def monday(x):
        return x.date() - timedelta(days=x.weekday())

    def unit(seconds):
        epoch = dt(1970, 1, 1)
        return (dlv - epoch) // timedelta(seconds=seconds) - (ref - epoch) // timedelta(seconds=seconds)

    a, b = shifted(ref), shifted(dlv)
    return {
        "P1Y": lambda: b.year - a.year,
        "P6M": lambda: (b.year - a.year) * 2 + (b.month - 1) // 6 - (a.month - 1) // 6,
        "P3M": lambda: (b.year - a.year) * 4 + (b.month - 1) // 3 - (a.month - 1) // 3,
        "P1M": lambda: (b.year - a.year) * 12 + b.month - a.month,
        "P1W": lambda: (monday(b) - monday(a)).days // 7,
        "P1D": lambda: int((dlv - ref) / timedelta(days=1)),
        "PT1H": lambda: unit(3600), "PT30M": lambda: unit(1800), "PT15M": lambda: unit(900),
        "PT5M": lambda: unit(300), "PT1M": lambda: unit(60), "PT4S": lambda: unit(4),
    }[resolution]()


def test_relative_delivery_periods(spark, instants):
    pairs = list(zip(instants, reversed(instants), strict=True)) + [(x, x + timedelta(hours=5)) for x in instants]
    data = spark.createDataFrame(pairs, "r timestamp_ntz, d timestamp_ntz")
    plain = [relative_delivery_period("r", "d", name).alias(name) for name in RESOLUTIONS]
    gas = [relative_delivery_period("r", "d", name, delivery_resolution=kind).alias(f"gas_{name}")
           for name, kind in (("P6M", "Season"), ("P1Y", "Year"))]
    for row in data.select("r", "d", *plain, *gas).collect():
        for name in RESOLUTIONS:
            assert row[name] == expected_rdp(row.r, row.d, name), (name, row)
        for name in ("P6M", "P1Y"):
            assert row[f"gas_{name}"] == expected_rdp(row.r, row.d, name, gas=True), (name, row)
    for kind in ("", "Season", "Year"):
        for name in RESOLUTIONS:
            by_column = relative_delivery_period_by("r", "d", F.lit(name), delivery_resolution=kind)
            direct = relative_delivery_period("r", "d", name, delivery_resolution=kind)
            assert data.filter(~by_column.eqNullSafe(direct)).isEmpty()
    three = spark.createDataFrame([(dt(2024, 4, 26), dt(2024, 4, 26, 3), "PT1H"), (dt(2024, 4, 26), dt(2024, 4, 26, 3), "P2D")],
                                  "r timestamp_ntz, d timestamp_ntz, res string")
    found = [row.v for row in three.select(relative_delivery_period_by("r", "d", "res").alias("v")).collect()]
    assert found == [3, None]


def test_format_timestamp(spark, instants):
    data = frame(spark, instants)
    for zone in ("UTC", "Europe/Zurich", "America/St_Johns", "Asia/Tokyo", "Asia/Kathmandu"):
        listed = data.orderBy("n").agg(F.sort_array(F.collect_list(F.struct("n", "x"))).alias("l")).select(
            "l.x", format_timestamps(F.col("l.x"), zone).alias("t")).first()
        single = {row.x: row.t for row in data.select("x", format_timestamp("x", zone).alias("t")).collect()}
        assert [single[x] for x in listed.x] == listed.t
        rows = data.select("x", format_timestamp("x", zone).alias("t"),
                           format_timestamp("x", F.lit(zone)).alias("by_column"),
                           format_timestamp("x", zone, offset=False).alias("p")).collect()
        for row in rows:
            local = row.x.replace(tzinfo=ZoneInfo("UTC")).astimezone(ZoneInfo(zone))
            text = local.isoformat(timespec="milliseconds")
            assert row.t == text and row.by_column == text and row.p == text[:23]
    assert spark.sql("select cast(null as timestamp_ntz) x").select(format_timestamp("x", "CET")).first()[0] is None


def plain_decimal(value):
    """Shortest decimal digits without an exponent."""
    from decimal import Decimal

    if math.isnan(value):
        return "NaN"
    if math.isinf(value):
        return "+Inf" if value > 0 else "-Inf"
    text = format(Decimal(repr(value)), "f")
    text = text.rstrip("0").rstrip(".") if "." in text else text
    return text


def test_format_number(spark):
    generator = random.Random(3)
    values = [0.0, -0.0, 1.0, -1.5, 0.1, 1e-7, 1.23456789e7, 1e21, 1e22, 123456789012345680.0, 1.7976931348623157e308,
              2.0e-3, 9.999999e6, 1e7, 1e23, 2.2250738585072014e-308, 9007199254740993.0, 1e18, 1.5e19, float("nan"), float("inf"), -float("inf")]
    values += [generator.uniform(-1, 1) * 10 ** generator.randint(-12, 18) for _ in range(2000)]
    values += [round(generator.uniform(0, 1e5), 2) / 7 for _ in range(2000)]
    data = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    for row in data.select("v", format_number("v").alias("t")).collect():
        if row.v is not None and 2.0**63 <= abs(row.v) < float("inf"):
            assert float(row.t) == row.v and row.t.lstrip("-").isdigit()
        else:
            assert row.t == (None if row.v is None else plain_decimal(row.v)), row
    assert [r[0] for r in spark.createDataFrame([(-2.5,)], "v double").select(format_number("v")).collect()] == ["-2.5"]


def test_adaptive_round(spark):
    data = spark.createDataFrame([(0.12345678905,), (-0.12345678905,), (1.0,), (None,)], "v double")
    rows = [row[0] for row in data.select(adaptive_round("v")).collect()]
    assert rows == [0.1234567891, -0.1234567891, 1.0, None]
    assert [row[0] for row in data.select(adaptive_round("v", null_as_zero=True)).collect()][-1] == 0.0


def test_quote_index(spark):
    assert frame(spark, [dt(2024, 4, 26, 23, 59)]).select(quote_index("x")).first()[0] == 20240426


def test_shape_words():
    shape = Shape.of(["Mar", "Jan"], ["Sun", "Mon"], [("08:00:00", "10:30:00")])
    assert shape == Shape((1, 3), (1, 7), ((28800, 37800),))
    for arguments in (
        {"months": ["Foo"]}, {"months": ["Jan", "jan"]}, {"days": ["Mon", "Mon"]}, {"days": ["Monday"]},
        {"times": [("08:00:00", "10:00:00"), ("09:00:00", "11:00:00")]},
        {"times": [("08:00:00", "10:00:00"), ("08:00:00", "10:00:00")]},
        {"times": [("10:00:00", "08:00:00")]}, {"times": [("24:00:00", "08:00:00")]}, {"times": [("8", "9")]},
    ):
        with pytest.raises(ValueError):
            Shape.of(**arguments)


def test_shape_rows(spark, instants):
    shape = Shape.of(["Jan", "Jul"], ["Sat", "Sun"], [("00:00:00", "06:30:00"), ("20:00:00", "00:00:00")])
    kept = {row.x for row in frame(spark, instants).filter(shape.predicate("x", "Europe/Zurich")).collect()}
    for x in instants:
        local = x.replace(tzinfo=ZoneInfo("UTC")).astimezone(ZoneInfo("Europe/Zurich"))
        clock = local.hour * 3600 + local.minute * 60 + local.second
        wanted = local.month in (1, 7) and local.weekday() >= 5 and (clock < 6.5 * 3600 or clock >= 20 * 3600)
        assert (x in kept) == wanted
    everything = Shape.of([], ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"], [("00:00:00", "00:00:00")])
    text = str(everything.predicate("x"))
    assert "true" in text.lower() and "weekday" not in text


def test_results_do_not_depend_on_the_session_zone(spark, instants):
    def everything():
        return frame(spark, instants).select(
            "n", *[bucket_start("x", p, "Europe/Zurich").alias(p) for p in ("PT6H", "PT15M", "P1D", "P2W", "P1M", "P1Y")],
            format_timestamp("x", "Europe/Zurich").alias("t"), quote_index("x").alias("q"),
            *[relative_delivery_period(F.lit(dt(2001, 3, 4).isoformat()).cast("timestamp_ntz"), "x", r).alias(f"r{r}") for r in RESOLUTIONS],
            Shape.of(["Jan"], ["Mon"], [("01:00:00", "02:30:00")]).predicate("x", "Europe/Zurich").alias("s"),
        ).orderBy("n").collect()

    before = everything()
    try:
        for zone in ("America/Sao_Paulo", "Asia/Kathmandu", "Europe/Zurich"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert everything() == before
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("session, kept, gone", [
    ("UTC", "from_utc_timestamp", "convert_timezone"), ("America/Sao_Paulo", "convert_timezone", "from_utc_timestamp"),
])
def test_zone_conversions_agree_at_every_transition(spark, physical_plan, session, kept, gone):
    spark.conf.set("spark.sql.session.timeZone", session)
    try:
        times = spark.sql(
            "SELECT TIMESTAMP_NTZ '2023-12-01 00:00:00' + make_dt_interval(0, 0, CAST(id * 23 AS INT)) x FROM range(26000)")
        for zone in ("Europe/Zurich", "America/St_Johns", "Australia/Lord_Howe", "America/Sao_Paulo"):
            both = times.select(
                utc_to_zone("x", zone).alias("local"), F.convert_timezone(F.lit("UTC"), F.lit(zone), "x").alias("local2"),
                zone_to_utc("x", F.lit(zone)).alias("utc"), F.convert_timezone(F.lit(zone), F.lit("UTC"), "x").alias("utc2"))
            assert both.filter("local IS DISTINCT FROM local2 OR utc IS DISTINCT FROM utc2").isEmpty()
        plan = physical_plan(times.select(utc_to_zone("x", "Europe/Zurich").alias("y")))
        assert kept in plan and gone not in plan
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_predicate_guards(spark):
    with pytest.raises(ValueError):
        compare("x", "!=", 1)
    with pytest.raises(ValueError):
        lite_range("2024-01-02T00:00:00", "2024-01-02T00:00:00")
    data = spark.createDataFrame([(1.0,), (2.5,), (3.0,)], "v double")
    assert data.filter(numeric("v", ">=", "2.5")).count() == 2
    assert data.filter(numeric("v", "<", "3")).count() == 2


def test_json_values(spark):
    data = spark.createDataFrame([('{"k": 7, "name": "x", "p": 1.5}',), ("{}",), (None,)], "j string")
    fields = json_values("j", {"k": "int", "p": "number", "name": "varchar"})
    rows = [tuple(row) for row in data.select(*[c.alias(n) for n, c in fields.items()]).collect()]
    assert rows == [(7, 1.5, "x"), (None, None, None), (None, None, None)]
    single = data.select(json_value("j", "k", "bigint").alias("k"))
    assert single.dtypes == [("k", "bigint")] and [r.k for r in single.collect()] == [7, None, None]


def test_json_fields_have_one_rule_however_many_are_asked_for(spark):
    texts = [
        '{"k":1,"k":2}', '{"k":null,"k":2}', '{"k":null}', '{"a":{"k":5},"k":6}', '{"K":1}', '{"k": 7', "[1]", "7", "", None, '{"k":1} more', '{"k":{"a":[1]}}',
        '{"k":NaN,"s":"x"}', '{"s":"it\'s","k":true}', '{"k.b":1,"k":2.50}', '{"k":"a\\"b","s":[1, 2]}',
    ]
    rows = spark.createDataFrame([(text,) for text in texts], "j string")
    few, many = json_values("j", {"k": "text", "s": "text"}), json_values("j", {"k": "text", "s": "text", "k.b": "text"})
    shown = rows.select(*[each[name].alias(f"{name}{n}") for n, each in enumerate((few, many)) for name in ("k", "s")]).collect()
    assert [row[:2] for row in shown] == [row[2:] for row in shown]
    assert [row[0] for row in shown] == ["1", "2", None, "6", None, None, None, None, None, None, "1", '{"a":[1]}', None, "true", "2.5", 'a"b']
    assert rows.select(json_value("j", "it's", "text")).filter("1 = 0").count() == 0


def test_catalog_functions(spark):
    words = spark.createDataFrame([("CURVE",), ("Time_Series",), ("surface",), ("other",)], "c string")
    assert [r[0] for r in words.select(normalize_category("c", "curves")).collect()] == [
        "curves", "timeseries", "surfaces", "curves"]
    ids = spark.createDataFrame([(" POWER_x",), ("my-oil-and-gas",), ("coal",), ("wind",), (None,)], "a string")
    assert [r[0] for r in ids.select(archive_table("a")).collect()] == ["hpfc", "gas_pfc", "coal_pfc", None, None]
    rows = spark.createDataFrame(
        [("archive", None, "power:1", "CET", 1), ("archive", None, "power:2", "Asia/Tokyo", 2),
         ("archive", None, " ", None, 3), ("archive", None, "power:4", None, 4), ("external", 5, "p", None, 5),
         ("recent", None, "p", None, 6), ("archive", 9, "p", None, 7)],
        "source string, versioned_id long, archive_id string, timezone string, series_id long")
    assert [r[0] for r in rows.select(route_source()).collect()] == [
        "archive", "recent", "recent", "archive", "external", "recent", "versioned"]
    assert [r[0] for r in rows.select(route_source(rank_over=True)).collect()][0] == "recent"
    assert [r[0] for r in rows.select(route_source(recent_only_ids=[4])).collect()][3] == "recent"
