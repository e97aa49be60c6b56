"""Plans over times with minutes, seconds and milliseconds, windows open on one side, several zones, and JSON names that repeat."""

from __future__ import annotations

from pyspark.sql import functions as F

from tritempo.functions import timebounds as tb
from tritempo.functions.mapped import MappedColumn, json_values
from tritempo.functions.rdp import relative_delivery_period
from tritempo.functions.shape import Shape
from tritempo.functions.timecols import format_timestamp
from tritempo.operators.aggregate import aggregate_delivery
from tritempo.operators.archive import delivery_and_relative_by_zone, delivery_hours, delivery_hours_by_zone
from tritempo.operators.pruning import quote_days_by_zone
from tritempo.plans import fixtures as fx
from tritempo.plans.aggregates import _ANCHOR, _offset_text, _units
from tritempo.plans.filters import _ARCHIVE, _ARCHIVE_COLUMNS, _HOUR
from tritempo.plans.fixtures import ZONE, with_sql
from tritempo.plans.registry import plan
from tritempo.sinks.text import mapped_header, union_categories

_RESOLUTIONS = {
    "rdp_minutes_fine": {"quarter_hours": ("PT15M", 900), "five_minutes": ("PT5M", 300), "minutes": ("PT1M", 60)},
    "rdp_seconds_fine": {"four_seconds": ("PT4S", 4)},
}


def _rdp(name, columns):
    listed = ", ".join(f'{_units(seconds)} AS "{alias}"' for alias, (_, seconds) in columns.items())

    @plan(name, with_sql("fine_points", f"""
        SELECT "Identifier", "ReferenceTime", "DeliveryStart", {listed} FROM fine_points"""))
    def build(spark, sf):
        periods = [
            relative_delivery_period("ReferenceTime", "DeliveryStart", resolution).alias(alias)
            for alias, (resolution, _) in columns.items()
        ]
        return fx.fine_points(spark, sf).select("Identifier", "ReferenceTime", "DeliveryStart", *periods)


for _name, _columns in _RESOLUTIONS.items():
    _rdp(_name, _columns)

_BUCKET = f"""{_ANCHOR} + to_minutes(date_diff('minute', {_ANCHOR}, "DeliveryStart") // 20 * 20)"""


@plan("agg_bucket_minute_fine", with_sql("fine_points", f"""
    SELECT "Identifier", bucket AS "DeliveryBucket", CAST(count(*) AS BIGINT) AS n,
           max("SettlementPrice") AS "TopPrice"
    FROM (SELECT *, {_BUCKET} AS bucket FROM (
        SELECT * REPLACE (CAST(date_trunc('day', "ReferenceTime") AS TIMESTAMP) AS "ReferenceTime") FROM fine_points))
    GROUP BY "Identifier", "ReferenceTime", bucket"""))
def agg_bucket_minute_fine_plan(spark, sf):
    rows = fx.fine_points(spark, sf)
    rows = rows.withColumn("ReferenceTime", F.col("ReferenceTime").cast("date").cast("timestamp_ntz"))
    found = aggregate_delivery(
        rows, "PT20M", [("COUNT", "SettlementPrice", "n"), ("MAX", "SettlementPrice", "TopPrice")]
    )
    return found.select("Identifier", "DeliveryBucket", F.col("n").cast("bigint").alias("n"), "TopPrice")


_SECOND = f"epoch(timezone('{ZONE}', timezone('UTC', \"DeliveryStart\")) - date_trunc('day', timezone('{ZONE}', timezone('UTC', \"DeliveryStart\"))))"


@plan("shape_time_spans_fine", with_sql("fine_points", f"""
    SELECT "Identifier", "DeliveryStart" FROM fine_points
    WHERE {_SECOND} >= 73815 OR ({_SECOND} >= 28830 AND {_SECOND} < 37845)"""))
def shape_time_spans_fine_plan(spark, sf):
    spans = Shape.of(times=[("20:30:15", "00:00:00"), ("08:00:30", "10:30:45")])
    return fx.fine_points(spark, sf).filter(spans.predicate("DeliveryStart", ZONE)).select("Identifier", "DeliveryStart")


@plan("format_timestamp_fine", with_sql("fine_points", f"""
    SELECT "DeliveryStart", {_offset_text(ZONE, '"DeliveryStart"')} AS zurich,
           {_offset_text("America/St_Johns", '"DeliveryStart"')} AS st_johns,
           strftime("DeliveryStart", '%Y-%m-%dT%H:%M:%S.%g') AS plain
    FROM fine_points"""))
def format_timestamp_fine_plan(spark, sf):
    return fx.fine_points(spark, sf).select(
        "DeliveryStart",
        format_timestamp("DeliveryStart", ZONE).alias("zurich"),
        format_timestamp("DeliveryStart", "America/St_Johns").alias("st_johns"),
        format_timestamp("DeliveryStart", offset=False).alias("plain"),
    )


@plan("filter_delivery_open", with_sql("archive_hours", _ARCHIVE + "WHERE " + _HOUR + " >= 1965070701"))
def filter_delivery_open_plan(spark, sf):
    # the fixture's years lie more than twenty years after the bound
    condition = delivery_hours([("DeliveryStart", ">=", tb.point("1965-07-07T00:00:00Z"))], ZONE)
    return fx.archive_hours(spark, sf).filter(condition).select(*_ARCHIVE_COLUMNS)


_TOKYO = "(series % 10 = 4)"
_ZONES = (ZONE, "Asia/Tokyo")


def _with_zone(spark, sf):
    series = F.split_part("ts_id", F.lit(":"), F.lit(2)).cast("bigint")
    return fx.archive_hours(spark, sf).withColumn("zone", F.when(series % 10 == 4, _ZONES[1]).otherwise(_ZONES[0]))


@plan("filter_delivery_zones", with_sql("archive_hours", _ARCHIVE + f"""
    WHERE ({_TOKYO} AND {_HOUR} >= 1997070719 AND {_HOUR} < 1998010109)
       OR (NOT {_TOKYO} AND {_HOUR} >= 1997070712 AND {_HOUR} < 1998010101)"""))
def filter_delivery_zones_plan(spark, sf):
    bounds = [("DeliveryStart", ">=", tb.point("1997-07-07T10:00:00Z")), ("DeliveryStart", "<", tb.point("1998-01-01T00:00:00Z"))]
    condition = delivery_hours_by_zone(bounds, "zone", _ZONES)
    return _with_zone(spark, sf).filter(condition).select(*_ARCHIVE_COLUMNS)


@plan("filter_delivery_and_relative_zones", with_sql("archive_hours", _ARCHIVE + f"""
    WHERE (({_TOKYO} AND {_HOUR} >= 1997070719 AND {_HOUR} < 1999010109)
        OR (NOT {_TOKYO} AND {_HOUR} >= 1997070712 AND {_HOUR} < 1999010101))
      AND date_diff('day', make_date(qte_y, qte_m, qte_d), make_date(del_y, del_m, del_d)) * 24 + del_h BETWEEN 20 AND 44"""))
def filter_delivery_and_relative_zones_plan(spark, sf):
    bounds = [("DeliveryStart", "in", tb.interval("1997-07-07T10:00:00Z", "1999-01-01T00:00:00Z"))]
    condition = delivery_and_relative_by_zone(bounds, [(">=", 20), ("<=", 44)], "zone", _ZONES)
    return _with_zone(spark, sf).filter(condition).select(*_ARCHIVE_COLUMNS)


@plan("select_quote_days_zones", with_sql("archive_hours", _ARCHIVE + f"""
    WHERE ({_TOKYO} AND quote_index BETWEEN 19980602 AND 19990531)
       OR (NOT {_TOKYO} AND quote_index BETWEEN 19980601 AND 19990531)"""))
def select_quote_days_zones_plan(spark, sf):
    bounds = [(">=", tb.point("1998-05-31T22:00:00Z")), ("<", tb.point("1999-05-31T12:00:00Z"))]
    return _with_zone(spark, sf).filter(quote_days_by_zone(bounds, "zone", _ZONES)).select(*_ARCHIVE_COLUMNS)


@plan("json_repeated_names", with_sql("versions", """
    SELECT event_id, CAST(json_extract_string(payload, '$.k') AS BIGINT) AS alone,
           CAST(json_extract_string(payload, '$.k') AS BIGINT) AS k, 'a' AS s FROM versions"""))
def json_repeated_names_plan(spark, sf):
    # k and s occur twice; the first of each counts, whether one field is asked for or two
    payload = F.concat(F.expr("left(payload, length(payload) - 1)"), F.lit(', "s": "a", "k": -1, "s": "b"}'))
    rows = fx.versions(spark, sf).withColumn("payload", payload)
    alone, both = json_values("payload", {"k": "int"}), json_values("payload", {"k": "int", "s": "string"})
    return rows.select("event_id", alone["k"].alias("alone"), both["k"].alias("k"), both["s"].alias("s"))


_NUMBER = r"regexp_replace(CAST({} AS VARCHAR), '\.0$', '')"
_TIME = "strftime({}, '%Y-%m-%dT%H:%M:%S.%g')"
_TS_MAPPING = [
    MappedColumn("Identifier", "user_id", is_key=True, key_ordering=0),
    MappedColumn("ReferenceTime", "ts", is_key=True, key_ordering=1),
    MappedColumn("Value", "value", value_ordering=1),
    MappedColumn("Hidden", "event_id", is_projectable=False),
]


@plan("write_csv_categories", with_sql("curve_points ts_points", f"""
    SELECT CAST("Identifier" AS VARCHAR) AS "Identifier", {_TIME.format('"ReferenceTime"')} AS "ReferenceTime",
           {_TIME.format('"DeliveryStart"')} AS "DeliveryStart", {_TIME.format('"DeliveryEnd"')} AS "DeliveryEnd",
           {_NUMBER.format('"SettlementPrice"')} AS "SettlementPrice", {_NUMBER.format('"Volume"')} AS "Volume",
           'N/A' AS "Value"
    FROM curve_points
    UNION ALL SELECT CAST("Identifier" AS VARCHAR), {_TIME.format('"ReferenceTime"')}, 'N/A', 'N/A', 'N/A', 'N/A',
           {_NUMBER.format('"Value"')} FROM ts_points"""))
def write_csv_categories_plan(spark, sf):
    header = mapped_header(fx.CURVE_MAPPING, _TS_MAPPING)
    return union_categories(fx.curve_points(spark, sf), fx.ts_points(spark, sf), header=header, ordered=True)
