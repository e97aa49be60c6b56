"""Plans for aggregations, relative delivery periods and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tritempo.functions import timebounds as tb
from tritempo.functions.catalogcols import derive_source, normalize_category, series_zone
from tritempo.functions.mapped import json_value
from tritempo.functions.numbers import adaptive_round, format_number
from tritempo.functions.predicates import within
from tritempo.functions.rdp import relative_delivery_period, relative_delivery_period_by
from tritempo.functions.timecols import format_timestamp, quote_index
from tritempo.operators.aggregate import aggregate_delivery, filter_limits
from tritempo.operators.catalog import series_of, with_mapping
from tritempo.operators.versions import latest_version
from tritempo.plans import fixtures as fx
from tritempo.plans.fixtures import ZONE, with_sql
from tritempo.plans.registry import plan
from tritempo.sinks.text import to_target_zone

_ANCHOR = "TIMESTAMP '2000-01-01'"
_DAY_NUMBER = """date_diff('day', DATE '2000-01-01', CAST("DeliveryStart" AS DATE))"""


def _bucket_sql(bucket, reference='min("ReferenceTime")'):
    return f"""
    SELECT "Identifier", {reference} AS "ReferenceTime", min("DeliveryStart") AS "DeliveryStart",
           max("DeliveryEnd") AS "DeliveryEnd", CAST(NULL AS BIGINT) AS "RelativeDeliveryPeriod",
           CAST(NULL AS BIGINT) AS "LegacyDeliveryBucketNumber", bucket AS "DeliveryBucket",
           round(sum("Volume"), 2) AS "TotalVolume", max("SettlementPrice") AS "TopPrice"
    FROM (SELECT *, {bucket} AS bucket FROM curve_points)
    GROUP BY "Identifier", curve_points."ReferenceTime", bucket""".replace('curve_points."ReferenceTime"', '"ReferenceTime"')


def _bucket_plan(name, period, bucket, **arguments):
    @plan(name, with_sql("curve_points", _bucket_sql(bucket)))
    def build(spark, sf):
        rows = aggregate_delivery(
            fx.curve_points(spark, sf), period,
            [("SUM", "Volume", "TotalVolume"), ("MAX", "SettlementPrice", "TopPrice")], **arguments,
        )
        return rows.withColumn("TotalVolume", F.round("TotalVolume", 2))

    return build


_bucket_plan(
    "agg_bucket_hour", "PT6H",
    f"""{_ANCHOR} + to_hours(date_diff('hour', {_ANCHOR}, "DeliveryStart") // 6 * 6)""",
)
_bucket_plan(
    "agg_bucket_minute", "PT90M",
    f"""{_ANCHOR} + to_minutes(date_diff('minute', {_ANCHOR}, "DeliveryStart") // 90 * 90)""",
)
_bucket_plan("agg_bucket_day", "P3D", f"""{_ANCHOR} + to_days(CAST({_DAY_NUMBER} // 3 * 3 AS INTEGER))""")
_bucket_plan(
    "agg_bucket_week", "P2W",
    """TIMESTAMP '2000-01-03' + to_days(CAST(CAST(floor(
        date_diff('day', DATE '2000-01-02', CAST("DeliveryStart" AS DATE)) / 7.0) AS BIGINT) // 2 * 14 AS INTEGER))""",
)
_bucket_plan(
    "agg_bucket_month", "P2M",
    f"""{_ANCHOR} + to_months(CAST(((year("DeliveryStart") - 2000) * 12 + month("DeliveryStart") - 1)
        // 2 * 2 AS INTEGER))""",
)
_bucket_plan(
    "agg_bucket_year", "P2Y",
    f"""{_ANCHOR} + to_years(CAST((year("DeliveryStart") - 2000) // 2 * 2 AS INTEGER))""",
)
_LOCAL = f"""timezone('{ZONE}', timezone('UTC', "DeliveryStart"))"""
_bucket_plan(
    "agg_zone_bucket", "P1D",
    f"""timezone('UTC', timezone('{ZONE}', CAST(date_trunc('day', {_LOCAL}) AS TIMESTAMP)))""",
    zone=ZONE,
)


@plan("agg_functions", with_sql("curve_points", """
    SELECT "Identifier", "ReferenceTime", CAST(date_trunc('month', "DeliveryStart") AS TIMESTAMP) AS "Month",
           round(avg("SettlementPrice"), 8) AS "AvgPrice", round(sum("SettlementPrice"), 2) AS "SumPrice",
           min("SettlementPrice") AS "MinPrice", max("SettlementPrice") AS "MaxPrice",
           CAST(count("SettlementPrice") AS BIGINT) AS "CountPrice", CAST(count(*) AS BIGINT) AS "CountAll"
    FROM curve_points GROUP BY "Identifier", "ReferenceTime", date_trunc('month', "DeliveryStart")"""))
def agg_functions_plan(spark, sf):
    rows = aggregate_delivery(
        fx.curve_points(spark, sf), "P1M",
        [
            ("AVG", "SettlementPrice", "AvgPrice"), ("SUM", "SettlementPrice", "SumPrice"),
            ("MIN", "SettlementPrice", "MinPrice"), ("MAX", "SettlementPrice", "MaxPrice"),
            ("COUNT", "SettlementPrice", "CountPrice"), ("COUNT", "*", "CountAll"),
        ],
        alias="Month",
    )
    return rows.select(
        "Identifier", "ReferenceTime", "Month", F.round("AvgPrice", 8).alias("AvgPrice"),
        F.round("SumPrice", 2).alias("SumPrice"), "MinPrice", "MaxPrice", "CountPrice", "CountAll",
    )


@plan("agg_carry_columns", with_sql("curve_points", """
    SELECT "Identifier", bucket AS "ReferenceTime", "DeliveryStart", "DeliveryEnd",
           CAST(NULL AS BIGINT) AS "RelativeDeliveryPeriod", CAST(NULL AS BIGINT) AS "LegacyDeliveryBucketNumber", n
    FROM (SELECT "Identifier", CAST(date_trunc('month', "ReferenceTime") AS TIMESTAMP) AS bucket, "ReferenceTime",
                 min("DeliveryStart") AS "DeliveryStart", max("DeliveryEnd") AS "DeliveryEnd",
                 CAST(count(*) AS BIGINT) AS n
          FROM curve_points GROUP BY "Identifier", "ReferenceTime")"""))
def agg_carry_columns_plan(spark, sf):
    return aggregate_delivery(
        fx.curve_points(spark, sf), "P1M", [("COUNT", "*", "n")], alias="ReferenceTime", bucket_of="ReferenceTime"
    )


@plan("agg_group_plain", with_sql("curve_points", """
    SELECT "Identifier", "ReferenceTime", CAST(date_trunc('day', "DeliveryStart") AS TIMESTAMP) AS "Day",
           "Direction", "Status", CAST(count(*) AS BIGINT) AS n
    FROM curve_points
    GROUP BY "Identifier", "ReferenceTime", date_trunc('day', "DeliveryStart"), "Direction", "Status" """))
def agg_group_plain_plan(spark, sf):
    rows = aggregate_delivery(
        fx.curve_points(spark, sf), "P1D", [("COUNT", "*", "n")], alias="Day", group_by=["Direction", "Status"]
    )
    return rows.select("Identifier", "ReferenceTime", "Day", "Direction", "Status", "n")


@plan("filter_limits", with_sql("curve_points", """
    SELECT "Identifier", min("ReferenceTime") AS "MinReferenceTime", max("ReferenceTime") AS "MaxReferenceTime",
           min("DeliveryStart") AS "MinDeliveryStart", max("DeliveryStart") AS "MaxDeliveryStart"
    FROM curve_points GROUP BY "Identifier" """))
def filter_limits_plan(spark, sf):
    return filter_limits(fx.curve_points(spark, sf))


@plan("agg_versioned", with_sql("versions", """
    SELECT "MdoId" AS "Identifier", min("CreatedOn") AS "DeliveryStart", max("CreatedOn") AS "DeliveryEnd",
           CAST(NULL AS BIGINT) AS "RelativeDeliveryPeriod", "ReferenceTime",
           CAST(date_trunc('hour', "CreatedOn") AS TIMESTAMP) AS "DeliveryBucket",
           CAST(sum(CAST(json_extract_string(payload, '$.k') AS BIGINT)) AS BIGINT) AS "SumK",
           round(avg(CAST(json_extract_string(payload, '$.k') AS BIGINT)), 8) AS "AvgK"
    FROM (SELECT *, row_number() OVER (PARTITION BY "MdoId", "ReferenceTime"
                                       ORDER BY "CreatedOn" DESC, event_id DESC) AS rn FROM versions)
    WHERE rn = 1 AND NOT "Deleted"
    GROUP BY "MdoId", "ReferenceTime", date_trunc('hour', "CreatedOn")"""))
def agg_versioned_plan(spark, sf):
    newest = latest_version(fx.versions(spark, sf), ("MdoId", "ReferenceTime"), tiebreak=("event_id",))
    rows = newest.filter("NOT Deleted").select(
        "MdoId", "ReferenceTime", F.col("CreatedOn").alias("DeliveryStart"), F.col("CreatedOn").alias("DeliveryEnd"),
        json_value("payload", "k", "int").alias("k"),
    )
    result = aggregate_delivery(
        rows, "PT1H", [("SUM", "k", "SumK"), ("AVG", "k", "AvgK")], id_col="MdoId", versioned=True
    )
    return result.withColumn("AvgK", F.round("AvgK", 8))


def flagship(spark, sf):
    """Six-hour delivery buckets of the reference times of one year, in output order."""
    year = tb.interval_of("year", "1998-01-01T00:00:00")
    rows = fx.curve_points(spark, sf).filter(within("ReferenceTime", year))
    result = aggregate_delivery(
        rows, "PT6H", [("AVG", "SettlementPrice", "AvgPrice"), ("SUM", "Volume", "TotalVolume")]
    )
    return result.withColumns(
        {"AvgPrice": F.round("AvgPrice", 8), "TotalVolume": F.round("TotalVolume", 2)}
    ).orderBy("ReferenceTime", "DeliveryBucket")


plan("flagship_delivery_buckets", with_sql("curve_points", f"""
    SELECT "Identifier", "ReferenceTime", min("DeliveryStart") AS "DeliveryStart", max("DeliveryEnd") AS "DeliveryEnd",
           CAST(NULL AS BIGINT) AS "RelativeDeliveryPeriod", CAST(NULL AS BIGINT) AS "LegacyDeliveryBucketNumber",
           bucket AS "DeliveryBucket", round(avg("SettlementPrice"), 8) AS "AvgPrice",
           round(sum("Volume"), 2) AS "TotalVolume"
    FROM (SELECT *, {_ANCHOR} + to_hours(date_diff('hour', {_ANCHOR}, "DeliveryStart") // 6 * 6) AS bucket
          FROM curve_points WHERE "ReferenceTime" >= TIMESTAMP '1998-01-01'
                              AND "ReferenceTime" < TIMESTAMP '1999-01-01')
    GROUP BY "Identifier", "ReferenceTime", bucket"""))(flagship)


# --- relative delivery period --------------------------------------------

def _units(seconds):
    """Whole units since 1970 of both times, by integer division of epoch seconds."""
    return (f"""CAST(floor(epoch("DeliveryStart") / {seconds}.0) - floor(epoch("ReferenceTime") / {seconds}.0)
             AS BIGINT)""")


_MONTHS = """((year("DeliveryStart") - year("ReferenceTime")) * 12
             + month("DeliveryStart") - month("ReferenceTime"))"""
_QUARTERS = """((year("DeliveryStart") - year("ReferenceTime")) * 4
             + quarter("DeliveryStart") - quarter("ReferenceTime"))"""
_HALF = "(CASE WHEN month({0}) <= 6 THEN 0 ELSE 1 END)"
_HALVES = f"""((year("DeliveryStart") - year("ReferenceTime")) * 2
             + {_HALF.format('"DeliveryStart"')} - {_HALF.format('"ReferenceTime"')})"""


def _gas(column):
    """Nine months earlier with days rolling over: first of the month, back nine months, plus the days."""
    return (f"""(CAST(date_trunc('month', {column}) AS TIMESTAMP) - to_months(9)
             + to_days(CAST(day({column}) - 1 AS INTEGER)))""")


_GAS_START, _GAS_REFERENCE = _gas('"DeliveryStart"'), _gas('"ReferenceTime"')
_GAS_HALVES = (f"((year({_GAS_START}) - year({_GAS_REFERENCE})) * 2"
               f" + {_HALF.format(_GAS_START)} - {_HALF.format(_GAS_REFERENCE)})")
_GAS_YEARS = f"(year({_GAS_START}) - year({_GAS_REFERENCE}))"
_WEEKS = """(date_diff('day', date_trunc('week', "ReferenceTime"), date_trunc('week', "DeliveryStart")) // 7)"""
_DAYS = """(CAST(epoch_us("DeliveryStart") - epoch_us("ReferenceTime") AS BIGINT) // 86400000000)"""


def _rdp_plan(name, columns):
    """``columns``: output name -> (resolution, delivery resolution, SQL)."""
    listed = ", ".join(f'CAST({sql} AS BIGINT) AS "{alias}"' for alias, (_, _, sql) in columns.items())

    @plan(name, with_sql("order_delivery", f"""
        SELECT "Identifier", "ReferenceTime", "DeliveryStart", {listed} FROM order_delivery"""))
    def build(spark, sf):
        return fx.order_delivery(spark, sf).select(
            "Identifier", "ReferenceTime", "DeliveryStart",
            *[
                relative_delivery_period(
                    "ReferenceTime", "DeliveryStart", resolution, delivery_resolution=delivery
                ).alias(alias)
                for alias, (resolution, delivery, _) in columns.items()
            ],
        )

    return build


_rdp_plan("rdp_hours", {"hours": ("PT1H", "", _units(3600))})
_rdp_plan("rdp_minutes", {
    "half_hours": ("PT30M", "", _units(1800)), "quarter_hours": ("PT15M", "", _units(900)),
    "five_minutes": ("PT5M", "", _units(300)), "minutes": ("PT1M", "", _units(60)),
})
_rdp_plan("rdp_seconds", {"four_seconds": ("PT4S", "", _units(4))})
_rdp_plan("rdp_days", {"days": ("P1D", "", _DAYS)})
_rdp_plan("rdp_weeks", {"weeks": ("P1W", "", _WEEKS)})
_rdp_plan("rdp_months", {"months": ("P1M", "", _MONTHS)})
_rdp_plan("rdp_quarters", {"quarters": ("P3M", "", _QUARTERS)})
_rdp_plan("rdp_halfyears", {
    "half_years": ("P6M", "", _HALVES), "gas_seasons": ("P6M", "Season", _GAS_HALVES),
})
_rdp_plan("rdp_years", {
    "years": ("P1Y", "", """(year("DeliveryStart") - year("ReferenceTime"))"""),
    "gas_years": ("P1Y", "Year", _GAS_YEARS),
})


@plan("rdp_by_resolution", with_sql("curve_points mapping_rows", f"""
    SELECT "Identifier", "ReferenceTime", "DeliveryStart", resolution,
           CAST(CASE resolution WHEN 'PT1H' THEN {_units(3600)} WHEN 'P1D' THEN {_DAYS} WHEN 'P1M' THEN {_MONTHS} END
                AS BIGINT) AS "RelativeDeliveryPeriod"
    FROM curve_points JOIN (SELECT DISTINCT series_id, resolution FROM mapping_rows) ON "Identifier" = series_id"""))
def rdp_by_resolution_plan(spark, sf):
    rows = fx.curve_points(spark, sf).select("Identifier", "ReferenceTime", "DeliveryStart")
    rows = with_mapping(rows, series_of(fx.mapping_rows(spark, sf)), ["resolution"])
    period = relative_delivery_period_by("ReferenceTime", "DeliveryStart", "resolution")
    return rows.withColumn("RelativeDeliveryPeriod", period)


# --- scalar functions ----------------------------------------------------

@plan("quote_index", with_sql("curve_points", """
    SELECT "ReferenceTime", quote_index,
           CAST(strftime("DeliveryStart", '%Y%m%d') AS INTEGER) AS delivery_index FROM curve_points"""))
def quote_index_plan(spark, sf):
    return fx.curve_points(spark, sf).select(
        "ReferenceTime", "quote_index", quote_index("DeliveryStart").alias("delivery_index")
    )


@plan("to_target_zone", with_sql("curve_points", f"""
    SELECT "Identifier", timezone('{ZONE}', timezone('UTC', "ReferenceTime")) AS "ReferenceTime",
           timezone('{ZONE}', timezone('UTC', "DeliveryStart")) AS "DeliveryStart", "SettlementPrice"
    FROM curve_points"""))
def to_target_zone_plan(spark, sf):
    rows = fx.curve_points(spark, sf).select("Identifier", "ReferenceTime", "DeliveryStart", "SettlementPrice")
    return to_target_zone(rows, ZONE)


def _offset_text(zone, column):
    local = f"timezone('{zone}', timezone('UTC', {column}))"
    minutes = f"date_diff('minute', {column}, {local})"
    return (f"""strftime({local}, '%Y-%m-%dT%H:%M:%S.%g') || CASE WHEN {minutes} < 0 THEN '-' ELSE '+' END
             || lpad(CAST(abs({minutes}) // 60 AS VARCHAR), 2, '0') || ':'
             || lpad(CAST(abs({minutes}) % 60 AS VARCHAR), 2, '0')""")


@plan("format_timestamp", with_sql("curve_points", f"""
    SELECT "DeliveryStart", {_offset_text(ZONE, '"DeliveryStart"')} AS zurich,
           {_offset_text("America/St_Johns", '"DeliveryStart"')} AS st_johns,
           strftime("DeliveryStart", '%Y-%m-%dT%H:%M:%S.%g') AS plain
    FROM curve_points"""))
def format_timestamp_plan(spark, sf):
    return fx.curve_points(spark, sf).select(
        "DeliveryStart",
        format_timestamp("DeliveryStart", ZONE).alias("zurich"),
        format_timestamp("DeliveryStart", "America/St_Johns").alias("st_johns"),
        format_timestamp("DeliveryStart", offset=False).alias("plain"),
    )


@plan("adaptive_round", with_sql("archive_hours", """
    SELECT ts_id, quote_index, round(value * 1e10) / 1e10 AS rounded, round(-value * 1e10) / 1e10 AS negated
    FROM archive_hours"""))
def adaptive_round_plan(spark, sf):
    return fx.archive_hours(spark, sf).select(
        "ts_id", "quote_index", adaptive_round("value").alias("rounded"),
        adaptive_round(-F.col("value")).alias("negated"),
    )


@plan("format_number", with_sql("curve_points", r"""
    SELECT "SettlementPrice", regexp_replace(CAST("SettlementPrice" AS VARCHAR), '\.0$', '') AS price,
           regexp_replace(CAST("SettlementPrice" * 1000 AS VARCHAR), '\.0$', '') AS large,
           regexp_replace(CAST(-"SettlementPrice" / 7 AS VARCHAR), '\.0$', '') AS negative,
           rtrim(printf('%.10f', "Volume" / 1000000), '0') AS small
    FROM curve_points"""))
def format_number_plan(spark, sf):
    price, volume = F.col("SettlementPrice"), F.col("Volume")
    return fx.curve_points(spark, sf).select(
        "SettlementPrice",
        format_number(price).alias("price"),
        format_number(price * 1000).alias("large"),
        format_number(-price / 7).alias("negative"),
        format_number(volume / 1000000).alias("small"),
    )


@plan("normalize_category", with_sql("mapping_rows", """
    SELECT series_id, category, CASE lower(category) WHEN 'curve' THEN 'curves' WHEN 'surfaces' THEN 'surfaces'
           WHEN 'time series' THEN 'timeseries' END AS normalized,
           CASE lower(resolution) WHEN 'curve' THEN 'curves' ELSE 'surfaces' END AS fallback
    FROM mapping_rows"""))
def normalize_category_plan(spark, sf):
    return fx.mapping_rows(spark, sf).select(
        "series_id", "category", normalize_category("category").alias("normalized"),
        normalize_category("resolution", "surfaces").alias("fallback"),
    )


@plan("derive_source", with_sql("mapping_rows", """
    SELECT series_id, CASE WHEN versioned_id IS NOT NULL OR lower(switchover) LIKE 'mds%' THEN 'versioned'
           WHEN coalesce(archive_id, '') <> '' THEN 'archive' ELSE 'recent' END AS source
    FROM mapping_rows"""))
def derive_source_plan(spark, sf):
    return fx.mapping_rows(spark, sf).select("series_id", derive_source().alias("source"))


@plan("series_zone", with_sql("mapping_rows", """
    SELECT series_id, coalesce(timezone, 'Europe/Zurich') AS zone FROM mapping_rows"""))
def series_zone_plan(spark, sf):
    return fx.mapping_rows(spark, sf).select("series_id", series_zone().alias("zone"))
