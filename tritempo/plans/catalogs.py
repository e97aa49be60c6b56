"""Plans for the mapping catalog, unions and outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tritempo.functions.catalogcols import route_source, switchover_group
from tritempo.functions.timecols import format_timestamp
from tritempo.operators import catalog as cat
from tritempo.operators.archive import archive_decode, archive_rows
from tritempo.operators.hybrid import hybrid_union, union_requests
from tritempo.operators.sort import sort_output
from tritempo.plans import fixtures as fx
from tritempo.plans.fixtures import ZONE, with_sql
from tritempo.plans.registry import plan
from tritempo.sinks.text import csv_rows, generic_target_zone, includes_offset, json_rows, union_categories
from tritempo.streaming.batches import column_batches

_COLUMNS = """series_id, category, source, resolution, archive_id, versioned_id, switchover, split_query, timezone,
    column_ordinal, logical, physical, data_type, is_key, is_projectable, order_priority, key_ordering,
    value_ordering"""


@plan("mapping_flags", with_sql("mapping_rows_versioned", f"SELECT {_COLUMNS} FROM mapping_rows_versioned"))
def mapping_flags_plan(spark, sf):
    return cat.versioned_rows(fx.mapping_rows_versioned_raw(spark, sf))


@plan("mapping_nest", with_sql("mapping_rows", """
    SELECT series_id, first(category) AS category, first(source) AS source, first(timezone) AS timezone,
           coalesce(first(split_query), TRUE) AS split_query, CAST(count(*) AS INTEGER) AS n_columns,
           string_agg(logical, ',' ORDER BY column_ordinal) AS names
    FROM mapping_rows GROUP BY series_id"""))
def mapping_nest_plan(spark, sf):
    nested = cat.mapping_nest(fx.mapping_rows(spark, sf))
    return nested.select(
        "series_id", "category", "source", "timezone", "split_query", F.size("columns").alias("n_columns"),
        F.array_join("columns.logical", ",").alias("names"),
    )


@plan("mapping_switchover", with_sql("mapping_rows", """
    SELECT series_id, switchover, CASE WHEN starts_with(lower(switchover), 'mds') THEN 'versioned'
           WHEN starts_with(lower(switchover), 'cmdp') THEN 'recent' ELSE 'none' END AS switchover_group
    FROM mapping_rows"""))
def mapping_switchover_plan(spark, sf):
    return fx.mapping_rows(spark, sf).select(
        "series_id", "switchover", switchover_group().alias("switchover_group")
    )


def _enriched(versioned, originals):
    """SQL: versioned rows with attributes of their original, first original by id."""
    return f"""
        SELECT t.* EXCLUDE (switchover, timezone),
               CASE WHEN o.target IS NOT NULL THEN o.switchover ELSE t.switchover END AS switchover,
               CASE WHEN o.target IS NOT NULL THEN coalesce(nullif(t.timezone, ''), o.timezone) ELSE t.timezone END
                   AS timezone
        FROM ({versioned}) AS t LEFT JOIN (
            SELECT * FROM (
                SELECT coalesce(versioned_id, series_id) AS target, switchover, timezone,
                       row_number() OVER (PARTITION BY coalesce(versioned_id, series_id)
                                          ORDER BY series_id, column_ordinal) AS rn
                FROM ({originals})) WHERE rn = 1) AS o ON t.series_id = o.target"""


_GROUPED = """grouped AS (
    SELECT *, CASE WHEN lower(switchover) LIKE 'mds%' THEN 'versioned'
                   WHEN lower(switchover) LIKE 'cmdp%' THEN 'recent' ELSE 'none' END AS g FROM mapping_rows)"""
_FORCED = "* REPLACE (CAST(NULL AS BIGINT) AS versioned_id, 'recent' AS source)"


def _resolve_sql(body):
    head = with_sql("mapping_rows mapping_rows_versioned", "").rstrip()
    return f"{head}, {_GROUPED} {body}"


@plan("mapping_enrich", _resolve_sql(f"""
    SELECT {_COLUMNS} FROM ({_enriched("SELECT * FROM mapping_rows_versioned", "SELECT * FROM mapping_rows")})"""))
def mapping_enrich_plan(spark, sf):
    return cat.mapping_enrich(fx.mapping_rows_versioned(spark, sf), fx.mapping_rows(spark, sf))


_REGULAR = f"""
    SELECT {_COLUMNS} FROM ({_enriched(
        '''SELECT * FROM mapping_rows_versioned WHERE series_id IN (
               SELECT coalesce(versioned_id, series_id) FROM grouped WHERE g = 'versioned'
               UNION SELECT series_id FROM grouped WHERE g = 'none' AND versioned_id IS NOT NULL)''',
        "SELECT * FROM grouped WHERE g = 'versioned'")})
    UNION ALL SELECT {_COLUMNS} FROM (SELECT {_FORCED} FROM grouped WHERE g = 'recent')
    UNION ALL SELECT {_COLUMNS} FROM grouped WHERE g = 'none' AND versioned_id IS NULL"""
_MIGRATION = f"""
    SELECT {_COLUMNS} FROM ({_enriched(
        '''SELECT * FROM mapping_rows_versioned WHERE series_id IN (
               SELECT coalesce(versioned_id, series_id) FROM grouped WHERE g = 'recent'
               UNION SELECT series_id FROM grouped WHERE g = 'none')''',
        "SELECT * FROM grouped WHERE g = 'recent'")})
    UNION ALL SELECT {_COLUMNS} FROM (SELECT {_FORCED} FROM grouped WHERE g = 'versioned')"""


@plan("resolve_regular", _resolve_sql(_REGULAR))
def resolve_regular_plan(spark, sf):
    return cat.resolve_regular(fx.mapping_rows(spark, sf), fx.mapping_rows_versioned(spark, sf))


@plan("resolve_migration", _resolve_sql(_MIGRATION))
def resolve_migration_plan(spark, sf):
    return cat.resolve_migration(fx.mapping_rows(spark, sf), fx.mapping_rows_versioned(spark, sf))


@plan("resolve_by_stage", _resolve_sql(f"""
    SELECT 'design' AS stage, {_COLUMNS} FROM mapping_rows_versioned
    UNION ALL SELECT 'migration', * FROM ({_MIGRATION}) UNION ALL SELECT 'production', * FROM ({_REGULAR})"""))
def resolve_by_stage_plan(spark, sf):
    recent, versioned = fx.mapping_rows(spark, sf), fx.mapping_rows_versioned(spark, sf)
    parts = [
        cat.resolve_by_stage(recent, versioned, stage).withColumn("stage", F.lit(stage))
        for stage in ("design", "migration", "production")
    ]
    return union_requests(*parts)


@plan("route_source", with_sql("mapping_rows", """
    SELECT series_id, CASE WHEN source = 'versioned' OR versioned_id IS NOT NULL THEN 'versioned'
               WHEN source = 'recent' OR coalesce(archive_id, '') = ''
                    OR coalesce(timezone, '') NOT IN ('', 'Europe/Zurich') THEN 'recent'
               ELSE 'archive' END AS plain,
           CASE WHEN source = 'versioned' OR versioned_id IS NOT NULL THEN 'versioned' ELSE 'recent' END AS aggregated
    FROM mapping_rows"""))
def route_source_plan(spark, sf):
    return fx.mapping_rows(spark, sf).select(
        "series_id", route_source().alias("plain"), route_source(aggregation=True).alias("aggregated")
    )


@plan("data_with_mapping", with_sql("curve_points mapping_rows", """
    SELECT "Identifier", "ReferenceTime", "DeliveryStart", "SettlementPrice", resolution, source, timezone
    FROM curve_points
    JOIN (SELECT DISTINCT series_id, resolution, source, timezone FROM mapping_rows) ON "Identifier" = series_id"""))
def data_with_mapping_plan(spark, sf):
    rows = fx.curve_points(spark, sf).select("Identifier", "ReferenceTime", "DeliveryStart", "SettlementPrice")
    return cat.with_mapping(rows, cat.series_of(fx.mapping_rows(spark, sf)), ["resolution", "source", "timezone"])


@plan("distinct_ids", with_sql("mapping_rows", "SELECT DISTINCT series_id FROM mapping_rows"))
def distinct_ids_plan(spark, sf):
    return cat.distinct_ids(fx.mapping_rows(spark, sf))


@plan("archive_rows", with_sql("archive_hours mapping_rows", f"""
    SELECT series_id AS "Identifier", "ReferenceTime", "DeliveryStart", "DeliveryEnd",
           CAST(CASE resolution
               WHEN 'PT1H' THEN floor(epoch("DeliveryStart") / 3600.0) - floor(epoch("ReferenceTime") / 3600.0)
               WHEN 'P1D' THEN CAST(epoch_us("DeliveryStart") - epoch_us("ReferenceTime") AS BIGINT) // 86400000000
               WHEN 'P1M' THEN (year("DeliveryStart") - year("ReferenceTime")) * 12
                               + month("DeliveryStart") - month("ReferenceTime") END AS BIGINT)
               AS "RelativeDeliveryPeriod", "Value"
    FROM (SELECT series_id, resolution, u AS "DeliveryStart",
                 {fx.local_to_utc("(timezone(zone, timezone('UTC', u)) + INTERVAL 1 HOUR)", "zone")} AS "DeliveryEnd",
                 round(value * 1e10) / 1e10 AS "Value",
                 timezone('UTC', timezone(zone, make_timestamp(qte_y, qte_m, qte_d, 0, 0, 0))) AS "ReferenceTime"
          FROM archive_hours
          JOIN (SELECT DISTINCT series_id, archive_id, resolution, coalesce(timezone, 'Europe/Zurich') AS zone
                FROM mapping_rows WHERE archive_id IS NOT NULL) ON ts_id = archive_id)"""))
def archive_rows_plan(spark, sf):
    rows = archive_rows(fx.archive_hours(spark, sf), cat.series_of(fx.mapping_rows(spark, sf)))
    return rows.select(
        "Identifier", "ReferenceTime", "DeliveryStart", "DeliveryEnd", "RelativeDeliveryPeriod", "Value"
    )


# --- unions --------------------------------------------------------------

@plan("hybrid_union", with_sql("archive_hours curve_points", f"""
    SELECT "Identifier", "ReferenceTime", "DeliveryStart", "Value" FROM (
        SELECT series AS "Identifier",
               timezone('UTC', timezone('{ZONE}', make_timestamp(qte_y, qte_m, qte_d, 0, 0, 0))) AS "ReferenceTime",
               u AS "DeliveryStart", round(value * 1e10) / 1e10 AS "Value" FROM archive_hours) AS a
        LEFT JOIN (SELECT "Identifier" AS i, max("ReferenceTime") AS mark FROM curve_points GROUP BY 1)
            ON i = a."Identifier"
    WHERE mark IS NULL OR "ReferenceTime" < mark
    UNION ALL
    SELECT "Identifier", "ReferenceTime", "DeliveryStart", "SettlementPrice" FROM curve_points AS c
        JOIN (SELECT "Identifier" AS i, max("ReferenceTime") AS mark FROM curve_points GROUP BY 1)
            ON i = c."Identifier"
    WHERE "ReferenceTime" >= mark"""))
def hybrid_union_plan(spark, sf):
    archive = archive_decode(fx.archive_hours(spark, sf), zone=ZONE, identifier=fx.archive_series_id())
    recent = fx.curve_points(spark, sf)
    columns = ("Identifier", "ReferenceTime", "DeliveryStart")
    return hybrid_union(
        archive.select(*columns, "Value"), recent.select(*columns, F.col("SettlementPrice").alias("Value"))
    )


@plan("hybrid_eligible", with_sql("archive_hours curve_points mapping_rows", f"""
    SELECT "Identifier", "ReferenceTime", "DeliveryStart", "Value" FROM (
        SELECT series AS "Identifier",
               timezone('UTC', timezone('{ZONE}', make_timestamp(qte_y, qte_m, qte_d, 0, 0, 0))) AS "ReferenceTime",
               u AS "DeliveryStart", round(value * 1e10) / 1e10 AS "Value" FROM archive_hours) AS a
        JOIN (SELECT "Identifier" AS i, min("ReferenceTime") + INTERVAL 36 MONTH AS mark FROM curve_points GROUP BY 1)
            ON i = a."Identifier"
        JOIN (SELECT DISTINCT series_id, archive_id, series_id % 4 = 0 AS split FROM mapping_rows)
            ON series_id = i
    WHERE archive_id IS NOT NULL AND (NOT split OR "ReferenceTime" < mark)
    UNION ALL
    SELECT "Identifier", "ReferenceTime", "DeliveryStart", "SettlementPrice" FROM curve_points AS c
        JOIN (SELECT "Identifier" AS i, min("ReferenceTime") + INTERVAL 36 MONTH AS mark FROM curve_points GROUP BY 1)
            ON i = c."Identifier"
        JOIN (SELECT DISTINCT series_id, archive_id, series_id % 4 = 0 AS split FROM mapping_rows)
            ON series_id = i
    WHERE archive_id IS NULL OR (split AND "ReferenceTime" >= mark)"""))
def hybrid_eligible_plan(spark, sf):
    # a mark inside the range of times, so that each of the three kinds of series shows
    archive = archive_decode(fx.archive_hours(spark, sf), zone=ZONE, identifier=fx.archive_series_id())
    recent = fx.curve_points(spark, sf)
    marks = recent.groupBy("Identifier").agg(
        F.add_months(F.min("ReferenceTime").cast("date"), 36).cast("timestamp_ntz").alias("Watermark")
    )
    # half of the series with an archive may be split
    series = cat.series_of(fx.mapping_rows(spark, sf)).withColumn("split_query", F.col("series_id") % 4 == 0)
    columns = ("Identifier", "ReferenceTime", "DeliveryStart")
    return hybrid_union(
        archive.select(*columns, "Value"), recent.select(*columns, F.col("SettlementPrice").alias("Value")), marks,
        series=series,
    )


@plan("union_requests", with_sql("curve_points ts_points", """
    SELECT "Identifier", "ReferenceTime", "DeliveryStart", "SettlementPrice", CAST(NULL AS DOUBLE) AS "Value"
    FROM curve_points
    UNION ALL SELECT "Identifier", "ReferenceTime", NULL, NULL, "Value" FROM ts_points"""))
def union_requests_plan(spark, sf):
    return union_requests(
        fx.curve_points(spark, sf).select("Identifier", "ReferenceTime", "DeliveryStart", "SettlementPrice"),
        fx.ts_points(spark, sf).select("Identifier", "ReferenceTime", "Value"),
    )


_NUMBER = r"regexp_replace(CAST({} AS VARCHAR), '\.0$', '')"
_PLAIN_TIME = "strftime({}, '%Y-%m-%dT%H:%M:%S.%g')"


@plan("union_categories", with_sql("curve_points ts_points", f"""
    SELECT CAST("Identifier" AS VARCHAR) AS "Identifier", {_PLAIN_TIME.format('"ReferenceTime"')} AS "ReferenceTime",
           {_PLAIN_TIME.format('"DeliveryStart"')} AS "DeliveryStart",
           {_NUMBER.format('"SettlementPrice"')} AS "SettlementPrice", 'N/A' AS "Value", 'N/A' AS "Status"
    FROM curve_points
    UNION ALL SELECT CAST("Identifier" AS VARCHAR), {_PLAIN_TIME.format('"ReferenceTime"')}, 'N/A', 'N/A',
           {_NUMBER.format('"Value"')}, "Status" FROM ts_points"""))
def union_categories_plan(spark, sf):
    return union_categories(
        fx.curve_points(spark, sf).select("Identifier", "ReferenceTime", "DeliveryStart", "SettlementPrice"),
        fx.ts_points(spark, sf).select("Identifier", "ReferenceTime", "Value", "Status"),
    )


# --- outputs -------------------------------------------------------------

def _offset_time(column, zone=ZONE):
    local = f"timezone('{zone}', timezone('UTC', {column}))"
    hours = f"date_diff('hour', {column}, {local})"
    return f"strftime({local}, '%Y-%m-%dT%H:%M:%S.%g') || '+' || lpad(CAST({hours} AS VARCHAR), 2, '0') || ':00'"


@plan("write_csv", with_sql("curve_points", f"""
    SELECT CAST("Identifier" AS VARCHAR) AS "Identifier", {_offset_time('"ReferenceTime"')} AS "ReferenceTime",
           {_offset_time('"DeliveryStart"')} AS "DeliveryStart",
           {_NUMBER.format('"SettlementPrice"')} AS "SettlementPrice",
           CASE WHEN "Direction" = 'N' THEN 'null' ELSE "Direction" END AS "Direction",
           'N/A' AS "CreatedOn"
    FROM curve_points"""))
def write_csv_plan(spark, sf):
    rows = fx.curve_points(spark, sf).withColumn("Direction", F.when(F.col("Direction") != "N", F.col("Direction")))
    columns = ["Identifier", "ReferenceTime", "DeliveryStart", "SettlementPrice", "Direction", "CreatedOn"]
    return csv_rows(sort_output(rows), columns, zone=ZONE, offset=True)


@plan("column_batches", with_sql("ts_points", f"""
    SELECT "Identifier", batch, CAST(count(*) AS INTEGER) AS rows,
           md5(string_agg({_PLAIN_TIME.format('"ReferenceTime"')} || '+00:00', ',' ORDER BY "ReferenceTime"))
               AS reference_times,
           md5(string_agg(coalesce(CAST(CAST(floor("Value" * 100) AS BIGINT) AS VARCHAR), 'null'), ','
               ORDER BY "ReferenceTime")) AS values,
           md5(string_agg(coalesce("Status", 'null'), ',' ORDER BY "ReferenceTime")) AS statuses
    FROM (SELECT "Identifier", "ReferenceTime", CASE WHEN "Status" <> 'error' THEN "Value" END AS "Value",
                 CASE WHEN "Value" >= 20 THEN "Status" END AS "Status", (row_number() OVER (PARTITION BY "Identifier" ORDER BY "ReferenceTime") - 1) // 25 AS batch
          FROM ts_points)
    GROUP BY "Identifier", batch"""))
def column_batches_plan(spark, sf):
    value, status = F.when(F.col("Status") != "error", F.col("Value")), F.when(F.col("Value") >= 20, F.col("Status"))
    rows = fx.ts_points(spark, sf).select("Identifier", "ReferenceTime", value.alias("Value"), status.alias("Status"))
    batches = column_batches(rows, order=["ReferenceTime"], size=25)
    cents = F.transform("Value", lambda number: F.floor(number * 100).cast("string"))
    return batches.select(
        "Identifier", "batch", "rows", F.md5(F.array_join("ReferenceTime", ",")).alias("reference_times"),
        F.md5(F.array_join(cents, ",", "null")).alias("values"),
        F.md5(F.array_join("Status", ",", "null")).alias("statuses"),
    )


@plan("write_json_rows", with_sql("ts_points", """
    SELECT '{"Identifier":' || CAST("Identifier" AS VARCHAR) || ',"ReferenceTime":["'
           || strftime("ReferenceTime", '%Y-%m-%dT%H:%M:%S.%g') || '+00:00"],"Status":["' || "Status"
           || '"],"Value":[' || CASE WHEN "Status" = 'error' THEN 'null' ELSE CAST("Value" AS VARCHAR) END
           || ']}' AS value
    FROM ts_points"""))
def write_json_rows_plan(spark, sf):
    value = F.when(F.col("Status") != "error", F.col("Value"))
    rows = fx.ts_points(spark, sf).select("Identifier", "ReferenceTime", "Status", value.alias("Value"))
    return json_rows(rows)


@plan("offset_rules", with_sql("curve_points", f"""
    SELECT "DeliveryStart", {_offset_time('"DeliveryStart"')} AS json,
           strftime(timezone('{ZONE}', timezone('UTC', "DeliveryStart")), '%Y-%m-%dT%H:%M:%S.%g') AS csv,
           {_offset_time('"DeliveryStart"')} AS csv_with_offset,
           strftime("DeliveryStart", '%Y-%m-%dT%H:%M:%S.%g') AS generic_csv
    FROM curve_points"""))
def offset_rules_plan(spark, sf):
    def text(zone, mode, offset=None):
        return format_timestamp("DeliveryStart", zone, offset=includes_offset(mode, offset))

    return fx.curve_points(spark, sf).select(
        "DeliveryStart",
        text(ZONE, "json").alias("json"),
        text(ZONE, "csv").alias("csv"),
        text(ZONE, "csv", True).alias("csv_with_offset"),
        text(generic_target_zone(), "csv").alias("generic_csv"),
    )
