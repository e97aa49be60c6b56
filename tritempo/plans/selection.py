"""Plans for projections, versions, latest selection, ranks and orderings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tritempo.functions import timebounds as tb
from tritempo.functions.mapped import json_value
from tritempo.functions.timecols import ntz
from tritempo.operators import project as pr
from tritempo.operators import versions as v
from tritempo.operators.aggregate import aggregate_delivery
from tritempo.operators.archive import archive_decode
from tritempo.operators.hybrid import latest_global
from tritempo.operators.rank import rank_over
from tritempo.operators.sort import sort_aggregated, sort_mapped, sort_output, sort_versioned
from tritempo.plans import fixtures as fx
from tritempo.plans.fixtures import ZONE, with_sql
from tritempo.plans.registry import plan

KEYS = ("MdoId", "ReferenceTime")
TIE = ("event_id",)
AS_OF = tb.point("2024-01-15T12:00:00")
LATEST_ARGUMENT = tb.point("2024-01-20T00:00:00")

_NEWEST = """newest AS (SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY "MdoId", "ReferenceTime" ORDER BY "CreatedOn" DESC, event_id DESC) AS rn
    FROM versions) WHERE rn = 1)"""
_KNOWN = """known AS (SELECT * FROM versions WHERE "CreatedOn" <= TIMESTAMP '2024-01-15 12:00:00'),
    newest AS (SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY "MdoId", "ReferenceTime" ORDER BY "CreatedOn" DESC, event_id DESC) AS rn
    FROM known) WHERE rn = 1)"""
_OUT = """SELECT "MdoId", "ReferenceTime", "CreatedOn", "Deleted", "Value", event_id FROM newest """
_COLUMNS = ("MdoId", "ReferenceTime", "CreatedOn", "Deleted", "Value", "event_id")


def _with(extra: str, statement: str) -> str:
    return with_sql("versions", "").rstrip() + ", " + extra + " " + statement


# --- projections ---------------------------------------------------------

@plan("project_mapped", with_sql("curve_points", """
    SELECT "Identifier", "ReferenceTime", "DeliveryStart", "DeliveryEnd", "Volume" FROM curve_points"""))
def project_mapped_plan(spark, sf):
    return pr.project_mapped(fx.recent_view(spark, sf), fx.CURVE_MAPPING, ["volume"])


@plan("column_order", with_sql("curve_points", """
    SELECT 'Identifier,ReferenceTime,DeliveryStart,DeliveryEnd,SettlementPrice,Volume' AS columns,
           concat_ws('|', CAST("Identifier" AS VARCHAR), strftime("ReferenceTime", '%Y-%m-%d %H:%M:%S'),
                     strftime("DeliveryStart", '%Y-%m-%d %H:%M:%S'), strftime("DeliveryEnd", '%Y-%m-%d %H:%M:%S'),
                     CAST(CAST(floor("SettlementPrice") AS BIGINT) AS VARCHAR),
                     CAST(CAST(floor("Volume") AS BIGINT) AS VARCHAR)) AS row_text
    FROM curve_points"""))
def column_order_plan(spark, sf):
    shuffled = [fx.CURVE_MAPPING[place] for place in (5, 3, 0, 4, 1, 2)]
    rows = pr.project_mapped(fx.recent_view(spark, sf), shuffled)
    texts = [(F.floor(name) if kind == "double" else F.col(name)).cast("string") for name, kind in rows.dtypes]
    return rows.select(F.lit(",".join(rows.columns)).alias("columns"), F.concat_ws("|", *texts).alias("row_text"))


@plan("project_requested", with_sql("versions", """
    SELECT "ReferenceTime", CAST(json_extract_string(payload, '$.k') AS BIGINT) AS k, "CreatedOn" FROM versions"""))
def project_requested_plan(spark, sf):
    rows = pr.logical_versioned(fx.versions(spark, sf), fx.VERSION_MAPPING, "payload")
    return pr.project_requested(rows, fx.VERSION_MAPPING, ["CreatedOn"])


@plan("identifier_visibility", with_sql("versions", """
    SELECT "MdoId" AS "Identifier", "ReferenceTime", CAST(json_extract_string(payload, '$.k') AS BIGINT) AS k
    FROM versions"""))
def identifier_visibility_plan(spark, sf):
    rows = pr.logical_versioned(fx.versions(spark, sf), fx.VERSION_MAPPING, "payload")
    return pr.project_requested(rows, fx.VERSION_MAPPING, keep_identifier=True)


@plan("json_value", with_sql("versions", """
    SELECT event_id, CAST(json_extract_string(payload, '$.k') AS BIGINT) AS as_integer,
           CAST(json_extract_string(payload, '$.k') AS DOUBLE) AS as_number,
           json_extract_string(payload, '$.k') AS as_text, json_extract_string(payload, '$.missing') AS absent
    FROM versions"""))
def json_value_plan(spark, sf):
    return fx.versions(spark, sf).select(
        "event_id",
        json_value("payload", "k", "long").alias("as_integer"),
        json_value("payload", "k", "decimal").alias("as_number"),
        json_value("payload", "k", "varchar").alias("as_text"),
        json_value("payload", "missing").alias("absent"),
    )


@plan("project_versioned", _with(_NEWEST, """
    SELECT "MdoId" AS "Identifier", "ReferenceTime", CAST(json_extract_string(payload, '$.k') AS BIGINT) AS k,
           "CreatedOn" FROM newest"""))
def project_versioned_plan(spark, sf):
    newest = v.latest_version(fx.versions(spark, sf), KEYS, tiebreak=TIE)
    return pr.project_versioned(newest, fx.VERSION_MAPPING, "payload", ["k", "CreatedOn"], keep_identifier=True)


@plan("project_latest_timeseries", _with(_NEWEST, """
    SELECT "MdoId" AS "Identifier", "ReferenceTime",
           CAST(json_extract_string(payload, '$.k') AS BIGINT) AS "Property0", "CreatedOn"
    FROM newest WHERE NOT "Deleted" AND ("MdoId", "ReferenceTime") IN
        (SELECT ("MdoId", max("ReferenceTime")) FROM versions GROUP BY "MdoId")"""))
def project_latest_timeseries_plan(spark, sf):
    rows = v.latest_reference_time(fx.versions(spark, sf), KEYS, tiebreak=TIE)
    return pr.project_latest_timeseries(rows, fx.VERSION_MAPPING, "payload", ["CreatedOn"], keep_identifier=True)


@plan("project_aggregated", with_sql("curve_points", """
    SELECT "Identifier", "ReferenceTime", date_trunc('day', "DeliveryStart")::TIMESTAMP AS "DeliveryBucket",
           max("SettlementPrice") AS "TopPrice"
    FROM curve_points GROUP BY "Identifier", "ReferenceTime", date_trunc('day', "DeliveryStart")"""))
def project_aggregated_plan(spark, sf):
    rows = aggregate_delivery(
        fx.curve_points(spark, sf), "P1D",
        [("MAX", "SettlementPrice", "TopPrice"), ("SUM", "Volume", "TotalVolume")],
    )
    return pr.project_aggregated(rows, ["identifier", "ReferenceTime", "DeliveryBucket", "TopPrice"])


@plan("archive_contract_columns", with_sql("archive_hours", f"""
    SELECT series AS "Identifier",
           timezone('UTC', timezone('{ZONE}', make_timestamp(qte_y, qte_m, qte_d, 0, 0, 0))) AS "ReferenceTime",
           u AS "DeliveryStart", {fx.END_UTC} AS "DeliveryEnd", round(value * 1e10) / 1e10 AS "Value",
           CAST(NULL AS BIGINT) AS "LegacyDeliveryBucketNumber", CAST(NULL AS BIGINT) AS "RelativeDeliveryPeriod"
    FROM archive_hours"""))
def archive_contract_columns_plan(spark, sf):
    rows = archive_decode(fx.archive_hours(spark, sf), zone=ZONE, identifier=fx.archive_series_id())
    return pr.archive_contract_columns(rows, ["Value"])


# --- versions ------------------------------------------------------------

@plan("latest_version", _with(_NEWEST, _OUT))
def latest_version_plan(spark, sf):
    return v.latest_version(fx.versions(spark, sf), KEYS, tiebreak=TIE).select(*_COLUMNS)


@plan("version_as_of", _with(_KNOWN, _OUT + """WHERE NOT "Deleted" """))
def version_as_of_plan(spark, sf):
    return v.version_as_of(fx.versions(spark, sf), AS_OF, KEYS, tiebreak=TIE).select(*_COLUMNS)


@plan("latest_reference_time", _with(_NEWEST, _OUT + """
    WHERE NOT "Deleted" AND ("MdoId", "ReferenceTime") IN
        (SELECT ("MdoId", max("ReferenceTime")) FROM newest GROUP BY "MdoId")"""))
def latest_reference_time_plan(spark, sf):
    return v.latest_reference_time(fx.versions(spark, sf), KEYS, tiebreak=TIE).select(*_COLUMNS)


@plan("latest_before", _with(_NEWEST, _OUT + """
    WHERE NOT "Deleted" AND ("MdoId", "ReferenceTime") IN
        (SELECT ("MdoId", max("ReferenceTime")) FROM newest
         WHERE "ReferenceTime" <= TIMESTAMP '2024-01-20' GROUP BY "MdoId")"""))
def latest_before_plan(spark, sf):
    return v.latest_before(fx.versions(spark, sf), "<=", LATEST_ARGUMENT, KEYS, tiebreak=TIE).select(*_COLUMNS)


@plan("join_latest_scalar", _with(_NEWEST, """
    SELECT newest."MdoId", newest."ReferenceTime", newest."CreatedOn", newest."Deleted" FROM newest
    JOIN (SELECT "MdoId", max("ReferenceTime") AS top FROM newest
          WHERE "ReferenceTime" < TIMESTAMP '2024-01-11' GROUP BY "MdoId") AS t
      ON newest."MdoId" = t."MdoId" AND newest."ReferenceTime" = t.top"""))
def join_latest_scalar_plan(spark, sf):
    rows = v.latest_before(
        fx.versions(spark, sf), "<", tb.point("2024-01-11T00:00:00"), KEYS, include_deleted=True, tiebreak=TIE
    )
    return rows.select("MdoId", "ReferenceTime", "CreatedOn", "Deleted")


@plan("latest_before_as_of", _with(_KNOWN, _OUT + """
    WHERE NOT "Deleted" AND ("MdoId", "ReferenceTime") IN
        (SELECT ("MdoId", max("ReferenceTime")) FROM known
         WHERE "ReferenceTime" <= TIMESTAMP '2024-01-20' GROUP BY "MdoId")"""))
def latest_before_as_of_plan(spark, sf):
    rows = v.latest_before(fx.versions(spark, sf), "<=", LATEST_ARGUMENT, KEYS, as_of=AS_OF, tiebreak=TIE)
    return rows.select(*_COLUMNS)


@plan("top_reference_time", _with(_KNOWN, """
    SELECT "MdoId", max("ReferenceTime") AS "MaxReferenceTimeBefore" FROM known
    WHERE "ReferenceTime" <= TIMESTAMP '2024-01-20' GROUP BY "MdoId" """))
def top_reference_time_plan(spark, sf):
    known = fx.versions(spark, sf).filter(
        (F.col("CreatedOn") <= ntz(AS_OF)) & (F.col("ReferenceTime") <= ntz(LATEST_ARGUMENT))
    )
    return v.max_reference_time(known, "MdoId", output="MaxReferenceTimeBefore")


@plan("latest_reference_time_as_of", _with(_KNOWN, _OUT + """
    WHERE NOT "Deleted" AND ("MdoId", "ReferenceTime") IN
        (SELECT ("MdoId", max("ReferenceTime")) FROM known GROUP BY "MdoId")"""))
def latest_reference_time_as_of_plan(spark, sf):
    return v.latest_reference_time(fx.versions(spark, sf), KEYS, as_of=AS_OF, tiebreak=TIE).select(*_COLUMNS)


@plan("latest_global_recent", with_sql("curve_points", """
    SELECT "Identifier", "ReferenceTime", "DeliveryStart", "SettlementPrice", "Volume" FROM curve_points
    WHERE ("Identifier", "ReferenceTime") IN
        (SELECT ("Identifier", max("ReferenceTime")) FROM curve_points GROUP BY "Identifier")"""))
def latest_global_recent_plan(spark, sf):
    rows = fx.curve_points(spark, sf).select(
        "Identifier", "ReferenceTime", "DeliveryStart", "SettlementPrice", "Volume"
    )
    return latest_global(rows)


@plan("with_created_on", _with(_NEWEST, """
    SELECT "ReferenceTime", CAST(json_extract_string(payload, '$.k') AS BIGINT) AS k, "CreatedOn"
    FROM newest WHERE NOT "Deleted" """))
def with_created_on_plan(spark, sf):
    newest = v.latest_version(fx.versions(spark, sf), KEYS, tiebreak=TIE).filter("NOT Deleted")
    return pr.project_versioned(newest, fx.VERSION_MAPPING, "payload", ["k", "CreatedOn"])


# --- rank ----------------------------------------------------------------

_RANKED = """
    SELECT "Identifier", "ReferenceTime", "DeliveryStart", "SettlementPrice" FROM (
        SELECT *, rank() OVER (PARTITION BY {group} ORDER BY {order}) AS r FROM curve_points)
    WHERE {bound}"""
_BY_DAY = """ "Identifier", "ReferenceTime" """
_BY_ID = """ "Identifier" """


def _rank_plan(name, group, order, bound, arguments):
    @plan(name, with_sql("curve_points", _RANKED.format(group=group, order=order, bound=bound)))
    def build(spark, sf):
        rows = fx.curve_points(spark, sf).select("Identifier", "ReferenceTime", "DeliveryStart", "SettlementPrice")
        return rank_over(rows, *arguments)

    return build


_rank_plan("rank_first", _BY_DAY, '"SettlementPrice" DESC', "r = 1",
           (["ReferenceTime"], [("SettlementPrice", "desc")]))
_rank_plan("rank_exact", _BY_ID, '"ReferenceTime" DESC', "r = 3",
           (["Identifier"], [("ReferenceTime", "desc")], (3,)))
_rank_plan("rank_range", _BY_ID, '"ReferenceTime" DESC, "DeliveryStart" ASC', "r BETWEEN 2 AND 5",
           (["Identifier"], [("ReferenceTime", "desc"), ("DeliveryStart", "asc")], (2, 5)))
_rank_plan("rank_open", _BY_DAY, '"SettlementPrice" DESC', "r >= 2",
           (["ReferenceTime"], [("SettlementPrice", "desc")], (2, "last")))


# --- orderings -----------------------------------------------------------

@plan("sort_mapped", with_sql("curve_points", """
    SELECT "Identifier", "ReferenceTime", "DeliveryStart", "DeliveryEnd", "SettlementPrice", "Volume"
    FROM curve_points ORDER BY 1, 2, 3, 4"""))
def sort_mapped_plan(spark, sf):
    return sort_mapped(pr.project_mapped(fx.recent_view(spark, sf), fx.CURVE_MAPPING), fx.CURVE_MAPPING)


@plan("sort_versioned", _with(_NEWEST, """
    SELECT "MdoId" AS "Identifier", "ReferenceTime", CAST(json_extract_string(payload, '$.k') AS BIGINT) AS k
    FROM newest ORDER BY 1, 2"""))
def sort_versioned_plan(spark, sf):
    newest = v.latest_version(fx.versions(spark, sf), KEYS, tiebreak=TIE)
    rows = pr.project_versioned(newest, fx.VERSION_MAPPING, "payload", keep_identifier=True)
    return sort_versioned(rows, fx.VERSION_MAPPING, keep_identifier=True)


@plan("sort_output", with_sql("curve_points", """
    SELECT "Identifier", "ReferenceTime", "DeliveryStart", "SettlementPrice" FROM curve_points ORDER BY 2, 3"""))
def sort_output_plan(spark, sf):
    rows = fx.curve_points(spark, sf).select("Identifier", "ReferenceTime", "DeliveryStart", "SettlementPrice")
    return sort_output(rows)


@plan("sort_aggregated", with_sql("curve_points", """
    SELECT "Identifier", "ReferenceTime", date_trunc('day', "DeliveryStart")::TIMESTAMP AS "DeliveryBucket",
           CAST(count(*) AS BIGINT) AS n
    FROM curve_points GROUP BY "Identifier", "ReferenceTime", date_trunc('day', "DeliveryStart") ORDER BY 2, 3"""))
def sort_aggregated_plan(spark, sf):
    rows = aggregate_delivery(fx.curve_points(spark, sf), "P1D", [("COUNT", "*", "n")])
    return sort_aggregated(rows.select("Identifier", "ReferenceTime", "DeliveryBucket", "n"))
