"""Plans for scans, filters and calendar shapes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tritempo.functions import predicates as P
from tritempo.functions import timebounds as tb
from tritempo.functions.shape import Shape
from tritempo.operators.archive import archive_decode, delivery_and_relative, delivery_hours, relative_delivery
from tritempo.operators.ids import with_ids
from tritempo.operators.pruning import quote_day_range, quote_index_range
from tritempo.operators.versions import latest_version
from tritempo.functions.mapped import json_value
from tritempo.plans import fixtures as fx
from tritempo.plans.fixtures import ZONE, with_sql
from tritempo.plans.registry import plan
from tritempo.sources.scans import scan_catalog, scan_recent, scan_versioned, with_archive_table

VERSION_KEYS = ("MdoId", "ReferenceTime")


# --- scans ---------------------------------------------------------------

@plan("scan_recent", with_sql("curve_points", """
    SELECT "Identifier", "ReferenceTime", "DeliveryStart", "DeliveryEnd", "SettlementPrice", "Volume"
    FROM curve_points WHERE "Identifier" IN (SELECT s_suppkey FROM supplier)"""))
def scan_recent_plan(spark, sf):
    ids = fx.table(spark, sf, "supplier").select("s_suppkey")
    return scan_recent(fx.recent_view(spark, sf), fx.CURVE_MAPPING, ids)


@plan("scan_versioned", with_sql("versions", """
    SELECT "MdoId", "ReferenceTime", "CreatedOn", "Deleted", "MdoId" AS "Identifier",
           CAST(json_extract_string(payload, '$.k') AS BIGINT) AS k, event_id
    FROM versions"""))
def scan_versioned_plan(spark, sf):
    rows = scan_versioned(fx.versions(spark, sf), fx.VERSION_MAPPING)
    return rows.select("MdoId", "ReferenceTime", "CreatedOn", "Deleted", "Identifier", "k", "event_id")


@plan("archive_decode", with_sql("archive_hours", f"""
    SELECT series AS "Identifier",
           timezone('UTC', timezone('{ZONE}', make_timestamp(qte_y, qte_m, qte_d, 0, 0, 0))) AS "ReferenceTime",
           make_timestamp(del_y, del_m, del_d, del_h, del_min, 0) - to_hours(del_offset) AS "DeliveryStart",
           {fx.END_UTC} AS "DeliveryEnd",
           CAST(NULL AS BIGINT) AS "RelativeDeliveryPeriod", round(value * 1e10) / 1e10 AS "Value",
           CAST(NULL AS BIGINT) AS "LegacyDeliveryBucketNumber"
    FROM archive_hours"""))
def archive_decode_plan(spark, sf):
    return archive_decode(fx.archive_hours(spark, sf), zone=ZONE, identifier=fx.archive_series_id())


@plan("catalog_scan", with_sql("mapping_rows", """
    SELECT series_id, category, source, resolution, archive_id, versioned_id, switchover, split_query, timezone,
           column_ordinal, logical, physical, data_type, is_key, is_projectable, key_ordering, value_ordering
    FROM mapping_rows WHERE series_id IN (SELECT l_suppkey FROM lineitem)"""))
def catalog_scan_plan(spark, sf):
    ids = fx.table(spark, sf, "lineitem").select("l_suppkey")
    return scan_catalog(fx.mapping_rows(spark, sf), ids).drop("order_priority")


@plan("table_by_id_token", with_sql("archive_hours", """
    SELECT ts_id, CASE WHEN contains(ts_id, 'power') THEN 'hpfc' WHEN contains(ts_id, 'gas') THEN 'gas_pfc'
                       WHEN contains(ts_id, 'oil') THEN 'oil_pfc' WHEN contains(ts_id, 'coal') THEN 'coal_pfc' END
                  AS archive_table, CAST(count(*) AS BIGINT) AS n
    FROM archive_hours GROUP BY ALL"""))
def table_by_id_token_plan(spark, sf):
    rows = with_archive_table(fx.archive_hours(spark, sf))
    return rows.groupBy("ts_id", "archive_table").agg(F.count(F.lit(1)).alias("n"))


# --- comparison filters --------------------------------------------------

_CURVE = """SELECT "Identifier", "ReferenceTime", "DeliveryStart", "SettlementPrice", "Volume" FROM curve_points """


def _curve(spark, sf):
    return fx.curve_points(spark, sf).select(
        "Identifier", "ReferenceTime", "DeliveryStart", "SettlementPrice", "Volume"
    )


def _curve_filter(name, where, condition):
    """Register a filter over all curve points."""

    @plan(name, with_sql("curve_points", _CURVE + "WHERE " + where))
    def build(spark, sf):
        return _curve(spark, sf).filter(condition())

    return build


_curve_filter(
    "filter_numeric", """ "SettlementPrice" >= 50000.5 AND "Volume" < 25 """,
    lambda: P.numeric("SettlementPrice", ">=", "50000.5") & P.numeric("Volume", "<", "25"),
)
_curve_filter(
    "filter_point_in_time", """ "ReferenceTime" > TIMESTAMP '1998-05-31 22:00:00' """,
    lambda: P.at("ReferenceTime", ">", tb.point("1998-06-01T00:00:00", ZONE)),
)
_curve_filter(
    "filter_point_arithmetic",
    """ "ReferenceTime" >= TIMESTAMP '1998-03-03 00:00:00' AND "DeliveryStart" < TIMESTAMP '2000-12-31 18:00:00' """,
    lambda: P.at("ReferenceTime", ">=", tb.point("1998-01-31T00:00:00", plus="P1M"))
    & P.at("DeliveryStart", "<", tb.point("2001-01-01T00:00:00", plus="-PT6H")),
)
_curve_filter(
    "filter_zoned_point", """ "DeliveryStart" <= TIMESTAMP '1999-12-31 15:00:00' """,
    lambda: P.at("DeliveryStart", "<=", tb.point("2000-01-01T00:00:00", "Asia/Tokyo")),
)
_curve_filter(
    "filter_interval",
    """ "ReferenceTime" >= TIMESTAMP '1997-12-31 23:00:00' AND "ReferenceTime" < TIMESTAMP '1999-06-30 22:00:00' """,
    lambda: P.within("ReferenceTime", tb.interval("1998-01-01T00:00:00", "1999-07-01T00:00:00", ZONE)),
)
_curve_filter(
    "filter_interval_period",
    """ ("DeliveryStart" >= TIMESTAMP '1998-01-05' AND "DeliveryStart" < TIMESTAMP '1998-01-06')
     OR ("DeliveryStart" >= TIMESTAMP '1998-02-02' AND "DeliveryStart" < TIMESTAMP '1998-02-09')
     OR ("DeliveryStart" >= TIMESTAMP '1998-03-15' AND "DeliveryStart" < TIMESTAMP '1998-04-15')
     OR ("DeliveryStart" >= TIMESTAMP '1998-05-20' AND "DeliveryStart" < TIMESTAMP '1998-08-20')
     OR ("DeliveryStart" >= TIMESTAMP '1999-02-10' AND "DeliveryStart" < TIMESTAMP '2000-02-10') """,
    lambda: P.within("DeliveryStart", tb.interval_of("day", "1998-01-05T00:00:00"))
    | P.within("DeliveryStart", tb.interval_of("week", "1998-02-02T00:00:00"))
    | P.within("DeliveryStart", tb.interval_of("month", "1998-03-15T00:00:00"))
    | P.within("DeliveryStart", tb.interval_of("quarter", "1998-05-20T00:00:00"))
    | P.within("DeliveryStart", tb.interval_of("year", "1999-02-10T00:00:00")),
)
_curve_filter(
    "filter_gas_period",
    """ ("DeliveryStart" >= TIMESTAMP '1998-09-30 22:00:00' AND "DeliveryStart" < TIMESTAMP '1999-09-30 22:00:00') """,
    lambda: P.within("DeliveryStart", tb.gas_interval_of("year", "1998-10-01T00:00:00", ZONE)),
)
_curve_filter(
    "filter_gas_season",
    """ ("DeliveryStart" >= TIMESTAMP '1997-04-01 04:00:00' AND "DeliveryStart" < TIMESTAMP '1997-10-01 04:00:00')
     OR ("DeliveryStart" >= TIMESTAMP '1998-10-01 04:00:00' AND "DeliveryStart" < TIMESTAMP '1999-04-01 04:00:00') """,
    lambda: P.within("DeliveryStart", tb.gas_season("summer", "1997-02-01T00:00:00", ZONE))
    | P.within("DeliveryStart", tb.gas_season("winter", "1999-02-01T00:00:00", ZONE)),
)
_curve_filter(
    "filter_interval_shift",
    """ "ReferenceTime" >= TIMESTAMP '1998-03-31' AND "ReferenceTime" < TIMESTAMP '1999-03-31' """,
    lambda: P.within("ReferenceTime", tb.interval_of("year", "1998-01-31T00:00:00").shifted("+P2M")),
)
_curve_filter(
    "filter_begin_end",
    """ "ReferenceTime" >= TIMESTAMP '1998-04-01' AND "DeliveryStart" <= TIMESTAMP '1998-07-01' """,
    lambda: P.at("ReferenceTime", ">=", tb.interval_of("quarter", "1998-04-01T00:00:00").begin)
    & P.at("DeliveryStart", "<=", tb.interval_of("quarter", "1998-04-01T00:00:00").end),
)


@plan("filter_text", with_sql("surface_points", """
    SELECT "Identifier", "ReferenceTime", "ValidityPeriodStart", "ValidityPeriodEnd", "InstanceCode", "ISP", "BidId",
           "Direction", "Status", "OptionExpiry", "Value"
    FROM surface_points
    WHERE "Direction" = 'R' AND "Status" > 'F' AND "BidId" >= 'B1' AND "OptionExpiry" < '2001-01-01'"""))
def filter_text_plan(spark, sf):
    return fx.surface_points(spark, sf).filter(
        P.text("Direction", "=", "R") & P.text("Status", ">", "F") & P.text("BidId", ">=", "B1")
        & P.text("OptionExpiry", "<", "2001-01-01")
    )


_TS = """SELECT "Identifier", "ReferenceTime", "Value", "Status", event_id FROM ts_points """


def _ts(spark, sf):
    return fx.ts_points(spark, sf).drop("payload")


@plan("filter_now", with_sql("ts_points", _TS + """
    WHERE "ReferenceTime" >= TIMESTAMP '2024-01-13 00:00:00' AND "ReferenceTime" < TIMESTAMP '2024-01-20 06:00:00'"""))
def filter_now_plan(spark, sf):
    at = datetime(2024, 1, 20)
    return _ts(spark, sf).filter(
        P.at("ReferenceTime", ">=", tb.now(at=at, plus="-P7D")) & P.at("ReferenceTime", "<", tb.now(at=at, plus="PT6H"))
    )


@plan("filter_id_list", with_sql("ts_points", _TS + """
    WHERE "Identifier" IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)"""))
def filter_id_list_plan(spark, sf):
    ids = fx.table(spark, sf, "customer").filter("c_acctbal > 0").select("c_custkey")
    return with_ids(_ts(spark, sf), ids)


@plan("filter_lite_range", with_sql("ts_points", _TS + """
    WHERE "ReferenceTime" >= TIMESTAMP '2024-01-05 12:00:00' AND "ReferenceTime" < TIMESTAMP '2024-01-25'"""))
def filter_lite_range_plan(spark, sf):
    return _ts(spark, sf).filter(P.lite_range("2024-01-05T12:00:00", "2024-01-25T00:00:00"))


@plan("filter_deleted", with_sql("versions", """
    SELECT "MdoId", "ReferenceTime", "CreatedOn", event_id FROM (
        SELECT *, row_number() OVER (PARTITION BY "MdoId", "ReferenceTime"
                                     ORDER BY "CreatedOn" DESC, event_id DESC) AS rn FROM versions)
    WHERE rn = 1 AND NOT "Deleted" """))
def filter_deleted_plan(spark, sf):
    newest = latest_version(fx.versions(spark, sf), VERSION_KEYS, tiebreak=("event_id",))
    return newest.filter(P.not_deleted()).select("MdoId", "ReferenceTime", "CreatedOn", "event_id")


@plan("filter_versioned_value", with_sql("versions", """
    SELECT "MdoId", "ReferenceTime", "CreatedOn", CAST(json_extract_string(payload, '$.k') AS BIGINT) AS k
    FROM versions WHERE CAST(json_extract_string(payload, '$.k') AS BIGINT) >= 50"""))
def filter_versioned_value_plan(spark, sf):
    rows = fx.versions(spark, sf).filter(P.numeric(json_value("payload", "k", "int"), ">=", "50"))
    return rows.select("MdoId", "ReferenceTime", "CreatedOn", json_value("payload", "k", "int").alias("k"))


# --- archive filters -----------------------------------------------------

_ARCHIVE = """SELECT ts_id, quote_index, del_y, del_m, del_d, del_h, del_offset, value FROM archive_hours """
_HOUR = "((del_y * 100 + del_m) * 100 + del_d) * 100 + del_h"  # yyyymmddhh, ordered like the four fields
_ARCHIVE_COLUMNS = ("ts_id", "quote_index", "del_y", "del_m", "del_d", "del_h", "del_offset", "value")
_RDP = "date_diff('day', make_date(qte_y, qte_m, qte_d), make_date(del_y, del_m, del_d)) * 24 + del_h"


def _archive(spark, sf):
    return fx.archive_hours(spark, sf)


@plan("filter_delivery_hours", with_sql("archive_hours", _ARCHIVE + """
    WHERE """ + _HOUR + " >= 1998070712 AND " + _HOUR + " <= 1999011013"))
def filter_delivery_hours_plan(spark, sf):
    condition = delivery_hours(
        [
            ("DeliveryStart", ">=", tb.point("1998-07-07T10:00:00Z")),
            ("DeliveryEnd", "<=", tb.point("1999-01-10T13:30:00Z")),
        ],
        ZONE,
    )
    return _archive(spark, sf).filter(condition).select(*_ARCHIVE_COLUMNS)


@plan("filter_relative_delivery", with_sql("archive_hours", _ARCHIVE + f"""
    WHERE {_RDP} >= 24 AND {_RDP} < 49"""))
def filter_relative_delivery_plan(spark, sf):
    condition = relative_delivery(">=", 24) & relative_delivery("<", 49)
    return _archive(spark, sf).filter(condition).select(*_ARCHIVE_COLUMNS)


@plan("filter_delivery_and_relative", with_sql("archive_hours", _ARCHIVE + f"""
    WHERE {_HOUR} >= 1998070702 AND {_HOUR} < 2000070702 AND {_RDP} <= 36"""))
def filter_delivery_and_relative_plan(spark, sf):
    bounds = [("DeliveryStart", "in", tb.interval("1998-07-07T00:00:00Z", "2000-07-07T00:00:00Z"))]
    return _archive(spark, sf).filter(delivery_and_relative(bounds, [("<=", 36)], ZONE)).select(*_ARCHIVE_COLUMNS)


@plan("prune_quote_index", with_sql("curve_points", _CURVE + """
    WHERE "ReferenceTime" >= TIMESTAMP '1998-06-01' AND "ReferenceTime" < TIMESTAMP '1999-06-01'
      AND quote_index BETWEEN 19980530 AND 19990604"""))
def prune_quote_index_plan(spark, sf):
    span = tb.interval("1998-06-01T00:00:00", "1999-06-01T00:00:00")
    days = quote_index_range([(">=", span.start), ("<", span.end)])
    rows = fx.curve_points(spark, sf).filter(P.within("ReferenceTime", span) & days.predicate())
    return rows.select("Identifier", "ReferenceTime", "DeliveryStart", "SettlementPrice", "Volume")


@plan("select_quote_days", with_sql("archive_hours", _ARCHIVE + """
    WHERE quote_index BETWEEN 19980602 AND 19990531"""))
def select_quote_days_plan(spark, sf):
    days = quote_day_range(
        [(">=", tb.point("1998-06-01T06:00:00", ZONE)), ("<", tb.point("1999-06-01T00:00:00", ZONE))], ZONE
    )
    return _archive(spark, sf).filter(days.predicate()).select(*_ARCHIVE_COLUMNS)


# --- calendar shape ------------------------------------------------------

_LOCAL = f"""timezone('{ZONE}', timezone('UTC', "DeliveryStart"))"""


_curve_filter(
    "shape_months", f" month({_LOCAL}) IN (1, 3, 12) ",
    lambda: Shape.of(months=["Mar", "Jan", "Dec"]).predicate("DeliveryStart", ZONE),
)
_curve_filter(
    "shape_days", f" isodow({_LOCAL}) IN (1, 7) ",
    lambda: Shape.of(days=["Sun", "Mon"]).predicate("DeliveryStart", ZONE),
)
_curve_filter(
    "shape_time_spans",
    f" (hour({_LOCAL}) >= 20 OR (hour({_LOCAL}) * 60 + minute({_LOCAL}) >= 480"
    f" AND hour({_LOCAL}) * 60 + minute({_LOCAL}) < 630)) ",
    lambda: Shape.of(times=[("20:00:00", "00:00:00"), ("08:00:00", "10:30:00")]).predicate("DeliveryStart", ZONE),
)
_curve_filter(
    "shape_combined",
    f" month({_LOCAL}) IN (4, 5, 6, 7, 8, 9) AND isodow({_LOCAL}) <= 5"
    f" AND hour({_LOCAL}) >= 8 AND hour({_LOCAL}) < 20 ",
    lambda: Shape.of(
        ["Apr", "May", "Jun", "Jul", "Aug", "Sep"], ["Mon", "Tue", "Wed", "Thu", "Fri"], [("08:00:00", "20:00:00")]
    ).predicate("DeliveryStart", ZONE),
)
