"""Market-data tables derived from the given tables, in Spark and in SQL.

Each derivation is stated twice: as a DataFrame function and as a SQL query of
the same name in ``SQL``. ``with_sql`` puts the queries a statement needs in
front of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tritempo.functions.mapped import MappedColumn
from tritempo.functions.timecols import epoch_seconds, plus_hours, quote_index, utc_to_zone
from tritempo.operators.catalog import catalog_rows, versioned_rows

ZONE = "Europe/Zurich"

CURVE_MAPPING = [
    MappedColumn("Identifier", "series_fid", "bigint", is_key=True, key_ordering=0),
    MappedColumn("ReferenceTime", "quote_time", "datetimeoffset", is_key=True, key_ordering=1),
    MappedColumn("DeliveryStart", "adjusted_start", "datetimeoffset", is_key=True, key_ordering=2),
    MappedColumn("DeliveryEnd", "adjusted_end", "datetimeoffset", is_key=True, key_ordering=3),
    MappedColumn("SettlementPrice", "settlement price", "number", value_ordering=1),
    MappedColumn("Volume", "volume", "number", value_ordering=2),
]
VERSION_MAPPING = [
    MappedColumn("Identifier", "MdoId", "bigint", is_key=True, is_projectable=False, key_ordering=1),
    MappedColumn("ReferenceTime", "ReferenceTime", "datetimeoffset", is_key=True, is_projectable=False, key_ordering=2),
    MappedColumn("k", "k", "int", value_ordering=1),
]
#: literal part of the catalog: ordinal, logical, physical, type, key, projectable, key order, value order
CATALOG_COLUMNS = [
    (1, "ReferenceTime", "quote_time", "datetimeoffset", True, True, 1, None),
    (2, "DeliveryStart", "adjusted_start", "datetimeoffset", True, True, 2, None),
    (3, "DeliveryEnd", "adjusted_end", "datetimeoffset", True, True, 3, None),
    (4, "SettlementPrice", "settlement price", "number", False, True, None, 1),
    (5, "Volume", "volume", "number", False, True, None, 2),
]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ts_points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("user_id").alias("Identifier"),
        F.col("ts").alias("ReferenceTime"),
        F.col("value").alias("Value"),
        F.col("event_type").alias("Status"),
        F.col("props").alias("payload"),
        "event_id",
    )


def fine_points(spark: SparkSession, sf: str) -> DataFrame:
    """Points whose times have minutes, seconds and milliseconds."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("Identifier"),
        (F.col("ts").cast("date").cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("event_id") % 7919).cast("decimal(18,6)")))
        .alias("ReferenceTime"),
        F.col("ts").alias("DeliveryStart"),
        (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(1))).alias("DeliveryEnd"),
        F.col("value").alias("SettlementPrice"),
    )


def versions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("user_id").alias("MdoId"),
        F.col("ts").cast("date").cast("timestamp_ntz").alias("ReferenceTime"),
        F.col("ts").alias("CreatedOn"),
        (F.col("event_type") == "error").alias("Deleted"),
        F.col("props").alias("payload"),
        F.col("value").alias("Value"),
        "event_id",
    )


def _delivery_start() -> Column:
    return plus_hours(F.col("l_shipdate"), F.col("l_orderkey") % 72)


def curve_points(spark: SparkSession, sf: str) -> DataFrame:
    start = _delivery_start()
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("Identifier"),
        F.col("l_shipdate").alias("ReferenceTime"),
        start.alias("DeliveryStart"),
        plus_hours(start, 1).alias("DeliveryEnd"),
        F.col("l_extendedprice").alias("SettlementPrice"),
        F.col("l_quantity").alias("Volume"),
        F.col("l_returnflag").alias("Direction"),
        F.col("l_linestatus").alias("Status"),
        quote_index("l_shipdate").alias("quote_index"),
    )


def recent_view(spark: SparkSession, sf: str) -> DataFrame:
    """Curve points under physical names."""
    points = curve_points(spark, sf)
    names = {column.logical: column.physical for column in CURVE_MAPPING}
    return points.withColumnsRenamed(names)


def order_delivery(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    lines = table(spark, sf, "lineitem")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_suppkey").alias("Identifier"),
        F.col("o_orderdate").alias("ReferenceTime"),
        _delivery_start().alias("DeliveryStart"),
    )


def surface_points(spark: SparkSession, sf: str) -> DataFrame:
    start = F.col("l_shipdate") + F.make_dt_interval(F.col("l_linenumber").cast("int"))
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("Identifier"),
        F.col("l_shipdate").alias("ReferenceTime"),
        start.alias("ValidityPeriodStart"),
        (start + F.make_dt_interval(F.lit(1))).alias("ValidityPeriodEnd"),
        F.col("l_linenumber").cast("int").alias("InstanceCode"),
        (F.col("l_partkey") % 48).cast("int").alias("ISP"),
        F.concat(F.lit("B"), F.col("l_orderkey").cast("string")).alias("BidId"),
        F.col("l_returnflag").alias("Direction"),
        F.col("l_linestatus").alias("Status"),
        F.date_format(F.col("l_shipdate").cast("date"), "yyyy-MM-dd").alias("OptionExpiry"),
        F.col("l_extendedprice").alias("Value"),
    )


def archive_hours(spark: SparkSession, sf: str) -> DataFrame:
    utc = _delivery_start()
    local = utc_to_zone(utc, ZONE)
    kind = F.element_at(F.array(*[F.lit(word) for word in ("power", "gas", "oil", "coal")]),
                        (F.col("l_suppkey") % 4 + 1).cast("int"))
    day = F.col("l_shipdate")
    return table(spark, sf, "lineitem").select(
        F.concat(kind, F.lit(":"), F.col("l_suppkey").cast("string")).alias("ts_id"),
        F.year(day).alias("qte_y"),
        F.month(day).alias("qte_m"),
        F.dayofmonth(day).alias("qte_d"),
        quote_index(day).alias("quote_index"),
        day.alias("publish_time"),
        F.year(local).alias("del_y"),
        F.month(local).alias("del_m"),
        F.dayofmonth(local).alias("del_d"),
        F.hour(local).alias("del_h"),
        F.minute(local).alias("del_min"),
        ((epoch_seconds(local) - epoch_seconds(utc)) / 3600).cast("int").alias("del_offset"),
        (F.col("l_extendedprice") / 7).alias("value"),
    )


def archive_series_id() -> Column:
    """Series id inside the archive id."""
    return F.substring_index("ts_id", ":", -1).cast("bigint")


def _with_catalog_columns(df: DataFrame) -> DataFrame:
    columns = F.array(
        *[
            F.struct(
                F.lit(ordinal).alias("column_ordinal"), F.lit(logical).alias("logical"),
                F.lit(physical).alias("physical"), F.lit(kind).alias("data_type"), F.lit(key).alias("is_key"),
                F.lit(projectable).alias("is_projectable"), F.lit(key_order).cast("int").alias("key_ordering"),
                F.lit(value_order).cast("int").alias("value_ordering"),
            )
            for ordinal, logical, physical, kind, key, projectable, key_order, value_order in CATALOG_COLUMNS
        ]
    )
    return df.withColumn("_column", F.explode(columns)).select(*df.columns, "_column.*")


def mapping_rows(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("s_suppkey")
    five, ten = key % 5, key % 10
    series = table(spark, sf, "supplier").select(
        key.alias("series_id"),
        F.when(key % 3 == 0, "Curve").when(key % 3 == 1, "surfaces").otherwise("time series").alias("category"),
        F.when(key % 4 == 0, "PT1H").when(key % 4 == 1, "P1D").when(key % 4 == 2, "P1M").otherwise("unknown")
        .alias("resolution"),
        F.when(key % 2 == 0, F.concat(F.lit("power:"), key.cast("string"))).alias("archive_id"),
        F.when(five == 0, key + 100000).when(five == 3, key).alias("versioned_id"),
        F.when(five == 0, "MDS:2024-01-01").when(five == 1, "CMDP:2024-01-01").alias("switchover"),
        F.when(key % 7 != 0, key % 2 == 0).alias("split_query"),
        F.when(ten == 4, "Asia/Tokyo").when(ten != 5, "Europe/Zurich").alias("timezone"),
    )
    return catalog_rows(_with_catalog_columns(series))


def mapping_rows_versioned_raw(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("s_suppkey")
    series = table(spark, sf, "supplier").select(
        F.explode(F.array(key, key + 100000)).alias("series_id"),
        F.when(key % 3 == 0, "Curve").when(key % 3 == 1, "surfaces").otherwise("time series").alias("category"),
        F.when(key % 10 != 0, "Europe/Zurich").alias("timezone"),
    )
    return _with_catalog_columns(series).drop("physical", "is_key", "is_projectable")


def mapping_rows_versioned(spark: SparkSession, sf: str) -> DataFrame:
    return versioned_rows(mapping_rows_versioned_raw(spark, sf))


def _sql_catalog_values() -> str:
    def literal(value) -> str:
        if value is None:
            return "NULL"
        return f"'{value}'" if isinstance(value, str) else str(value).upper()

    rows = ", ".join("(" + ", ".join(literal(value) for value in row) + ")" for row in CATALOG_COLUMNS)
    names = "column_ordinal, logical, physical, data_type, is_key, is_projectable, key_ordering, value_ordering"
    return f"(VALUES {rows}) AS c({names})"


SQL = {
    "ts_points": """
        SELECT user_id AS "Identifier", ts AS "ReferenceTime", value AS "Value", event_type AS "Status",
               props AS payload, event_id
        FROM events""",
    "versions": """
        SELECT user_id AS "MdoId", CAST(date_trunc('day', ts) AS TIMESTAMP) AS "ReferenceTime", ts AS "CreatedOn",
               event_type = 'error' AS "Deleted", props AS payload, value AS "Value", event_id
        FROM events""",
    "fine_points": """
        SELECT user_id AS "Identifier",
               CAST(date_trunc('day', ts) AS TIMESTAMP) + to_seconds(event_id % 7919) AS "ReferenceTime",
               ts AS "DeliveryStart", ts + to_hours(1) AS "DeliveryEnd", value AS "SettlementPrice"
        FROM events""",
    "curve_points": """
        SELECT l_suppkey AS "Identifier", l_shipdate AS "ReferenceTime",
               l_shipdate + to_hours(l_orderkey % 72) AS "DeliveryStart",
               l_shipdate + to_hours(l_orderkey % 72 + 1) AS "DeliveryEnd",
               l_extendedprice AS "SettlementPrice", l_quantity AS "Volume",
               l_returnflag AS "Direction", l_linestatus AS "Status",
               CAST(strftime(l_shipdate, '%Y%m%d') AS INTEGER) AS quote_index
        FROM lineitem""",
    "order_delivery": """
        SELECT l_suppkey AS "Identifier", o_orderdate AS "ReferenceTime",
               l_shipdate + to_hours(l_orderkey % 72) AS "DeliveryStart"
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "surface_points": """
        SELECT l_suppkey AS "Identifier", l_shipdate AS "ReferenceTime",
               l_shipdate + to_days(CAST(l_linenumber AS INTEGER)) AS "ValidityPeriodStart",
               l_shipdate + to_days(CAST(l_linenumber + 1 AS INTEGER)) AS "ValidityPeriodEnd",
               CAST(l_linenumber AS INTEGER) AS "InstanceCode", CAST(l_partkey % 48 AS INTEGER) AS "ISP",
               'B' || CAST(l_orderkey AS VARCHAR) AS "BidId", l_returnflag AS "Direction", l_linestatus AS "Status",
               strftime(l_shipdate, '%Y-%m-%d') AS "OptionExpiry", l_extendedprice AS "Value"
        FROM lineitem""",
    "archive_utc": """
        SELECT l_suppkey, l_shipdate, l_extendedprice, l_shipdate + to_hours(l_orderkey % 72) AS u,
               timezone('Europe/Zurich', timezone('UTC', l_shipdate + to_hours(l_orderkey % 72))) AS loc
        FROM lineitem""",
    "archive_hours": """
        SELECT CASE l_suppkey % 4 WHEN 0 THEN 'power' WHEN 1 THEN 'gas' WHEN 2 THEN 'oil' ELSE 'coal' END
                   || ':' || CAST(l_suppkey AS VARCHAR) AS ts_id,
               l_suppkey AS series,
               CAST(year(l_shipdate) AS INTEGER) AS qte_y, CAST(month(l_shipdate) AS INTEGER) AS qte_m,
               CAST(day(l_shipdate) AS INTEGER) AS qte_d,
               CAST(strftime(l_shipdate, '%Y%m%d') AS INTEGER) AS quote_index, l_shipdate AS publish_time,
               CAST(year(loc) AS INTEGER) AS del_y, CAST(month(loc) AS INTEGER) AS del_m,
               CAST(day(loc) AS INTEGER) AS del_d, CAST(hour(loc) AS INTEGER) AS del_h,
               CAST(minute(loc) AS INTEGER) AS del_min, CAST(date_diff('hour', u, loc) AS INTEGER) AS del_offset,
               l_extendedprice / 7 AS value, u
        FROM archive_utc""",
    "mapping_rows": f"""
        SELECT s_suppkey AS series_id,
               CASE s_suppkey % 3 WHEN 0 THEN 'Curve' WHEN 1 THEN 'surfaces' ELSE 'time series' END AS category,
               CASE WHEN s_suppkey % 5 IN (0, 3) THEN 'versioned' WHEN s_suppkey % 2 = 0 THEN 'archive'
                    ELSE 'recent' END AS source,
               CASE s_suppkey % 4 WHEN 0 THEN 'PT1H' WHEN 1 THEN 'P1D' WHEN 2 THEN 'P1M' ELSE 'unknown' END
                   AS resolution,
               CASE WHEN s_suppkey % 2 = 0 THEN 'power:' || CAST(s_suppkey AS VARCHAR) END AS archive_id,
               CASE s_suppkey % 5 WHEN 0 THEN s_suppkey + 100000 WHEN 3 THEN s_suppkey END AS versioned_id,
               CASE s_suppkey % 5 WHEN 0 THEN 'MDS:2024-01-01' WHEN 1 THEN 'CMDP:2024-01-01' END AS switchover,
               CASE WHEN s_suppkey % 7 <> 0 THEN s_suppkey % 2 = 0 END AS split_query,
               CASE s_suppkey % 10 WHEN 4 THEN 'Asia/Tokyo' WHEN 5 THEN NULL ELSE 'Europe/Zurich' END AS timezone,
               column_ordinal, logical, physical, data_type, is_key, is_projectable,
               CAST(NULL AS INTEGER) AS order_priority, key_ordering, value_ordering
        FROM supplier CROSS JOIN {_sql_catalog_values()}""",
    "mapping_rows_versioned": f"""
        SELECT s_suppkey + shift AS series_id,
               CASE s_suppkey % 3 WHEN 0 THEN 'Curve' WHEN 1 THEN 'surfaces' ELSE 'time series' END AS category,
               'versioned' AS source, CAST(NULL AS VARCHAR) AS resolution, CAST(NULL AS VARCHAR) AS archive_id,
               s_suppkey + shift AS versioned_id, CAST(NULL AS VARCHAR) AS switchover, TRUE AS split_query,
               CASE WHEN s_suppkey % 10 <> 0 THEN 'Europe/Zurich' END AS timezone,
               column_ordinal, logical, logical AS physical, data_type, key_ordering IS NOT NULL AS is_key,
               key_ordering IS NULL AS is_projectable,
               CAST(NULL AS INTEGER) AS order_priority, key_ordering, value_ordering
        FROM supplier CROSS JOIN (VALUES (0), (100000)) AS s(shift) CROSS JOIN {_sql_catalog_values()}""",
}
def local_to_utc(local: str, zone: str = f"'{ZONE}'") -> str:
    """SQL for the instant of a wall clock; of an hour that occurs twice the earlier one, where the hour before shows the same clock."""
    found = f"timezone('UTC', timezone({zone}, {local}))"
    before = f"({found} - INTERVAL 1 HOUR)"
    return f"CASE WHEN timezone({zone}, timezone('UTC', {before})) = {local} THEN {before} ELSE {found} END"


#: end of a delivery hour, one hour of wall clock after its start
END_UTC = local_to_utc("(make_timestamp(del_y, del_m, del_d, del_h, del_min, 0) + to_hours(1))")

_NEEDS = {"archive_hours": ["archive_utc"]}


def with_sql(tables: str, statement: str) -> str:
    """A statement with the derivations of the named tables (space separated) in front of it."""
    names: list[str] = []
    for name in tables.split():
        names += [*_NEEDS.get(name, []), name]
    parts = ", ".join(f"{name} AS ({SQL[name]})" for name in dict.fromkeys(names))
    return f"WITH {parts} {statement}"
