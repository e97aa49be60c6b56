"""Schemas of the physical layouts. Timestamps are UTC wall clocks."""

from pyspark.sql import types as T

_LONG, _INT, _DOUBLE, _TEXT, _FLAG = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.BooleanType()
_TIME = T.TimestampNTZType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


#: value columns of a series follow these
RECENT = _schema(
    Identifier=_LONG, ReferenceTime=_TIME, DeliveryStart=_TIME, DeliveryEnd=_TIME, quote_index=_INT,
)
#: key columns of a category beyond the reference time come on top
VERSIONED = _schema(MdoId=_LONG, ReferenceTime=_TIME, CreatedOn=_TIME, Deleted=_FLAG, payload=_TEXT)
ARCHIVE = _schema(
    ts_id=_TEXT, qte_y=_INT, qte_m=_INT, qte_d=_INT, quote_index=_INT, publish_time=_TIME,
    del_y=_INT, del_m=_INT, del_d=_INT, del_h=_INT, del_min=_INT, del_offset=_INT, value=_DOUBLE,
)
CATALOG = _schema(
    series_id=_LONG, category=_TEXT, source=_TEXT, resolution=_TEXT, archive_id=_TEXT, versioned_id=_LONG,
    switchover=_TEXT, split_query=_FLAG, timezone=_TEXT, column_ordinal=_INT, logical=_TEXT, physical=_TEXT,
    data_type=_TEXT, is_key=_FLAG, is_projectable=_FLAG, order_priority=_INT, key_ordering=_INT, value_ordering=_INT,
)
