"""Fixed values.

Everything in this module is data that results depend on: names found in the
stored data, word lists and numeric defaults. They are stated once, as text.
"""

# Zone spellings that mean something other than an IANA name.
ZONE_ALIASES = {"": "UTC", "utc": "UTC", "cet": "Europe/Zurich"}
DEFAULT_SERIES_ZONE = "Europe/Zurich"

# Logical column names.
IDENTIFIER = "Identifier"
REFERENCE_TIME = "ReferenceTime"
DELIVERY_START = "DeliveryStart"
DELIVERY_END = "DeliveryEnd"
CREATED_ON = "CreatedOn"
DELETED = "Deleted"
QUOTE_INDEX = "quote_index"
VERSIONED_IDENTIFIER = "MdoId"
DELIVERY_START_NAMES = ("DeliveryStart", "UnderlyingStart", "OptionStart")
ARCHIVE_CONTRACT = (
    "Identifier",
    "ReferenceTime",
    "DeliveryStart",
    "DeliveryEnd",
    "LegacyDeliveryBucketNumber",
    "RelativeDeliveryPeriod",
    "Value",
)

# Data categories and the spellings that map onto them.
CATEGORY_SPELLINGS = {
    "curves": ("curve", "curves"),
    "surfaces": ("surface", "surfaces"),
    "timeseries": ("timeseries", "time_series", "time series"),
}

# Token in the archive id -> archive table, in matching order.
ARCHIVE_TABLES = (
    ("power", "hpfc"),
    ("gas", "gas_pfc"),
    ("oil", "oil_pfc"),
    ("coal", "coal_pfc"),
)

# Prefixes of the switchover text stored in catalog rows.
SWITCHOVER_VERSIONED_PREFIX = "mds"
SWITCHOVER_RECENT_PREFIX = "cmdp"

# Words of the calendar shape.
SHAPE_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
SHAPE_DAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")

# Type names of mapped columns.
INTEGER_TYPES = ("int", "integer", "bigint", "long")
FLOAT_TYPES = ("number", "decimal", "float", "double", "real")

# Output texts and batch size.
CSV_NULL = "null"
CSV_ABSENT = "N/A"
DEFAULT_BATCH_ROWS = 1000

# Zones in which archive data may be read for an id.
ARCHIVE_ROUTABLE_ZONES = ("", "cet", "europe/zurich")
