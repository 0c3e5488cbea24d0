"""Declared schemas; nothing in the library infers types."""

from pyspark.sql import types as T

_ID = T.LongType()
_TEXT = T.StringType()
_MONEY = T.DecimalType(10, 2)
_RATE = T.DecimalType(6, 4)

# Names and types of the raw columns.
RAW_SCHEMAS = {
    "online": T.StructType([
        T.StructField("User_id", _ID),
        T.StructField("Merchant_id", _ID),
        T.StructField("Action", T.ByteType()),
        T.StructField("Coupon_id", _TEXT),
        T.StructField("Discount_rate", _TEXT),
        T.StructField("Date_received", _TEXT),
        T.StructField("Date", _TEXT),
    ]),
    "offline": T.StructType([
        T.StructField("User_id", _ID),
        T.StructField("Merchant_id", _ID),
        T.StructField("Coupon_id", _TEXT),
        T.StructField("Discount_rate", _TEXT),
        T.StructField("Distance", _TEXT),
        T.StructField("Date_received", _TEXT),
        T.StructField("Date", _TEXT),
    ]),
    "offline_test": T.StructType([
        T.StructField("User_id", _ID),
        T.StructField("Merchant_id", _ID),
        T.StructField("Coupon_id", _TEXT),
        T.StructField("Discount_rate", _TEXT),
        T.StructField("Distance", _TEXT),
        T.StructField("Date_received", _TEXT),
    ]),
}

# Raw column -> star-schema column.
CANONICAL = {
    "User_id": "user_id",
    "Merchant_id": "merchant_id",
    "Coupon_id": "coupon_id",
    "Discount_rate": "discount_rate",
    "Distance": "distance",
    "Date_received": "date_received",
    "Date": "date_used",
    "Action": "action",
}

# Columns of the star schema.
USERS = T.StructType([T.StructField("user_id", _ID, False)])
MERCHANTS = T.StructType([T.StructField("merchant_id", _ID, False)])
COUPONS = T.StructType([
    T.StructField("coupon_id", _TEXT, False),
    T.StructField("discount_rate", _TEXT),
    T.StructField("discount_type", _TEXT),
    T.StructField("discount_man", _MONEY),
    T.StructField("discount_jian", _MONEY),
    T.StructField("eq_discount", _RATE),
])
TRANSACTIONS = T.StructType([
    T.StructField("transaction_id", _ID, False),
    T.StructField("user_id", _ID, False),
    T.StructField("merchant_id", _ID, False),
    T.StructField("coupon_id", _TEXT),
    T.StructField("discount_rate", _TEXT),
    T.StructField("discount_type", _TEXT),
    T.StructField("discount_man", _MONEY),
    T.StructField("discount_jian", _MONEY),
    T.StructField("discount_eq_rate", _RATE),
    T.StructField("distance", T.IntegerType()),
    T.StructField("date_received", T.DateType()),
    T.StructField("date_used", T.DateType()),
    T.StructField("action", T.ByteType()),
    T.StructField("action_name", _TEXT),
    T.StructField("source", _TEXT, False),
])

# Columns of the cleaned log before the discount is parsed, in order.
LOG_COLUMNS = (
    "user_id", "merchant_id", "coupon_id", "discount_rate", "distance",
    "date_received", "date_used", "action", "action_name", "source",
)

# Columns of the enriched export, in order.
ENRICHED_COLUMNS = (
    "user_id", "merchant_id", "coupon_id", "discount_type", "discount_type_cn",
    "discount_man", "discount_jian", "discount_eq_rate", "distance", "distance_bucket",
    "date_received", "date_used", "is_used", "is_received", "day_type", "gap_days",
    "gap_bucket", "threshold_bucket", "year_month", "source", "action_name",
)

RFM_RESULT = T.StructType([
    T.StructField("user_id", _ID),
    T.StructField("recency_days", T.IntegerType()),
    T.StructField("frequency", T.LongType()),
    T.StructField("monetary", T.DecimalType(38, 2)),
    T.StructField("total_received", T.LongType()),
    T.StructField("r_score", T.IntegerType()),
    T.StructField("f_score", T.IntegerType()),
    T.StructField("m_score", T.IntegerType()),
    T.StructField("rfm_total", T.IntegerType()),
    T.StructField("rfm_cell", _TEXT),
    T.StructField("rfm_weighted", T.DoubleType()),
    T.StructField("user_segment", _TEXT),
    T.StructField("user_sub_segment", _TEXT),
])
