"""Declared schemas and an early check against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

SERIES_KEY = ["commodity", "state"]

RAW_PRICES = T.StructType(
    [
        T.StructField("state", T.StringType()),
        T.StructField("district", T.StringType()),
        T.StructField("market", T.StringType()),
        T.StructField("commodity", T.StringType()),
        T.StructField("variety", T.StringType()),
        T.StructField("grade", T.StringType()),
        T.StructField("arrival_date", T.DateType()),
        T.StructField("min_price", T.DoubleType()),
        T.StructField("max_price", T.DoubleType()),
        T.StructField("modal_price", T.DoubleType()),
    ]
)

PRICES = T.StructType(
    RAW_PRICES.fields
    + [T.StructField("year", T.IntegerType()), T.StructField("month", T.IntegerType())]
)

CLEAN_CSV = T.StructType(
    [
        T.StructField("crop", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("arrival_date", T.DateType()),
        T.StructField("modal_price", T.DoubleType()),
    ]
)

PANEL = T.StructType(
    [
        T.StructField("commodity", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("y", T.DoubleType()),
    ]
)

PREDICTION_LOG = T.StructType(
    [
        T.StructField("crop", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("forecast_date", T.DateType()),
        T.StructField("predicted_price", T.DoubleType()),
        T.StructField("lower_80", T.DoubleType()),
        T.StructField("upper_80", T.DoubleType()),
        T.StructField("lower_95", T.DoubleType()),
        T.StructField("upper_95", T.DoubleType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)


def require_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Return ``df``, or raise ``TypeError`` naming the missing or mistyped columns."""
    have = {f.name: f.dataType for f in df.schema.fields}
    wrong = [
        f"{f.name} (want {f.dataType.simpleString()}, have "
        f"{have[f.name].simpleString() if f.name in have else 'nothing'})"
        for f in schema.fields
        if have.get(f.name) != f.dataType
    ]
    if wrong:
        raise TypeError("unexpected schema: " + "; ".join(wrong))
    return df
