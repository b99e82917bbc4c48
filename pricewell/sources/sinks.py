"""Writing tables, the forecast log and CSV exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewell.schema import PREDICTION_LOG


def write_table(df: DataFrame, name: str, if_exists: str = "append", path: str | None = None) -> None:
    """Save as a table: ``replace``, or ``append`` by column position (made if absent)."""
    if if_exists not in {"append", "replace"}:
        raise ValueError("if_exists must be 'append' or 'replace'")
    exists = df.sparkSession.catalog.tableExists(name)
    if if_exists == "append" and exists:
        df.write.insertInto(name)
        return
    writer = df.write.mode("overwrite" if if_exists == "replace" else "errorifexists")
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(name)


def as_log_rows(forecast: DataFrame) -> DataFrame:
    """Forecast rows in the shape of the log: renamed, missing columns NULL, stamped in UTC."""
    names = {"date": "forecast_date", "forecast": "predicted_price", "commodity": "crop"}
    for old, new in names.items():
        if new not in forecast.columns and old in forecast.columns:
            forecast = forecast.withColumnRenamed(old, new)
    forecast = forecast.withColumn("created_at", F.current_timestamp())
    cols = [
        (F.col(f.name) if f.name in forecast.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in PREDICTION_LOG.fields
    ]
    return forecast.select(*cols)


def save_forecast(forecast: DataFrame, log_path: str) -> None:
    """Append forecasts to the log, partitioned by model."""
    as_log_rows(forecast).write.mode("append").partitionBy("model").parquet(log_path)


def read_log(spark: SparkSession, log_path: str) -> DataFrame:
    return spark.read.schema(PREDICTION_LOG).parquet(log_path).select(*PREDICTION_LOG.fieldNames())


def recent_forecasts(log: DataFrame, limit: int = 100) -> DataFrame:
    """The latest log rows; equal times are ordered by name so that the result is fixed."""
    return log.orderBy(
        F.desc_nulls_last("created_at"), F.desc_nulls_last("forecast_date"), "crop", "state", "model"
    ).limit(limit)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header, one per task."""
    df.write.mode("overwrite").option("header", True).csv(path)
