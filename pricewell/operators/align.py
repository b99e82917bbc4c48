"""Aligning frames by key: actual with forecast, component forecasts, wanted with known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewell.operators.series import densify
from pricewell.schema import SERIES_KEY


def on_calendar(daily: DataFrame, key: list[str] = SERIES_KEY) -> DataFrame:
    """Observations on a complete daily calendar; days without one are NULL."""
    return densify(daily, key, fill=False)


def actual_with_forecast(actual: DataFrame, forecast: DataFrame, key: list[str] = SERIES_KEY) -> DataFrame:
    """Pairs of ``actual`` and ``predicted`` on series and date (and what else ``forecast`` carries)."""
    left = actual.select(*key, "date", F.col("y").alias("actual"))
    right = forecast.withColumnRenamed("forecast", "predicted")
    return left.join(right, key + ["date"], "inner")


def side_by_side(forecasts: DataFrame, models: list[str], key: list[str] = SERIES_KEY) -> DataFrame:
    """One column ``<model>_forecast`` per model, from rows of ``(key, date, model, forecast)``."""
    return forecasts.groupBy(*key, "date").agg(
        *[F.max(F.when(F.col("model") == m, F.col("forecast"))).alias(f"{m}_forecast") for m in models]
    )


def missing_from(wanted: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """Wanted rows without a match among the known ones."""
    return wanted.join(known.select(*on).distinct(), on, "left_anti")
