"""Weighted ensemble of ARIMA, tree and sequence forecasts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.regression import GBTRegressionModel, LinearRegressionModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewell.models import arima, gbt, sequence
from pricewell.operators.align import actual_with_forecast, side_by_side
from pricewell.operators.evaluate import metrics
from pricewell.operators.series import daily_values
from pricewell.plans.sizing import stacked
from pricewell.schema import SERIES_KEY

COMPONENTS = ["arima", "gbt", "seq"]
MAX_VALIDATION = 90
SPARE = 30  # rows a series needs beyond its validation part
ZERO_GUARD = 1e-6


@dataclass
class Components:
    arima: DataFrame
    gbt: GBTRegressionModel
    seq: LinearRegressionModel


def fit_components(
    panel: DataFrame, trees: gbt.TreeSettings = gbt.TreeSettings(), key: list[str] = SERIES_KEY,
) -> Components:
    return Components(
        arima.fit(panel, 1, key), gbt.fit(panel, trees, key), sequence.fit(panel, key=key)
    )


def component_forecasts(
    models: Components, panel: DataFrame, steps: int, digits: int | None = 2, key: list[str] = SERIES_KEY
) -> DataFrame:
    """Forecasts of all components, one row per series, day and model."""
    parts = [
        arima.forecast(models.arima, steps, digits, key).withColumn("model", F.lit("arima")),
        gbt.forecast(models.gbt, panel, steps, digits, key),
        sequence.forecast(models.seq, panel, steps, digits, key),
    ]
    return stacked(parts, key)


def validation_size(n: Column, most: int = MAX_VALIDATION) -> Column:
    return F.least(F.lit(most), F.greatest(F.lit(14), F.floor(n / 5)))


def validation_split(panel: DataFrame, most: int = MAX_VALIDATION, key: list[str] = SERIES_KEY) -> DataFrame:
    """Mark rows ``train`` or ``valid``; series too short for both are left out."""
    w = Window.partitionBy(*key)
    rows = panel.withColumns(
        {"_n": F.count("*").over(w), "_back": F.row_number().over(w.orderBy(F.desc("date")))}
    ).withColumn("_v", validation_size(F.col("_n"), most))
    return rows.where(F.col("_n") > F.col("_v") + SPARE).withColumn(
        "part", F.when(F.col("_back") <= F.col("_v"), "valid").otherwise("train")
    ).drop("_n", "_back", "_v")


def score_and_weigh(
    valid: DataFrame, forecasts: DataFrame, rounded: bool = False, key: list[str] = SERIES_KEY
) -> DataFrame:
    """Scores per series and component with weights proportional to 1 / MAPE.

    ``rounded`` takes the MAPE at two digits and the weights at four, which then need
    not add up to one.
    """
    pairs = actual_with_forecast(valid, forecasts.select(*key, "date", "model", "forecast"), key)
    scores = metrics(pairs, [*key, "model"], ZERO_GUARD, 2 if rounded else None)
    inverse = 1 / F.greatest(F.col("mape"), F.lit(1e-6))
    share = inverse / F.sum(inverse).over(Window.partitionBy(*key))
    return scores.withColumn("weight", F.round(share, 4) if rounded else share)


def fit_weights(
    panel: DataFrame, trees: gbt.TreeSettings = gbt.TreeSettings(), most: int = MAX_VALIDATION,
    rounded: bool = False, key: list[str] = SERIES_KEY,
) -> DataFrame:
    """Fit the components without the validation rows, score them there, and weigh them."""
    parts = validation_split(daily_values(panel, key), most, key)
    train = parts.where("part = 'train'").drop("part")
    models = fit_components(train, trees, key=key)
    forecasts = component_forecasts(models, train, most, 2, key)
    return score_and_weigh(parts.where("part = 'valid'"), forecasts, rounded, key)


def combine(
    forecasts: DataFrame, weights: DataFrame, digits: int | None = 2, components: list[str] | None = None,
    key: list[str] = SERIES_KEY,
) -> DataFrame:
    """Weighted sum of the component forecasts, with the components beside it."""
    components = components or COMPONENTS
    wide = side_by_side(forecasts, components, key)
    factors = weights.groupBy(*key).agg(
        *[F.coalesce(F.max(F.when(F.col("model") == m, F.col("weight"))), F.lit(0.0)).alias(f"_w_{m}")
          for m in components]
    )
    # A missing component gives its weight to the others; a series without weights weighs all alike.
    known = sum((F.col(f"_w_{m}") for m in components[1:]), F.col(f"_w_{components[0]}"))
    there = {m: F.col(f"{m}_forecast").isNotNull().cast("double") for m in components}
    left = sum((F.col(f"_w_{m}") * there[m] for m in components), F.lit(0.0))
    parts = sum(there.values(), F.lit(0.0))
    weight = {
        m: F.when(left > 0, F.col(f"_w_{m}") * (known / left)).otherwise(F.try_divide(F.lit(1.0), parts))
        for m in components
    }
    share = [F.when(F.col(f"{m}_forecast").isNotNull(), F.col(f"{m}_forecast") * weight[m]).otherwise(0.0)
             for m in components]
    total = F.when(parts > 0, sum(share[1:], share[0]))
    return wide.join(factors, key, "left").select(
        *key, "date", (total if digits is None else F.round(total, digits)).alias("forecast"),
        F.lit("ensemble").alias("model"), *[f"{m}_forecast" for m in components],
    )
