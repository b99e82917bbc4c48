"""A linear sequence model: the next scaled value from the last thirty.

One regression is trained on the windows of all series; forecasting folds its few
coefficients over each series' last values, so no job per step is needed.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewell.operators.features import sliding_windows
from pricewell.operators.series import daily_values, last_rows, standardise
from pricewell.schema import SERIES_KEY

LOOKBACK = 30


def _padded(values, lookback: int):
    """Fill up on the left with the series mean, which is zero in scaled values."""
    missing = F.greatest(F.lit(0), F.lit(lookback) - F.size(values))
    return F.concat(F.array_repeat(F.lit(0.0), missing), values)


def fit(panel: DataFrame, lookback: int = LOOKBACK, key: list[str] = SERIES_KEY) -> LinearRegressionModel:
    """Least squares over all windows of all series; one pass over the data."""
    windows = sliding_windows(standardise(daily_values(panel, key), key), lookback, key=key)
    rows = windows.select(
        array_to_vector(_padded(F.col("inputs"), lookback)).alias("features"),
        F.col("target").alias("label"),
    )
    return LinearRegression(solver="normal", regParam=1e-6, standardization=False).fit(rows)


def forecast(
    model: LinearRegressionModel, panel: DataFrame, steps: int = 30, digits: int | None = 2,
    key: list[str] = SERIES_KEY,
) -> DataFrame:
    """Recursive forecast in scaled values, brought back to prices."""
    weights = [float(w) for w in model.coefficients.toArray()]
    lookback = len(weights)
    recent = last_rows(standardise(daily_values(panel, key), key), lookback, key).groupBy(*key).agg(
        F.max("date").alias("last_date"), F.first("mean").alias("mean"), F.first("scale").alias("scale"),
        F.sort_array(F.collect_list(F.struct("date", "z"))).alias("_rows"),
    )
    start = _padded(F.transform("_rows", lambda r: r["z"]), lookback)
    coef = F.array(*[F.lit(w) for w in weights])

    def step(acc, _):
        dot = F.aggregate(
            F.zip_with(F.slice(acc, -lookback, lookback), coef, lambda a, b: a * b),
            F.lit(0.0), lambda s, x: s + x,
        )
        return F.concat(acc, F.array(dot + F.lit(float(model.intercept))))

    path = F.slice(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step), lookback + 1, steps)
    rows = recent.select(*key, "last_date", "mean", "scale", F.posexplode(path).alias("_i", "z"))
    value = F.col("z") * F.col("scale") + F.col("mean")
    return rows.select(
        *key, F.lit("seq").alias("model"), (F.col("_i") + 1).alias("step"),
        F.date_add("last_date", F.col("_i") + 1).alias("date"),
        (value if digits is None else F.round(value, digits)).alias("forecast"),
    )
