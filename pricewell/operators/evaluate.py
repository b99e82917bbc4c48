"""Forecast scores, test sizes and walk-forward validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewell.models import arima
from pricewell.operators.align import actual_with_forecast
from pricewell.operators.series import daily_values
from pricewell.schema import SERIES_KEY


def metrics(
    pairs: DataFrame, by: list[str], zero_guard: float | None = None, digits: int | None = None
) -> DataFrame:
    """RMSE, MAE, MAPE and row count of ``actual`` against ``predicted``.

    A zero actual is left out of the MAPE, or stands as ``zero_guard`` in its denominator.
    """
    err = F.col("actual") - F.col("predicted")
    base = F.col("actual")
    if zero_guard is not None:
        base = F.when(base == 0, F.lit(zero_guard)).otherwise(base)
    cols = {
        "rmse": F.sqrt(F.avg(err * err)),
        "mae": F.avg(F.abs(err)),
        "mape": F.avg(F.abs(F.try_divide(err, base))) * 100,
    }
    return pairs.groupBy(*by).agg(
        *[(F.round(c, digits) if digits is not None else c).alias(n) for n, c in cols.items()],
        F.count("*").alias("n_test"),
    )


def sizes_for_arima(n: Column) -> Column:
    size = F.least(F.lit(30), F.greatest(F.lit(7), F.floor(n / 10)))
    return F.when(n <= size * 3 + 10, F.greatest(F.lit(7), F.floor(n / 5))).otherwise(size)


def sizes_for_trees(n: Column) -> Column:
    size = F.least(F.lit(90), F.greatest(F.lit(30), F.floor(n / 8)))
    return F.when(n <= size + 30, F.greatest(F.lit(30), F.floor(n / 4))).otherwise(size)


def test_sizes(panel: DataFrame, key: list[str] = SERIES_KEY) -> DataFrame:
    """Length and test sizes of every series."""
    n = F.col("n")
    return panel.groupBy(*key).agg(F.count("*").alias("n")).withColumns(
        {"arima_test": sizes_for_arima(n).cast("int"), "tree_test": sizes_for_trees(n).cast("int")}
    )


def walk_forward_folds(
    panel: DataFrame, test_size: int | str = 30, n_splits: int = 5, key: list[str] = SERIES_KEY
) -> tuple[DataFrame, DataFrame]:
    """Training rows per fold (expanding window) and test rows.

    The last ``n_splits * test_size`` rows of a series are tested, one block per fold, each
    by all rows before it.  ``test_size`` may name a column.  Folds without training rows
    are left out.
    """
    size = F.lit(test_size) if isinstance(test_size, int) else F.col(test_size)
    w = Window.partitionBy(*key)
    rows = panel.withColumns(
        {"_rn": F.row_number().over(w.orderBy("date")), "_n": F.count("*").over(w), "_size": size}
    )
    start = F.col("_n") - F.col("_size") * n_splits
    folds = F.sequence(F.lit(0), F.lit(n_splits - 1))
    train = rows.withColumn(
        "fold", F.explode(F.filter(folds, lambda i: F.col("_rn") <= start + i * F.col("_size")))
    )
    test = rows.withColumn("fold", F.floor((F.col("_rn") - start - 1) / F.col("_size")).cast("int")).where(
        F.col("fold").between(0, n_splits - 1) & (start + F.col("fold") * F.col("_size") > 0)
    )
    keep = [*key, "fold", "date", "y", F.col("_size").cast("int").alias("test_size")]
    return train.select(*keep), test.select(*keep)


def walk_forward_scores(
    panel: DataFrame, test_size: int | str = 30, n_splits: int = 5, d: int = 1, key: list[str] = SERIES_KEY
) -> DataFrame:
    """ARIMA(1,d,1) scores of every series and fold, fitted in one job."""
    days = daily_values(panel, key)
    if isinstance(test_size, str):
        days = days.join(panel.groupBy(*key).agg(F.max(test_size).alias(test_size)), key)
    train, test = walk_forward_folds(days, test_size, n_splits, key)
    fold_key = [*key, "fold"]
    horizon = test.groupBy(*fold_key).agg(F.max("test_size").alias("steps"))
    params = arima.fit(train, d, fold_key).join(horizon, fold_key)
    predicted = arima.forecast(params, F.col("steps"), None, fold_key).select(*fold_key, "date", "forecast")
    return metrics(actual_with_forecast(test, predicted, fold_key), fold_key)


def walk_forward_cv(
    panel: DataFrame, test_size: int | str = 30, n_splits: int = 5, d: int = 1,
    digits: int | None = 2, key: list[str] = SERIES_KEY,
) -> DataFrame:
    """Means over the folds that could be scored, and the population deviation of the RMSE."""
    scores = walk_forward_scores(panel, test_size, n_splits, d, key)
    cols = {
        "rmse_mean": F.avg("rmse"), "mae_mean": F.avg("mae"), "mape_mean": F.avg("mape"),
        "rmse_std": F.stddev_pop("rmse"),
    }
    return scores.groupBy(*key).agg(
        *[(F.round(c, digits) if digits is not None else c).alias(n) for n, c in cols.items()],
        F.count("*").alias("n_folds"),
    )
