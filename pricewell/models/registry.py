"""Fitted models on storage: load what is there, train what is missing or out of date.

Tables per series only grow: each training appends rows with the next ``version``, and a series'
newest row counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.ml.regression import GBTRegressionModel, LinearRegressionModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricewell.models import arima, gbt, sequence
from pricewell.operators.align import missing_from
from pricewell.schema import SERIES_KEY

MODELS = ("arima", "gbt", "seq", "ensemble")


def model_path(root: str, model: str) -> str:
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}; one of {', '.join(MODELS)}")
    return f"{root.rstrip('/')}/{model}"


def _or_none(read: Callable[[], DataFrame]) -> DataFrame | None:
    """What ``read`` gives; None if its path does not exist."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def stored_table(spark: SparkSession, path: str, key: list[str] = SERIES_KEY) -> DataFrame | None:
    """The newest row of each series, with its ``version``; None if nothing is stored."""
    rows = _or_none(lambda: spark.read.parquet(path))
    if rows is None:
        return None
    newest = Window.partitionBy(*key).orderBy(F.desc("version"))
    return rows.withColumn("_nth", F.row_number().over(newest)).where("_nth = 1").drop("_nth")


def ensure_table(
    panel: DataFrame, path: str, train: Callable[[DataFrame], DataFrame], key: list[str] = SERIES_KEY,
    refresh: bool = False,
) -> DataFrame:
    """A per-series table at ``path``, with ``last_date``, ``n`` and ``d`` as ``arima.fit`` gives them.

    Trained are series that it does not hold, and those whose first or last day has moved since;
    with ``refresh`` all of the panel.
    """
    spark = panel.sparkSession
    known = stored_table(spark, path, key)
    todo, version = panel, 1
    if known is not None:
        version = known.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0] + 1
    if known is not None and not refresh:
        days = F.datediff(F.max("date"), F.min("date")) + 1
        now = panel.where(F.col("y").isNotNull()).groupBy(*key).agg(
            F.max("date").alias("last_date"), days.alias("_days")
        )
        held = known.select(*key, "last_date", (F.col("n") + F.col("d")).alias("_days"))
        wanted = missing_from(now, held, [*key, "last_date", "_days"])
        todo = panel.join(wanted.select(*key), key, "left_semi")
    train(todo).withColumn("version", F.lit(version)).write.mode("append").parquet(path)
    return stored_table(spark, path, key).drop("version")


def ensure_arima(
    panel: DataFrame, root: str, d: int = 1, key: list[str] = SERIES_KEY, refresh: bool = False
) -> DataFrame:
    return ensure_table(panel, model_path(root, "arima"), lambda p: arima.fit(p, d, key), key, refresh)


def store_weights(weights: DataFrame, root: str) -> DataFrame:
    """Write the ensemble's weights and scores, in place of earlier ones."""
    path = model_path(root, "ensemble")
    weights.write.mode("overwrite").parquet(path)
    return weights.sparkSession.read.parquet(path)


def stored_weights(spark: SparkSession, root: str) -> DataFrame | None:
    return _or_none(lambda: spark.read.parquet(model_path(root, "ensemble")))


def _load_or_train(spark: SparkSession, load, train, path: str, refresh: bool):
    if refresh or _or_none(lambda: spark.read.text(f"{path}/metadata")) is None:
        model = train()
        model.write().overwrite().save(path)
        return model
    return load(path)


def ensure_gbt(
    panel: DataFrame, root: str, settings: gbt.TreeSettings = gbt.TreeSettings(), refresh: bool = False
) -> GBTRegressionModel:
    path = model_path(root, "gbt")
    return _load_or_train(
        panel.sparkSession, GBTRegressionModel.load, lambda: gbt.fit(panel, settings), path, refresh
    )


def ensure_seq(panel: DataFrame, root: str, refresh: bool = False) -> LinearRegressionModel:
    path = model_path(root, "seq")
    return _load_or_train(
        panel.sparkSession, LinearRegressionModel.load, lambda: sequence.fit(panel), path, refresh
    )
