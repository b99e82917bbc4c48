"""Retraining the whole panel: series, drift, scores, weights, forecasts, log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewell.models import ensemble, gbt, registry
from pricewell.operators.catalog import best_covered_markets, list_states
from pricewell.operators.drift import drift_report
from pricewell.operators.evaluate import test_sizes, walk_forward_cv
from pricewell.operators.series import crop_series, densify
from pricewell.plans.session import cut_lineage
from pricewell.plans.sizing import stacked
from pricewell.schema import SERIES_KEY
from pricewell.sources.sinks import save_forecast

MIN_POINTS = 200


def effective_pairs(
    wanted: DataFrame, panel: DataFrame, prices: DataFrame,
    min_points: int = MIN_POINTS, min_records: int = 1000,
) -> DataFrame:
    """The state to use for each wanted pair.

    A pair whose series is missing or below ``min_points`` falls back to the state of the
    crop's best covered market; ``used_state`` is NULL when there is none.
    """
    lengths = panel.groupBy(*SERIES_KEY).agg(F.count("*").alias("points"))
    best = best_covered_markets(prices, None, min_records, 1).select(
        "commodity", F.col("state").alias("best_state")
    )
    enough = F.coalesce(F.col("points") >= min_points, F.lit(False))
    return (
        wanted.join(lengths, SERIES_KEY, "left").join(best, "commodity", "left")
        .withColumn("used_state", F.when(enough, F.col("state")).otherwise(F.col("best_state")))
        .withColumn("fell_back", ~enough)
    )


def most_recorded_state(prices: DataFrame, commodity: str) -> str:
    """The state with most records of a crop, for pairs without any series."""
    row = list_states(prices, commodity).first()
    if row is None:
        raise ValueError(f"no prices of {commodity!r}")
    return row["state"]


def retrain(
    prices: DataFrame, log_path: str, artifacts: str, freq: str = "D", steps: int = 30,
    trees: gbt.TreeSettings = gbt.TreeSettings(), validation: int = ensemble.MAX_VALIDATION,
) -> dict[str, DataFrame]:
    """Fit, score and forecast every pair, and append the forecasts to the log.

    The gap-free panel is written once and keeps its partitioning by series, so the steps
    below do not shuffle it again.  Stored models are replaced.  Each component is fitted once without and once with
    the validation rows; scores, weights and log share the results.
    """
    panel = crop_series(prices, freq=freq)
    if freq != "D":
        panel = densify(panel).select(*SERIES_KEY, "date", "y")
    panel = cut_lineage(panel)
    sizes = test_sizes(panel)
    sized = panel.join(sizes, SERIES_KEY)

    weights = registry.store_weights(ensemble.fit_weights(panel, trees, validation), artifacts)
    models = ensemble.Components(
        registry.ensure_arima(panel, artifacts, refresh=True),
        registry.ensure_gbt(panel, artifacts, trees, refresh=True),
        registry.ensure_seq(panel, artifacts, refresh=True),
    )
    forecasts = cut_lineage(ensemble.component_forecasts(models, panel, steps))
    combined = ensemble.combine(forecasts, weights)
    save_forecast(stacked([forecasts, combined], SERIES_KEY), log_path)
    return {
        "series": panel.groupBy(*SERIES_KEY).agg(F.count("*").alias("series_points")),
        "drift": drift_report(panel),
        "arima_scores": walk_forward_cv(sized, "arima_test", 3),
        "tree_scores": gbt.evaluate(panel, sizes, trees),
        "weights": weights,
        "forecasts": forecasts,
        "ensemble": combined,
    }
