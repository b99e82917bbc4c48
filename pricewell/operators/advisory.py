"""Hold-or-sell advice per series from its history and its forecast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewell.operators.series import last_rows
from pricewell.schema import SERIES_KEY

# Thresholds (percent) and the wording of the advice.
RISE, FALL, VOLATILE = 5.0, -5.0, 8.0
ADVICE_RISE = "Hold stock or sell in phases"
ADVICE_FALL = "Sell sooner"
ADVICE_FLAT = "Hold / stagger sales"
WHY_RISE = "Forecast price is expected to rise by about %.1f%% over the horizon."
WHY_RISE_2 = "A phased sale may capture higher prices while reducing timing risk."
WHY_FALL = "Forecast price is expected to fall by about %.1f%% over the horizon."
WHY_FALL_2 = "Earlier selling may protect margins before prices soften."
WHY_FLAT = "Forecast is relatively flat, so sharp timing bets may not add much value."
WHY_FLAT_2 = "Staggering sales can help balance risk and price capture."
WHY_VOLATILE = "Price volatility is elevated, so avoid a single large market decision."
WHY_FEATURE = (
    "The forecast is most influenced by %s, which indicates recent market momentum matters."
)


def crop_advisory(
    history: DataFrame, forecast: DataFrame, explanation: DataFrame | None = None,
    recent_rows: int = 30, rounded: bool = True, key: list[str] = SERIES_KEY,
) -> DataFrame:
    """One row per series with recommendation, confidence, rationale and metrics.

    ``forecast`` has ``step`` and ``forecast``; ``explanation`` may give ``top_feature``.
    """
    known = history.where(F.col("y").isNotNull())
    past = last_rows(known, recent_rows, key).groupBy(*key).agg(
        F.max_by("y", "date").alias("last_price"),
        (F.stddev_pop("y") / F.greatest(F.avg("y"), F.lit(1e-6)) * 100).alias("recent_volatility_pct"),
    )
    ahead = forecast.groupBy(*key).agg(
        F.min_by("forecast", "step").alias("first_forecast"),
        F.max_by("forecast", "step").alias("last_forecast"),
        (F.stddev_pop("forecast") / F.greatest(F.avg("forecast"), F.lit(1e-6)) * 100).alias(
            "forecast_volatility_pct"
        ),
        F.coalesce(F.regr_slope("forecast", "step"), F.lit(0.0)).alias("slope"),
    )
    rows = past.join(ahead, key).withColumn(
        "change_pct",
        (F.col("last_forecast") - F.col("last_price")) / F.greatest(F.col("last_price"), F.lit(1e-6)) * 100,
    )
    if explanation is not None:
        rows = rows.join(explanation.select(*key, "top_feature"), key, "left")
    else:
        rows = rows.withColumn("top_feature", F.lit(None).cast("string"))

    change, slope = F.col("change_pct"), F.col("slope")
    rise, fall = change >= RISE, change <= FALL
    calm = F.lit("Medium")
    volatile = (F.col("forecast_volatility_pct") >= VOLATILE) | (F.col("recent_volatility_pct") >= VOLATILE)
    sure = ((rise & (slope > 0)) | (fall & (slope < 0))) & ~volatile
    why = F.array_compact(
        F.array(
            F.when(rise, F.format_string(WHY_RISE, change))
            .when(fall, F.format_string(WHY_FALL, F.abs(change))).otherwise(WHY_FLAT),
            F.when(rise, WHY_RISE_2).when(fall, WHY_FALL_2).otherwise(WHY_FLAT_2),
            F.when(volatile, F.lit(WHY_VOLATILE)),
            F.when(F.col("top_feature").isNotNull(), F.format_string(WHY_FEATURE, "top_feature")),
        )
    )
    digits = {
        "last_price": 2, "first_forecast": 2, "last_forecast": 2, "change_pct": 2,
        "forecast_volatility_pct": 2, "recent_volatility_pct": 2, "slope": 4,
    }
    shown = [(F.round(c, n) if rounded else F.col(c)).alias(c) for c, n in digits.items()]
    return rows.select(
        *key,
        F.when(rise, ADVICE_RISE).when(fall, ADVICE_FALL).otherwise(ADVICE_FLAT).alias("recommendation"),
        F.when(sure, "High").otherwise(calm).alias("confidence"),
        why.alias("rationale"),
        F.struct(*shown).alias("metrics"),
    )
