"""Alignment, evaluation, drift, advisory and fallback checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.panels import BASE, panel
from checks.registry import add
from checks.statistics import FIN, K, OVER, arima_ctes, arima_path
from pricewell.models import arima as M
from pricewell.operators import align as J
from pricewell.operators import drift as D
from pricewell.operators import evaluate as V
from pricewell.operators import series as W
from pricewell.operators.advisory import crop_advisory
from pricewell.plans.sizing import stacked
from pricewell.schema import SERIES_KEY


def _round(df, **digits):
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


# --- actual against forecast ----------------------------------------------------------
def _holdout(s, d):
    parts = W.split_train_test(panel(s, d), 90)
    predicted = M.forecast(M.fit(parts.where("part = 'train'").drop("part")), 90, None)
    return J.actual_with_forecast(
        parts.where("part = 'test'"), predicted.select(*SERIES_KEY, "date", "forecast"))


HOLD = BASE + [
    f"train AS (SELECT commodity, state, date, y FROM dense QUALIFY row_number() OVER ({K} ORDER BY date DESC) > 90)",
    *arima_ctes("train"), FIN, arima_path(90),
    "pairs AS (SELECT commodity, state, date, y AS actual, f AS predicted FROM fc JOIN dense USING (commodity, state, date))",
]
add("actual_with_forecast", lambda s, d: _round(_holdout(s, d), predicted=2),
    "SELECT commodity, state, date, actual, round(predicted, 2) AS predicted FROM pairs", ctes=HOLD, recursive=True)
add("holdout_metrics", lambda s, d: _round(V.metrics(_holdout(s, d), SERIES_KEY, 1e-6), rmse=3, mae=3, mape=3), """
SELECT commodity, state, round(sqrt(avg(pow(actual - predicted, 2))), 3) AS rmse,
       round(avg(abs(actual - predicted)), 3) AS mae,
       round(avg(abs((actual - predicted) / CASE WHEN actual = 0 THEN 1e-6 ELSE actual END)) * 100, 3) AS mape,
       count(*) AS n_test
FROM pairs GROUP BY commodity, state""", ctes=HOLD, recursive=True)


def _wide(s, d):
    p = panel(s, d)
    walk = M.fit_autoregressions(p).where("model = 'ARIMA(0,1,0)'")
    both = stacked([M.forecast(M.fit(p), 30, None).withColumn("model", F.lit("arima")),
                    M.forecast(walk, 30, None).withColumn("model", F.lit("last"))], SERIES_KEY)
    return _round(J.side_by_side(both, ["arima", "last"]), arima_forecast=2, last_forecast=2)


add("side_by_side", _wide, """
SELECT commodity, state, date, round(f, 2) AS arima_forecast, round(yn, 2) AS last_forecast
FROM fc JOIN fin USING (commodity, state)""", ctes=BASE + arima_ctes() + [FIN, arima_path(30)], recursive=True)
add("missing_pairs", lambda s, d: J.missing_from(
    panel(s, d, "MS").select(*SERIES_KEY).distinct(),
    panel(s, d, "MS").where("y > 50000").select(*SERIES_KEY), SERIES_KEY), """
SELECT DISTINCT commodity, state FROM dense d1 WHERE NOT EXISTS (
  SELECT 1 FROM monthly m WHERE m.commodity = d1.commodity AND m.state = d1.state AND m.y > 50000)""",
    ctes=BASE + ["monthly AS (SELECT commodity, state, median(y) AS y FROM dense GROUP BY commodity, state, date_trunc('month', date))"])

# --- sizes and walk-forward validation ---------------------------------------------------
add("test_sizes", lambda s, d: V.test_sizes(panel(s, d)).unionByName(
    V.test_sizes(W.last_rows(panel(s, d, "MS"), 60)).withColumn("commodity", F.concat(F.lit("short "), "commodity"))), """
SELECT commodity, state, n,
  CAST(CASE WHEN n <= a * 3 + 10 THEN greatest(7, n // 5) ELSE a END AS INT) AS arima_test,
  CAST(CASE WHEN n <= t + 30 THEN greatest(30, n // 4) ELSE t END AS INT) AS tree_test
FROM (SELECT *, least(30, greatest(7, n // 10)) AS a, least(90, greatest(30, n // 8)) AS t FROM (
  SELECT commodity, state, count(*) AS n FROM dense GROUP BY commodity, state
  UNION ALL
  SELECT 'short ' || commodity, state, least(60, count(DISTINCT date_trunc('month', date))) FROM dense GROUP BY commodity, state))""",
    ctes=BASE)
_TRAIN = f"""train AS (SELECT commodity, state || '#' || fold AS state, date, y FROM (
    SELECT *, row_number() {OVER} AS rn, count(*) OVER ({K}) AS n FROM dense), (SELECT unnest(range(0, 3)) AS fold)
  WHERE rn <= n - 90 + fold * 30)"""
FOLDS = BASE + [_TRAIN, *arima_ctes("train"), FIN, arima_path(30), """
scores AS (SELECT commodity, split_part(fc.state, '#', 1) AS state, CAST(split_part(fc.state, '#', 2) AS INT) AS fold,
       sqrt(avg(pow(y - f, 2))) AS rmse, avg(abs(y - f)) AS mae, avg(abs((y - f) / nullif(y, 0))) * 100 AS mape,
       count(*) AS n_test
  FROM fc JOIN (SELECT commodity AS c, state AS s, date AS dt, y FROM dense) ON c = commodity AND s = split_part(fc.state, '#', 1) AND dt = fc.date
  GROUP BY ALL)"""]
add("walk_forward_folds", lambda s, d: V.walk_forward_folds(panel(s, d), 30, 5)[0]
    .groupBy(*SERIES_KEY, "fold").agg(F.count("*").alias("rows"), F.max("date").alias("train_end")), f"""
SELECT commodity, state, CAST(fold AS INT) AS fold, count(*) AS rows, max(date) AS train_end
FROM (SELECT *, row_number() {OVER} AS rn, count(*) OVER ({K}) AS n FROM dense), (SELECT unnest(range(0, 5)) AS fold)
WHERE rn <= n - 150 + fold * 30 GROUP BY commodity, state, fold""", ctes=BASE)
add("walk_forward_scores", lambda s, d: _round(V.walk_forward_scores(panel(s, d), 30, 3), rmse=3, mae=3, mape=3), """
SELECT commodity, state, fold, round(rmse, 3) AS rmse, round(mae, 3) AS mae, round(mape, 3) AS mape, n_test
FROM scores""", ctes=FOLDS, recursive=True)
add("walk_forward_cv", lambda s, d: _round(V.walk_forward_cv(panel(s, d), 30, 3, digits=None),
                                          rmse_mean=3, mae_mean=3, mape_mean=3, rmse_std=3), """
SELECT commodity, state, round(avg(rmse), 3) AS rmse_mean, round(avg(mae), 3) AS mae_mean,
       round(avg(mape), 3) AS mape_mean, round(stddev_pop(rmse), 3) AS rmse_std, count(*) AS n_folds
FROM scores GROUP BY commodity, state""", ctes=FOLDS, recursive=True)

# --- drift --------------------------------------------------------------------------------
_PSI = f"""
win AS (SELECT *, CASE WHEN back <= 90 THEN 'actual' ELSE 'expected' END AS part FROM (
  SELECT *, row_number() OVER ({K} ORDER BY date DESC) AS back, count(*) OVER ({K}) AS n FROM dense)
  WHERE n >= 455 AND back <= 455),
edges AS (SELECT commodity, state, list_distinct(quantile_cont(y, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS q
  FROM win WHERE part = 'expected' GROUP BY commodity, state),
bins AS (SELECT commodity, state, len(list_filter(q, lambda c: c <= y)) AS bin,
    count(CASE WHEN part = 'expected' THEN 1 END) AS e, count(CASE WHEN part = 'actual' THEN 1 END) AS a
  FROM win JOIN edges USING (commodity, state) GROUP BY ALL),
shares AS (SELECT commodity, state, CASE WHEN e = 0 THEN 1e-6 ELSE e / 365 END AS e,
    CASE WHEN a = 0 THEN 1e-6 ELSE a / 90 END AS a FROM bins),
psi AS (SELECT commodity, state, sum((a - e) * ln(a / e)) AS psi FROM shares GROUP BY commodity, state)"""
add("stability_index", lambda s, d: _round(
    D.drift_report(panel(s, d), digits=None).select(*SERIES_KEY, "psi"), psi=6),
    "SELECT commodity, state, round(psi, 6) AS psi FROM psi", ctes=BASE + [_PSI])
add("drift_report", lambda s, d: _round(
    D.drift_report(panel(s, d), digits=None), baseline_mean=6, recent_mean=6, mean_shift_pct=4, median_shift_pct=6, psi=4), """
SELECT commodity, state, points, round(bm, 6) AS baseline_mean, round(rm, 6) AS recent_mean,
       round((rm - bm) / bm * 100, 4) AS mean_shift_pct, round((rmed - bmed) / bmed * 100, 6) AS median_shift_pct,
       round(psi, 4) AS psi, 365 AS baseline_days, 90 AS recent_days, points < 455 AS insufficient_history
FROM (SELECT commodity, state, count(*) AS points FROM dense GROUP BY commodity, state)
LEFT JOIN (SELECT commodity, state, avg(y) FILTER (part = 'expected') AS bm, avg(y) FILTER (part = 'actual') AS rm,
             median(y) FILTER (part = 'expected') AS bmed, median(y) FILTER (part = 'actual') AS rmed
           FROM win GROUP BY commodity, state) USING (commodity, state)
LEFT JOIN psi USING (commodity, state)""", ctes=BASE + [_PSI])


# --- advisory -------------------------------------------------------------------------------
def _advice(s, d):
    p = panel(s, d)
    out = crop_advisory(p, M.forecast(M.fit(p), 30, None), rounded=False)
    flat = out.select(*SERIES_KEY, "recommendation", "confidence",
                      F.array_join("rationale", " | ").alias("rationale"), "metrics.*")
    return _round(flat, last_price=2, first_forecast=2, last_forecast=2, change_pct=3,
                  forecast_volatility_pct=3, recent_volatility_pct=3, slope=4)


add("crop_advisory", _advice, """
SELECT commodity, state,
  CASE WHEN chg >= 5 THEN 'Hold stock or sell in phases' WHEN chg <= -5 THEN 'Sell sooner' ELSE 'Hold / stagger sales' END AS recommendation,
  CASE WHEN ((chg >= 5 AND slope > 0) OR (chg <= -5 AND slope < 0)) AND NOT (fv >= 8 OR rv >= 8) THEN 'High' ELSE 'Medium' END AS confidence,
  CASE WHEN chg >= 5 THEN printf('Forecast price is expected to rise by about %.1f%% over the horizon.', chg)
         || ' | A phased sale may capture higher prices while reducing timing risk.'
       WHEN chg <= -5 THEN printf('Forecast price is expected to fall by about %.1f%% over the horizon.', abs(chg))
         || ' | Earlier selling may protect margins before prices soften.'
       ELSE 'Forecast is relatively flat, so sharp timing bets may not add much value. | Staggering sales can help balance risk and price capture.' END
  || CASE WHEN fv >= 8 OR rv >= 8 THEN ' | Price volatility is elevated, so avoid a single large market decision.' ELSE '' END AS rationale,
  round(lp, 2) AS last_price, round(ff, 2) AS first_forecast, round(lf, 2) AS last_forecast, round(chg, 3) AS change_pct,
  round(fv, 3) AS forecast_volatility_pct, round(rv, 3) AS recent_volatility_pct, round(slope, 4) AS slope
FROM (SELECT *, (lf - lp) / greatest(lp, 1e-6) * 100 AS chg FROM
  (SELECT commodity, state, arg_min(f, h) AS ff, arg_max(f, h) AS lf, stddev_pop(f) / greatest(avg(f), 1e-6) * 100 AS fv,
          regr_slope(f, h) AS slope FROM fc GROUP BY commodity, state)
  JOIN (SELECT commodity, state, arg_max(y, date) AS lp, stddev_pop(y) / greatest(avg(y), 1e-6) * 100 AS rv
        FROM (SELECT * FROM dense QUALIFY row_number() OVER (PARTITION BY commodity, state ORDER BY date DESC) <= 30)
        GROUP BY commodity, state) USING (commodity, state))""",
    ctes=BASE + arima_ctes() + [FIN, arima_path(30)], recursive=True)
