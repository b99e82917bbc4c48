"""Model checks: iterative fits without an SQL twin, and the fallback rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.panels import MONTH, panel
from checks.registry import add
from pricewell.models import ensemble as N
from pricewell.models import gbt as G
from pricewell.models import sequence as Q
from pricewell.plans.retrain import effective_pairs, retrain
from pricewell.plans.session import cut_lineage, new_path
from pricewell.schema import SERIES_KEY
from pricewell.sources.sinks import read_log
from pricewell.sources.star import star_prices

# the operator's own settings; unit tests use few and shallow trees
TREES = G.TreeSettings()
STEPS, VALIDATION = 30, 90


def _panel(s, d):
    return cut_lineage(panel(s, d))


add("sequence_forecast", lambda s, d: (lambda p: Q.forecast(Q.fit(p), p, STEPS))(_panel(s, d)))
add("gbt_evaluate", lambda s, d: G.evaluate(_panel(s, d), 90, TREES))
add("gbt_forecast", lambda s, d: (lambda p: G.forecast(G.fit(p, TREES), p, STEPS))(_panel(s, d)))
add("gbt_explain", lambda s, d: (lambda p: G.explain_next_step(G.fit(p, TREES), p, 8))(_panel(s, d)))
add("ensemble_weights", lambda s, d: N.fit_weights(_panel(s, d), TREES, VALIDATION))


def _retrained(s, d):
    log = new_path(s, "log")
    retrain(star_prices(s, d), log, new_path(s, "models"), steps=STEPS, trees=TREES, validation=VALIDATION)
    return read_log(s, log).drop("created_at")


add("retrain_log", _retrained)


def _fallback(s, d):
    p = panel(s, d, "MS")
    return effective_pairs(p.select(*SERIES_KEY).distinct(), p, star_prices(s, d), 80, 20)


add("effective_pairs", _fallback, """
SELECT commodity, state, points, best_state,
       CASE WHEN points >= 80 THEN state ELSE best_state END AS used_state, NOT points >= 80 AS fell_back
FROM (SELECT commodity, state, count(*) AS points FROM monthly GROUP BY commodity, state)
LEFT JOIN (SELECT commodity, state AS best_state FROM (
  SELECT commodity, state, market, count(*) AS n FROM prices GROUP BY ALL HAVING count(*) >= 20)
  QUALIFY row_number() OVER (PARTITION BY commodity ORDER BY n DESC, market, state) = 1) USING (commodity)""",
    ctes=MONTH)
