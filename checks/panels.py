"""Panels derived from the test tables, as DataFrames and as SQL CTEs.

Series checks run on daily medians cut to whole hundredths, as real market prices
are: sums and means of such values cannot sit on a rounding tie, so both engines
round the last bits alike.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pricewell.operators import series as W
from pricewell.sources.star import star_prices

DAILY = """daily AS (
  SELECT commodity, state, arrival_date AS date, floor(median(modal_price) * 100) / 100 AS y
  FROM prices GROUP BY commodity, state, arrival_date)"""
SPAN = "span AS (SELECT commodity, state, min(date) AS a, max(date) AS b FROM daily GROUP BY commodity, state)"
CAL = """cal AS (SELECT commodity, state,
  CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM span)"""
DENSE = """dense AS (
  SELECT commodity, state, c.date,
         last_value(d.y IGNORE NULLS) OVER (PARTITION BY commodity, state ORDER BY c.date
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y,
         d.y IS NOT NULL AS observed
  FROM cal c LEFT JOIN daily d USING (commodity, state, date))"""
WEEKLY = """weekly AS (
  SELECT commodity, state, CAST(date_trunc('week', date) AS DATE) + 6 AS date, median(y) AS y
  FROM dense GROUP BY commodity, state, CAST(date_trunc('week', date) AS DATE) + 6)"""
MONTHLY = """monthly AS (
  SELECT commodity, state, CAST(date_trunc('month', date) AS DATE) AS date, median(y) AS y
  FROM dense GROUP BY commodity, state, CAST(date_trunc('month', date) AS DATE))"""
BASE = [DAILY, SPAN, CAL, DENSE]
WEEK = BASE + [WEEKLY]
MONTH = BASE + [MONTHLY]


def daily(spark, sf_dir):
    out = W.daily_median(star_prices(spark, sf_dir))
    return out.withColumn("y", F.floor(F.col("y") * 100).cast("double") / 100)


def panel(spark, sf_dir, freq="D"):
    return W.resample(W.densify(daily(spark, sf_dir)), freq)
