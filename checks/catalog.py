"""Catalogue queries (aggregates, filters, scalar expressions, sorts) and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import add
from pricewell.functions import expressions as X
from pricewell.functions import names as N
from pricewell.operators import catalog as C
from pricewell.sources.star import star_prices as prices

CROP = "Brand#2"
STATE = "NATION_9"


def _round(df, **digits):
    """Even out the last bits of sums, which depend on the order of addition."""
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


# --- overview, lists, summaries ---------------------------------------------------
add("overview", lambda s, d: _round(C.overview(prices(s, d), None), avg_modal_price=4), """
SELECT count(*) AS total_rows, count(DISTINCT commodity) AS unique_crops,
       count(DISTINCT market) AS unique_markets, count(DISTINCT state) AS unique_states,
       min(arrival_date) AS date_from, max(arrival_date) AS date_to,
       round(avg(modal_price), 4) AS avg_modal_price, median(modal_price) AS median_modal_price
FROM prices""")

add("list_crops", lambda s, d: C.list_crops(prices(s, d), 100, None), """
SELECT commodity, count(*) AS records, count(DISTINCT market) AS markets,
       count(DISTINCT state) AS states, median(modal_price) AS median_price
FROM prices GROUP BY commodity HAVING count(*) >= 100""")

add("list_states", lambda s, d: C.list_states(prices(s, d)), """
SELECT state, count(*) AS records, min(arrival_date) AS first_date, max(arrival_date) AS last_date
FROM prices GROUP BY state""")

add("list_states_of_crop", lambda s, d: C.list_states(prices(s, d), CROP), """
SELECT state, count(*) AS records, min(arrival_date) AS first_date, max(arrival_date) AS last_date
FROM prices WHERE commodity = 'Brand#2' GROUP BY state""")

_SUMMARY = """
SELECT state, count(DISTINCT commodity) AS crops, count(DISTINCT market) AS markets,
       count(*) AS records, median(modal_price) AS median_price,
       round(stddev_samp(modal_price), 4) AS price_stddev
FROM prices {where} GROUP BY state"""
add("state_summary", lambda s, d: _round(C.state_summary(prices(s, d), None, None), price_stddev=4),
    _SUMMARY.format(where=""))
add("state_summary_of_year",
    lambda s, d: _round(C.state_summary(prices(s, d), 1998, None), price_stddev=4),
    _SUMMARY.format(where="WHERE year = 1998"))

add("distinct_crops", lambda s, d: C.distinct_names(prices(s, d), "commodity"),
    "SELECT DISTINCT commodity FROM prices ORDER BY commodity")
add("distinct_states", lambda s, d: C.distinct_names(prices(s, d), "state"),
    "SELECT DISTINCT state FROM prices ORDER BY state")
add("top_crop", lambda s, d: C.top_crop(prices(s, d)), """
SELECT commodity, count(*) AS records FROM prices GROUP BY commodity
ORDER BY records DESC, commodity LIMIT 1""")

# --- seasonality, trend ------------------------------------------------------------
add("seasonal_average",
    lambda s, d: _round(C.seasonal_average(prices(s, d), CROP, None), avg_price=4, price_stddev=4), """
SELECT month, round(avg(modal_price), 4) AS avg_price, median(modal_price) AS median_price,
       round(stddev_samp(modal_price), 4) AS price_stddev, count(*) AS records
FROM prices WHERE commodity = 'Brand#2' GROUP BY month""")
add("monthly_pattern", lambda s, d: _round(C.monthly_pattern(prices(s, d), None), std_price=4), """
SELECT month, median(modal_price) AS median_price, round(stddev_samp(modal_price), 4) AS std_price
FROM prices GROUP BY month""")
_TREND = """
SELECT year, median(modal_price) AS median_price, round(avg(modal_price), 4) AS avg_price,
       count(*) AS records FROM prices {where} GROUP BY year"""
add("yearly_trend", lambda s, d: _round(C.yearly_trend(prices(s, d), None, None), avg_price=4),
    _TREND.format(where=""))
add("yearly_trend_of_crop",
    lambda s, d: _round(C.yearly_trend(prices(s, d), CROP, None), avg_price=4),
    _TREND.format(where="WHERE commodity = 'Brand#2'"))
add("records_per_year", lambda s, d: C.records_per_year(prices(s, d)),
    "SELECT year, count(*) AS records FROM prices GROUP BY year")
_MONTHLY = """
SELECT year, month, state, median(modal_price) AS median_price
FROM prices WHERE commodity = 'Brand#2' GROUP BY year, month, state"""
add("state_month_medians", lambda s, d: C.state_month_medians(prices(s, d), CROP, None), _MONTHLY)
add("state_correlation",
    lambda s, d: _round(C.state_correlation(prices(s, d), CROP, 10), correlation=6), """
SELECT a.state AS state_a, b.state AS state_b,
       round(CASE WHEN isnan(corr(a.median_price, b.median_price)) THEN NULL
                  ELSE corr(a.median_price, b.median_price) END, 6) AS correlation,
       count(*) AS months
FROM m a JOIN m b ON a.year = b.year AND a.month = b.month AND a.state < b.state
WHERE a.median_price IS NOT NULL AND b.median_price IS NOT NULL
GROUP BY a.state, b.state HAVING count(*) >= 3""", ctes=["""
top AS (SELECT state FROM prices WHERE commodity = 'Brand#2'
        GROUP BY state ORDER BY count(*) DESC, state LIMIT 10)""", f"""
m AS (SELECT * FROM ({_MONTHLY}) WHERE state IN (SELECT state FROM top))"""])

# --- spread, quality, distribution -------------------------------------------------
add("top_volatile_markets",
    lambda s, d: _round(C.top_volatile_markets(prices(s, d), CROP, 10, 20, None, None), volatility=4, cv=6), """
SELECT market, state, round(stddev_samp(modal_price), 4) AS volatility,
       median(modal_price) AS median_price,
       round(stddev_samp(modal_price) / nullif(avg(modal_price), 0), 6) AS cv, count(*) AS records
FROM prices WHERE commodity = 'Brand#2' GROUP BY market, state HAVING count(*) >= 20
ORDER BY stddev_samp(modal_price) DESC, market, state LIMIT 10""")
_CHECKS = {"null_modal": "modal_price IS NULL", "null_min": "min_price IS NULL",
           "null_max": "max_price IS NULL", "null_state": "state IS NULL",
           "min_gt_modal": "min_price > modal_price", "modal_gt_max": "modal_price > max_price"}
add("quality_audit",
    lambda s, d: _round(C.quality_audit(prices(s, d)), **{f"{n}_pct": 9 for n in _CHECKS}),
    "SELECT count(*) AS total, "
    + ", ".join(f"CAST(sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS BIGINT) AS {n}" for n, c in _CHECKS.items())
    + ", "
    + ", ".join(
        f"round(CAST(sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS BIGINT) / count(*) * 100, 9) AS {n}_pct"
        for n, c in _CHECKS.items())
    + " FROM prices")
add("price_distribution",
    lambda s, d: _round(C.price_distribution(prices(s, d), None), mean=4, std=4, p5=9, p95=9), """
SELECT min(modal_price) AS min, median(modal_price) AS median, round(avg(modal_price), 4) AS mean,
       max(modal_price) AS max, round(stddev_samp(modal_price), 4) AS std,
       round(quantile_cont(modal_price, 0.05), 9) AS p5,
       round(quantile_cont(modal_price, 0.95), 9) AS p95
FROM prices""")
add("price_histogram", lambda s, d: C.price_histogram(prices(s, d)), """
SELECT floor(modal_price / 1000) * 1000 AS bucket, count(*) AS cnt
FROM prices WHERE modal_price < 30000 GROUP BY bucket""")
_PAIRS = """
SELECT commodity, state, count(*) AS records, min(modal_price) AS min_price,
       median(modal_price) AS median_price, max(modal_price) AS max_price,
       round(avg(modal_price), 4) AS mean_price, round(stddev_samp(modal_price), 4) AS std_price,
       round(stddev_samp(modal_price) / nullif(avg(modal_price), 0), 6) AS cv
FROM prices GROUP BY commodity, state HAVING count(*) >= 100"""
add("pair_summary",
    lambda s, d: _round(C.pair_summary(prices(s, d), 100, None, None), mean_price=4, std_price=4, cv=6),
    _PAIRS)

# --- coverage ----------------------------------------------------------------------
_COVER = """
SELECT commodity, market, state, count(*) AS total_records, min(arrival_date) AS date_from,
       max(arrival_date) AS date_to,
       round((max(arrival_date) - min(arrival_date)) / 365.25, 1) AS years_of_data
FROM prices GROUP BY commodity, market, state"""
add("best_covered_markets", lambda s, d: C.best_covered_markets(prices(s, d), None, 20, 1), """
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY commodity
                 ORDER BY total_records DESC, market, state) AS INT) AS rank FROM c
               WHERE total_records >= 20) WHERE rank <= 1""", ctes=[f"c AS ({_COVER})"])
add("best_state_of_crop",
    lambda s, d: C.best_covered_markets(prices(s, d), CROP, 20, 1).select("state"), """
SELECT state FROM c WHERE commodity = 'Brand#2' AND total_records >= 20
ORDER BY total_records DESC, market, state LIMIT 1""", ctes=[f"c AS ({_COVER})"])
add("suggest_states", lambda s, d: C.suggest_states(prices(s, d), CROP, 5, 15), """
SELECT market, state, total_records AS records, years_of_data AS years FROM c
WHERE commodity = 'Brand#2' AND total_records > 15
ORDER BY total_records DESC, market, state LIMIT 5""", ctes=[f"c AS ({_COVER})"])
add("priciest_pairs", lambda s, d: C.priciest_pairs(prices(s, d), 1996, 1999), """
SELECT state, commodity, median(modal_price) AS median_price
FROM prices WHERE year BETWEEN 1996 AND 1999 GROUP BY state, commodity
ORDER BY median_price DESC, state, commodity LIMIT 20""")

# --- filters and scalar expressions --------------------------------------------------
add("name_match_collapsed", lambda s, d: N.match_name(
    prices(s, d).withColumn("commodity", F.regexp_replace("commodity", r"\s+", " ")), "commodity", CROP
).groupBy("grade").agg(F.count("*").alias("records")), r"""
SELECT grade, count(*) AS records FROM prices
WHERE regexp_replace(commodity, '\s+', ' ', 'g') = 'Brand#2' GROUP BY grade""")
add("name_match_exact", lambda s, d: N.match_name(prices(s, d), "state", STATE)
    .groupBy("commodity").agg(F.count("*").alias("records")), """
SELECT commodity, count(*) AS records FROM prices WHERE state = 'NATION_9' GROUP BY commodity""")
add("year_filters", lambda s, d: C.between_years(prices(s, d), 1996, 1998)
    .groupBy("year", "month").agg(F.count("*").alias("records")), """
SELECT year, month, count(*) AS records FROM prices WHERE year BETWEEN 1996 AND 1998
GROUP BY year, month""")
add("price_bound", lambda s, d: C.below_price(prices(s, d), 30000)
    .groupBy("commodity").agg(F.count("*").alias("records")),
    "SELECT commodity, count(*) AS records FROM prices WHERE modal_price < 30000 GROUP BY commodity")
add("loose_match", lambda s, d: N.match_loosely(prices(s, d), " BRAND#2 ", "nation_1", "commodity")
    .groupBy("state").agg(F.count("*").alias("records")), """
SELECT state, count(*) AS records FROM prices
WHERE lower(trim(commodity)) = 'brand#2' AND contains(lower(state), 'nation_1') GROUP BY state""")


def _miss(s, d):
    report = N.miss_report(prices(s, d), "brand#2", "commodity")
    part = lambda label, df, c: df.select(F.lit(label).alias("what"), F.col(c).cast("string").alias("value"))
    return (part("rows", report["rows"], "matching_rows")
            .unionByName(part("crop", report["crops"], "commodity"))
            .unionByName(part("state", report["states"], "state")))


add("miss_report", _miss, """
SELECT 'rows' AS what, CAST(count(*) AS VARCHAR) AS value FROM near
UNION ALL SELECT DISTINCT 'crop', commodity FROM near
UNION ALL (SELECT 'state', state FROM (SELECT DISTINCT state FROM near) ORDER BY state LIMIT 100)""",
    ctes=["near AS (SELECT * FROM prices WHERE contains(lower(commodity), 'brand#2'))"])
add("normalised_names", lambda s, d: prices(s, d).select(
    N.normalise_name("commodity").alias("commodity"), N.normalise_name("state").alias("state"),
).groupBy("commodity", "state").agg(F.count("*").alias("records")), """
SELECT regexp_replace(trim(commodity), '\\s+', ' ', 'g') AS commodity,
       'Nation_' || substr(state, 8) AS state, count(*) AS records
FROM prices GROUP BY ALL""")
add("calendar_columns", lambda s, d: prices(s, d).drop("year", "month")
    .withColumns(X.calendar_columns()).groupBy("year", "month").agg(F.count("*").alias("records")), """
SELECT CAST(year(arrival_date) AS INT) AS year, CAST(month(arrival_date) AS INT) AS month,
       count(*) AS records FROM prices GROUP BY 1, 2""")
add("variation_by_crop", lambda s, d: prices(s, d).groupBy("commodity")
    .agg(F.round(X.variation("modal_price"), 6).alias("cv")), """
SELECT commodity, round(stddev_samp(modal_price) / nullif(avg(modal_price), 0), 6) AS cv
FROM prices GROUP BY commodity""")
add("log_price_by_crop", lambda s, d: prices(s, d).groupBy("commodity")
    .agg(F.round(F.avg(X.natural_log("modal_price")), 6).alias("avg_log")), """
SELECT commodity, round(avg(CASE WHEN modal_price > 0 THEN ln(modal_price) END), 6) AS avg_log
FROM prices GROUP BY commodity""")


def _band(s, d):
    m = C.monthly_pattern(prices(s, d), None).withColumns(X.season_band("median_price", "std_price"))
    return _round(m.select("month", "band_low", "band_high"), band_low=4, band_high=4)


add("season_band", _band, """
SELECT month, round(median(modal_price) - 0.3 * stddev_samp(modal_price), 4) AS band_low,
       round(median(modal_price) + 0.3 * stddev_samp(modal_price), 4) AS band_high
FROM prices GROUP BY month""")
add("scaled_counts", lambda s, d: C.records_per_year(prices(s, d)).select(
    "year", X.thousands("records").alias("thousands")),
    "SELECT year, count(*) / 1000 AS thousands FROM prices GROUP BY year")
add("top_states_by_price", lambda s, d: C.largest_then_by(
    C.state_summary(prices(s, d), None, None), "records", 15, "median_price", "state",
).select("state", "records", "median_price"), """
SELECT state, count(*) AS records, median(modal_price) AS median_price FROM prices
GROUP BY state ORDER BY records DESC, state LIMIT 15""")
add("top_crops_by_records", lambda s, d: C.largest_then_by(
    C.list_crops(prices(s, d), 1000, None), "records", 20, "records", "commodity",
).select("commodity", X.thousands("records").alias("thousands")), """
SELECT commodity, count(*) / 1000 AS thousands FROM prices GROUP BY commodity
HAVING count(*) >= 1000 ORDER BY count(*) DESC, commodity LIMIT 20""")


# --- SQL access --------------------------------------------------------------------
def _sql(s, d):
    C.register_prices(prices(s, d))
    return C.query(s, """
      SELECT state, commodity, count(*) AS records FROM prices
      WHERE year BETWEEN :a AND :b GROUP BY state, commodity""", a=1996, b=1997)


add("sql_query", _sql, """
SELECT state, commodity, count(*) AS records FROM prices
WHERE year BETWEEN 1996 AND 1997 GROUP BY state, commodity""")


def _scalar(s, d):
    C.register_prices(prices(s, d))
    n = C.scalar(s, "SELECT count(*) FROM prices WHERE grade = :g", g="R")
    # the value is used as a constant beside a count over the table
    return prices(s, d).agg(F.count("*").alias("total")).withColumn("returned", F.lit(n).cast("bigint"))


add("sql_scalar", _scalar, """
SELECT count(*) AS total, count(CASE WHEN grade = 'R' THEN 1 END) AS returned FROM prices""")
