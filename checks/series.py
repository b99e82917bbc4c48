"""Series, alignment and feature checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.panels import BASE, DAILY, MONTH, WEEK, daily, panel
from checks.registry import add
from pricewell.functions.expressions import natural_log
from pricewell.operators import align as J
from pricewell.operators import features as E
from pricewell.operators import series as W
from pricewell.schema import SERIES_KEY
from pricewell.sources.star import star_prices as prices

OVER = "OVER (PARTITION BY commodity, state ORDER BY date)"


def _round(df, **digits):
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


def _digest(df, *columns):
    """Row count and column sums per series, over every row of a wide frame."""
    return df.groupBy(*SERIES_KEY).agg(
        F.count("*").alias("rows"),
        *[F.round(F.sum(c), 3).alias(f"sum_{c}") for c in columns],
        *[F.count(c).alias(f"n_{c}") for c in columns],
    )


def _digest_sql(table, *columns):
    parts = ["commodity", "state", "count(*) AS rows"]
    parts += [f"round(CAST(sum({c}) AS DOUBLE), 3) AS sum_{c}" for c in columns]
    parts += [f"count({c}) AS n_{c}" for c in columns]
    return f"SELECT {', '.join(parts)} FROM {table} GROUP BY commodity, state"


# --- the daily series -----------------------------------------------------------------
add("daily_median", lambda s, d: W.daily_median(prices(s, d)), """
SELECT commodity, state, arrival_date AS date, median(modal_price) AS y
FROM prices GROUP BY commodity, state, arrival_date""")
add("densify", lambda s, d: J.on_calendar(daily(s, d)).drop("observed"), """
SELECT commodity, state, c.date, d.y FROM cal c LEFT JOIN daily d USING (commodity, state, date)""",
    ctes=BASE[:3])
add("densify_forward_fill", lambda s, d: W.densify(daily(s, d)), "SELECT * FROM dense", ctes=BASE)
add("forward_fill", lambda s, d: W.forward_fill(J.on_calendar(daily(s, d)).drop("observed")),
    "SELECT commodity, state, date, y FROM dense", ctes=BASE)
_RAW = [DAILY.replace("floor(median(modal_price) * 100) / 100", "median(modal_price)")] + WEEK[1:]
add("crop_series_weekly", lambda s, d: W.crop_series(prices(s, d), freq="W"),
    "SELECT * FROM weekly", ctes=_RAW)
add("crop_series_monthly", lambda s, d: W.crop_series(prices(s, d), freq="MS"),
    "SELECT * FROM monthly", ctes=_RAW[:-1] + [MONTH[-1]])
add("crop_series_of_pair",
    lambda s, d: W.crop_series(prices(s, d), "Brand#2", "NATION_9", "D", strict=True), """
SELECT commodity, state, date, y FROM dense WHERE commodity = 'Brand#2' AND state = 'NATION_9'""",
    ctes=_RAW[:4])

# --- rolling, differences, tails, splits -------------------------------------------------
def _rolling(s, d):
    p = panel(s, d, "W").withColumn("logy", natural_log("y"))
    p = W.rolling_mean(W.rolling_mean(p, 12), 30, "logy", "log_rolling_30")
    return _round(p.drop("logy"), rolling_12=6, log_rolling_30=6)


add("rolling_mean", _rolling, """
SELECT commodity, state, date, y,
  round(CASE WHEN count(y) OVER w12 = 12 THEN avg(y) OVER w12 END, 6) AS rolling_12,
  round(CASE WHEN count(ly) OVER w30 = 30 THEN avg(ly) OVER w30 END, 6) AS log_rolling_30
FROM (SELECT *, CASE WHEN y > 0 THEN ln(y) END AS ly FROM weekly)
WINDOW w12 AS (PARTITION BY commodity, state ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW),
       w30 AS (PARTITION BY commodity, state ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""",
    ctes=WEEK)
add("first_difference", lambda s, d: W.difference(panel(s, d, "W")), f"""
SELECT * FROM (SELECT commodity, state, date, y - lag(y) {OVER} AS y FROM weekly) WHERE y IS NOT NULL""",
    ctes=WEEK)
add("lag_difference", lambda s, d: W.difference(panel(s, d, "W"), 2), f"""
SELECT * FROM (SELECT commodity, state, date, y - lag(y, 2) {OVER} AS y FROM weekly) WHERE y IS NOT NULL""",
    ctes=WEEK)
add("second_difference", lambda s, d: W.repeated_difference(panel(s, d, "MS"), 2), f"""
SELECT * FROM (SELECT commodity, state, date, (y - lag(y) {OVER}) - (lag(y) {OVER} - lag(y, 2) {OVER}) AS y
FROM monthly) WHERE y IS NOT NULL""", ctes=MONTH)
add("last_rows", lambda s, d: W.last_rows(panel(s, d), 120), """
SELECT commodity, state, date, y FROM dense
QUALIFY row_number() OVER (PARTITION BY commodity, state ORDER BY date DESC) <= 120""", ctes=BASE)
_SPLIT = """
SELECT commodity, state, date, y, CASE WHEN size >= n THEN NULL WHEN back <= size THEN 'test' ELSE 'train' END AS part
FROM (SELECT *, CASE WHEN n < 30 THEN greatest(1, n // 3) ELSE least({t}, n - 1) END AS size
      FROM (SELECT *, count(*) OVER (PARTITION BY commodity, state) AS n,
                   row_number() OVER (PARTITION BY commodity, state ORDER BY date DESC) AS back FROM {src}))"""
add("split_train_test", lambda s, d: W.split_train_test(panel(s, d, "W"), 90),
    _SPLIT.format(t=90, src="weekly"), ctes=WEEK)
add("split_train_test_short", lambda s, d: W.split_train_test(W.last_rows(panel(s, d, "MS"), 20), 90),
    _SPLIT.format(t=90, src="""(SELECT * FROM monthly
    QUALIFY row_number() OVER (PARTITION BY commodity, state ORDER BY date DESC) <= 20)"""), ctes=MONTH)
add("standardise", lambda s, d: _round(
    W.unstandardise(W.standardise(panel(s, d, "MS")), "z", "back"), mean=9, scale=4, z=6, back=4), """
SELECT commodity, state, date, y, round(m, 9) AS mean, round(s, 4) AS scale,
       round((y - m) / s, 6) AS z, round((y - m) / s * s + m, 4) AS back
FROM (SELECT *, avg(y) OVER k AS m,
             CASE WHEN stddev_pop(y) OVER k = 0 THEN 1.0 ELSE stddev_pop(y) OVER k END AS s
      FROM monthly WINDOW k AS (PARTITION BY commodity, state))""", ctes=MONTH)
add("describe_series", lambda s, d: _round(
    W.describe(panel(s, d), None), mean=4, std=4, p25=6, p50=6, p75=6), """
SELECT commodity, state, count(y) AS count, round(avg(y), 4) AS mean, round(stddev_samp(y), 4) AS std,
       min(y) AS min, round(quantile_cont(y, 0.25), 6) AS p25, round(quantile_cont(y, 0.5), 6) AS p50,
       round(quantile_cont(y, 0.75), 6) AS p75, max(y) AS max,
       min(date) AS first_date, max(date) AS last_date
FROM dense GROUP BY commodity, state""", ctes=BASE)

# --- features ---------------------------------------------------------------------------
CAL_SQL = """CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month, CAST(day(date) AS INT) AS day,
  CAST(isodow(date) - 1 AS INT) AS dayofweek, CAST(weekofyear(date) AS INT) AS weekofyear,
  CAST(quarter(date) AS INT) AS quarter, CAST(day(date) = 1 AS INT) AS is_month_start,
  CAST(date = last_day(date) AS INT) AS is_month_end, CAST(isodow(date) >= 6 AS INT) AS is_weekend"""
add("calendar_features", lambda s, d: panel(s, d).groupBy("date").agg(F.count("*").alias("series"))
    .withColumns(E.calendar_features()),
    f"SELECT date, count(*) AS series, {CAL_SQL} FROM dense GROUP BY date", ctes=BASE)


def _feature_sql(h, lags=E.LAGS, windows=E.WINDOWS):
    """Definition by window frames, for series longer than every lookback."""
    cols = [f"lag(y, {k + h - 1}) OVER s AS lag_{k}" for k in lags]
    frames = ["s AS (PARTITION BY commodity, state ORDER BY date)"]
    for n in windows:
        frames.append(f"w{n} AS (PARTITION BY commodity, state ORDER BY date "
                      f"ROWS BETWEEN {n + h - 1} PRECEDING AND {h} PRECEDING)")
        cols += [f"{fn}(y) OVER w{n} AS roll_{nm}_{n}" for nm, fn in
                 (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"))]
    look = max(lags + windows)
    return (f"feats AS (SELECT * FROM (SELECT commodity, state, date, y AS target, row_number() OVER s AS rn, {CAL_SQL}, "
            + ", ".join(cols) + " FROM dense WINDOW " + ", ".join(frames) + f") WHERE rn >= {look + h})")


_COLS = ["target", *E.CALENDAR, *E.lag_names(E.LAGS), *E.roll_names(E.WINDOWS)]
_LAGS = ["target", *E.lag_names(E.LAGS)]
_ROLLS = E.roll_names(E.WINDOWS)
add("feature_frame", lambda s, d: _digest(E.feature_frame(panel(s, d)), *_COLS),
    _digest_sql("feats", *_COLS), ctes=BASE + [_feature_sql(1)])
add("feature_frame_horizon_3", lambda s, d: _digest(E.feature_frame(panel(s, d), horizon=3), *_LAGS, *_ROLLS),
    _digest_sql("feats", *_LAGS, *_ROLLS), ctes=BASE + [_feature_sql(3)])
add("lag_features", lambda s, d: E.feature_frame(panel(s, d), windows=(7,)).select(*SERIES_KEY, "date", *_LAGS),
    f"SELECT commodity, state, date, {', '.join(_LAGS)} FROM feats",
    ctes=BASE + [_feature_sql(1, windows=(7,))])


def rolling_query(s, d):
    """Every row and window."""
    return E.feature_frame(panel(s, d), lags=(1,)).select(*SERIES_KEY, "date", *_ROLLS)


add("rolling_features", rolling_query)
# Two windows on the first days of months, beside the whole frame above, which has no SQL.
add("rolling_features_month_starts", lambda s, d: _round(
    E.feature_frame(panel(s, d), lags=(1,), windows=(7, 30)).where(F.dayofmonth("date") == 1)
    .select(*SERIES_KEY, "date", *E.roll_names((7, 30))),
    roll_mean_7=6, roll_std_7=4, roll_mean_30=6, roll_std_30=4), """
SELECT commodity, state, date, round(roll_mean_7, 6) AS roll_mean_7, round(roll_std_7, 4) AS roll_std_7,
  roll_min_7, roll_max_7, round(roll_mean_30, 6) AS roll_mean_30, round(roll_std_30, 4) AS roll_std_30,
  roll_min_30, roll_max_30 FROM feats WHERE day(date) = 1""", ctes=BASE + [_feature_sql(1, (1,), (7, 30))])
_STATS = [f"roll_{k}_{n}" for n in E.WINDOWS for k in ("mean", "std")]
add("next_feature_row", lambda s, d: _round(E.next_feature_row(panel(s, d)), **{c: 4 for c in _STATS}),
    "SELECT commodity, state, last + 1 AS date, " + CAL_SQL.replace("date", "(last + 1)") .replace("last_day((last + 1))", "last_day(last + 1)")
    + ", " + ", ".join(f"h[len(h) - {k - 1}] AS lag_{k}" for k in E.LAGS) + ", "
    + ", ".join(
        f"round(list_avg(h[len(h) - {n - 1}:]), 4) AS roll_mean_{n}, "
        f"round(list_stddev_pop(h[len(h) - {n - 1}:]), 4) AS roll_std_{n}, "
        f"list_min(h[len(h) - {n - 1}:]) AS roll_min_{n}, list_max(h[len(h) - {n - 1}:]) AS roll_max_{n}"
        for n in E.WINDOWS)
    + " FROM (SELECT commodity, state, max(date) AS last, list(y ORDER BY date) AS h FROM dense GROUP BY commodity, state)",
    ctes=BASE)


def _windows(s, d):
    wins = E.sliding_windows(W.standardise(panel(s, d)), 30)
    wins = wins.withColumns({"first": F.element_at("inputs", 1), "last": F.element_at("inputs", -1),
                             "total": F.aggregate("inputs", F.lit(0.0), lambda a, x: a + x)})
    return _digest(wins, "target", "first", "last", "total")


add("sliding_windows", _windows, _digest_sql("wins", "target", "first", "last", "total"), ctes=BASE + ["""
scaled AS (SELECT *, (y - avg(y) OVER k) / CASE WHEN stddev_pop(y) OVER k = 0 THEN 1 ELSE stddev_pop(y) OVER k END AS z
           FROM dense WINDOW k AS (PARTITION BY commodity, state))""", """
wins AS (SELECT * FROM (SELECT commodity, state, date, z AS target, lag(z, 30) OVER s AS first, lag(z) OVER s AS last,
           sum(z) OVER (PARTITION BY commodity, state ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS total,
           row_number() OVER s AS rn FROM scaled WINDOW s AS (PARTITION BY commodity, state ORDER BY date))
         WHERE rn > 30)"""])
