"""Statistics and ARIMA checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.panels import BASE, MONTH, WEEK, panel
from checks.registry import add
from pricewell.models import arima as M
from pricewell.models.registry import ensure_arima
from pricewell.operators import series as W
from pricewell.operators import stats as S
from pricewell.plans.session import cut_lineage, new_path
from pricewell.schema import SERIES_KEY

K = "PARTITION BY commodity, state"
OVER = f"OVER ({K} ORDER BY date)"


def _round(df, **digits):
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


def _acov(src: str, lags: int, centred: bool = True, name: str = "acov") -> str:
    """Autocovariances g[1..lags+1] (lag 0 first) of a CTE with ``y``."""
    x = f"y - avg(y) OVER ({K})" if centred else "y"
    lagged = ", ".join(f"lag(x, {k}) {OVER} AS x{k}" for k in range(1, lags + 1))
    g = ", ".join(["sum(x * x) / count(*)"] + [f"coalesce(sum(x * x{k}), 0) / count(*)" for k in range(1, lags + 1)])
    return f"""{name} AS (SELECT commodity, state, count(*) AS n, [{g}] AS g FROM (
      SELECT *, {lagged} FROM (SELECT commodity, state, date, {x} AS x FROM {src}))
      GROUP BY commodity, state)"""


def _lev(order: str, name: str = "lev", src: str = "acov") -> str:
    """Durbin-Levinson as a recursive CTE; one row per series and order."""
    return f"""{name} AS (
      SELECT commodity, state, n, g, 0 AS k, CAST([] AS DOUBLE[]) AS phi, g[1] AS v, CAST(NULL AS DOUBLE) AS kap FROM {src}
      UNION ALL
      SELECT commodity, state, n, g, k + 1,
             list_concat(list_transform(phi, lambda p, i: p - kp * phi[k + 1 - i]), [kp]), v * (1 - kp * kp), kp
      FROM (SELECT *, (g[k + 2] - coalesce(list_sum(list_transform(phi, lambda p, i: p * g[k + 2 - i])), 0)) / nullif(v, 0) AS kp
            FROM {name} WHERE k < {order}))"""


add("autocorrelation", lambda s, d: _round(S.autocorrelation(panel(s, d)), acf=6), """
SELECT commodity, state, CAST(lag AS INT) AS lag, round(g[lag + 1] / nullif(g[1], 0), 6) AS acf
FROM (SELECT *, unnest(range(1, 41)) AS lag FROM acov)
WHERE lag <= least(40, greatest(2, CAST(floor(n * 0.4) AS INT)))""", ctes=BASE + [_acov("dense", 40)])
add("partial_autocorrelation", lambda s, d: _round(S.partial_autocorrelation(panel(s, d)), pacf=6), """
SELECT commodity, state, k AS lag, round(kap, 6) AS pacf FROM lev
WHERE k >= 1 AND k <= least(40, greatest(2, CAST(floor(n * 0.4) AS INT)))""",
    ctes=BASE + [_acov("dense", 40), _lev("40")], recursive=True)
_KPSS = """
eta AS (SELECT commodity, state, sum(s * s) AS eta FROM (
  SELECT commodity, state, sum(y - m) {over} AS s FROM (
    SELECT *, avg(y) OVER ({k}) AS m FROM dense)) GROUP BY commodity, state)""".format(over=OVER.replace("date)", "date ROWS UNBOUNDED PRECEDING)"), k=K)
_KPSS_OUT = """
SELECT commodity, state, n, kpss_lags, round(stat, 6) AS kpss_stat, round(p, 6) AS kpss_p, p >= 0.05 AS kpss_stationary,
       0.347::DOUBLE AS kpss_crit_10, 0.463::DOUBLE AS kpss_crit_5, 0.574::DOUBLE AS kpss_crit_2_5, 0.739::DOUBLE AS kpss_crit_1 FROM (
  SELECT *, CASE WHEN stat <= 0.347 THEN 0.10
                 WHEN stat <= 0.463 THEN 0.10 + (stat - 0.347) / (0.463 - 0.347) * (0.05 - 0.10)
                 WHEN stat <= 0.574 THEN 0.05 + (stat - 0.463) / (0.574 - 0.463) * (0.025 - 0.05)
                 WHEN stat <= 0.739 THEN 0.025 + (stat - 0.574) / (0.739 - 0.574) * (0.01 - 0.025)
                 ELSE 0.01 END AS p FROM (
    SELECT commodity, state, n, kpss_lags,
      eta / (n * n) / (g[1] + 2 * coalesce(list_sum(list_transform(g[2:kpss_lags + 1],
        lambda x, i: x * (1 - i / (kpss_lags + 1)))), 0)) AS stat
    FROM lagged JOIN eta USING (commodity, state)))"""
_AUTO = """
lagged AS (SELECT *, CAST(greatest(0, least(floor(1.1447 * pow(pow(s1 / s0, 2), 1.0 / 3) * pow(n, 1.0 / 3)), n - 1)) AS INT) AS kpss_lags
  FROM (SELECT *, g[1] + 2 * list_sum(g[2:few + 1]) AS s0,
               2 * list_sum(list_transform(g[2:few + 1], lambda x, i: x * i)) AS s1
        FROM (SELECT *, CAST(floor(pow(n, 2.0 / 9)) AS INT) AS few FROM acov)))"""
add("kpss_fixed_lag", lambda s, d: _round(S.kpss_test(panel(s, d), 10), kpss_stat=6, kpss_p=6),
    _KPSS_OUT, ctes=BASE + [_acov("dense", 10), _KPSS, "lagged AS (SELECT *, 10 AS kpss_lags FROM acov)"])
add("kpss_auto_lag", lambda s, d: _round(S.kpss_test(panel(s, d)), kpss_stat=6, kpss_p=6),
    _KPSS_OUT, ctes=BASE + [_acov("dense", 64), _KPSS, _AUTO])


def _eliminated(name: str, src: str, steps: str) -> str:
    """Elimination of the variables 0, 1, ... of moments ``i, j, v`` as a recursive CTE; ``k`` are gone."""
    part = "PARTITION BY commodity, state"
    return f"""{name} AS (SELECT commodity, state, size, 0 AS k, i, j, v FROM {src}
      UNION ALL SELECT commodity, state, size, k + 1, i, j, v - c * r / nullif(p, 0) FROM (
        SELECT *, max(CASE WHEN j = k THEN v END) OVER ({part}, i) AS c, max(CASE WHEN i = k THEN v END) OVER ({part}, j) AS r,
               max(CASE WHEN i = k AND j = k THEN v END) OVER ({part}) AS p
        FROM {name} WHERE k < {steps}) WHERE i > k AND j > k)"""


def adf_ctes(src: str, to: str) -> list[str]:
    """Dickey-Fuller tests of the series in ``src``, by plain products of whole vectors and recursive elimination."""
    def moments(name: str, src: str, lags: str, level: str, one: str) -> list[str]:
        """Moments of level, one, the lags between them (places 1..), and the difference, in the places given."""
        vector = f"""CASE place WHEN {level} THEN y[{lags} + 1:len(d)]
          WHEN {one} THEN list_transform(range(len(d) - {lags}), lambda i: 1::DOUBLE)
          WHEN {lags} + 2 THEN d[{lags} + 1:len(d)] ELSE d[{lags} + 1 - lag:len(d) - lag] END"""
        low = f"greatest({level}, {one})" if level == "0" else "0"
        return [
            f"""{name}_x AS (SELECT *, place - {low} AS lag FROM (SELECT *, unnest(range({lags} + 3)) AS place FROM {src}))""",
            f"""{name}_v AS MATERIALIZED (SELECT commodity, state, {lags} AS size, place, {vector} AS x FROM {name}_x)""",
            f"""{name} AS MATERIALIZED (SELECT commodity, state, a.size, a.place AS i, b.place AS j, list_inner_product(a.x, b.x) AS v
              FROM {name}_v a JOIN {name}_v b USING (commodity, state))""",
        ]

    series = ("list_reduce(list_prepend([x, x], list_transform(range(1, 151), lambda k: [k::DOUBLE, 0])), "
              "lambda a, e: [a[1] * x * x / (2 * e[1] + 1), a[2] + a[1] * x * x / (2 * e[1] + 1)])[2]")
    return [
        f"""{to}_y AS (SELECT commodity, state, list(y - m ORDER BY date) AS y, min(y) < max(y) AS varies FROM (
          SELECT *, avg(y) OVER ({K}) AS m FROM {src}) GROUP BY commodity, state)""",
        f"""{to}_l AS (SELECT commodity, state, list(v ORDER BY date) AS d FROM (
          SELECT commodity, state, date, y - lag(y) {OVER} AS v FROM {src}) WHERE v IS NOT NULL GROUP BY commodity, state)""",
        f"""{to}_d AS MATERIALIZED (SELECT *, least(ceil(12 * pow(len(y) / 100.0, 0.25)), len(y) // 2 - 2)::INT AS most
          FROM {to}_y JOIN {to}_l USING (commodity, state) WHERE varies)""",
        f"{to}_0 AS (SELECT * FROM {to}_d WHERE most >= 0)",
        *moments(f"{to}_m", f"{to}_0", "most", "0", "1"),
        _eliminated(f"{to}_e", f"{to}_m", "size + 2"),
        f"""{to}_a AS (SELECT commodity, state, k - 2 AS lag,
            (len(d) - most) * ln(greatest(v, 1e-300) / (len(d) - most)) + 2 * k AS aic
          FROM {to}_e JOIN {to}_d USING (commodity, state) WHERE k >= 2 AND i = size + 2 AND j = size + 2 AND v IS NOT NULL)""",
        f"""{to}_b AS MATERIALIZED (SELECT y, d, commodity, state, lags FROM {to}_d JOIN (
          SELECT commodity, state, first(lag ORDER BY aic, lag)::INT AS lags FROM {to}_a GROUP BY commodity, state)
          USING (commodity, state))""",
        *moments(f"{to}_n", f"{to}_b", "lags", "lags + 1", "0"),
        _eliminated(f"{to}_f", f"{to}_n", "size + 1"),
        f"""{to}_s AS (SELECT commodity, state, lags, (len(d) - lags)::INT AS obs,
            CASE WHEN len(d) - 2 * lags - 2 > 0 AND a > 0 AND t - b * b / a > 0
            THEN b / sqrt(a * (t - b * b / a) / (len(d) - 2 * lags - 2)) END AS stat
          FROM {to}_b JOIN (SELECT commodity, state, max(v) FILTER (i = size + 1 AND j = size + 1) AS a,
              max(v) FILTER (i = size + 1 AND j = size + 2) AS b, max(v) FILTER (i = size + 2 AND j = size + 2) AS t
            FROM {to}_f WHERE k = size + 1 GROUP BY commodity, state) USING (commodity, state))""",
        f"""{to}_p AS (SELECT *, CASE WHEN stat <= -1.61 THEN 2.1659 + 1.4412 * stat + 0.038269 * pow(stat, 2)
            ELSE 1.7339 + 0.93202 * stat - 0.12745 * pow(stat, 2) - 0.010368 * pow(stat, 3) END::DOUBLE AS x FROM {to}_s)""",
        f"""{to} AS MATERIALIZED (SELECT y.commodity, y.state, round(stat, 6) AS adf_stat, coalesce(lags, 0) AS adf_lags,
            coalesce(obs, 0) AS adf_obs,
          CASE WHEN stat > 2.74 THEN 1 WHEN stat < -18.83 THEN 0 WHEN x > 8 THEN 1 WHEN x < -8 THEN 0
               ELSE 0.5 + {series} * exp(-x * x / 2) / sqrt(2 * pi()) END AS p
          FROM {to}_y y LEFT JOIN {to}_p USING (commodity, state))""",
    ]


def _adf_critical(b: tuple[float, ...]) -> str:
    n = "nullif(adf_obs, 0)::DOUBLE"
    return f"{b[0]} + {b[1]} / {n} + {b[2]} / ({n} * {n}) + {b[3]} / ({n} * {n} * {n})"


add("adf_test", lambda s, d: _round(S.adf_test(panel(s, d)), adf_stat=6, adf_p=6), f"""
SELECT commodity, state, adf_stat, adf_lags, adf_obs, round(p, 6) AS adf_p, p < 0.05 AS adf_stationary,
       {", ".join(f"{_adf_critical(b)} AS adf_crit_{level[:-1]}" for level, b in S.ADF_CRITICAL.items())} FROM adf""",
    ctes=BASE + adf_ctes("dense", "adf"), recursive=True)
add("check_stationarity", lambda s, d: _round(S.check_stationarity(panel(s, d)), adf_stat=6, adf_p=6, kpss_stat=6, kpss_p=6), f"""
SELECT commodity, state, adf.adf_stat, round(adf.p, 6) AS adf_p, adf.p < 0.05 AS adf_stationary, kpss_stat, kpss_p, kpss_stationary,
       diff.p < 0.05 AS diff_stationary, coalesce(adf.p < 0.05, false) AND coalesce(kpss_stationary, false) AS is_stationary,
       CASE WHEN coalesce(adf.p < 0.05, false) <> coalesce(kpss_stationary, false) THEN 1 WHEN adf.p < 0.05 THEN 0
            WHEN diff.p < 0.05 THEN 1 ELSE 2 END AS d
FROM adf LEFT JOIN ({_KPSS_OUT}) USING (commodity, state) LEFT JOIN diff USING (commodity, state)""",
    ctes=BASE + [f"diffs AS (SELECT * FROM (SELECT commodity, state, date, y - lag(y) {OVER} AS y FROM dense) WHERE y IS NOT NULL)",
                 _acov("dense", 64), _KPSS, _AUTO, *adf_ctes("dense", "adf"), *adf_ctes("diffs", "diff")], recursive=True)
_DECOMP = """
tr AS (SELECT *, (row_number() {over} - 1) % 30 AS slot,
  CASE WHEN count(y) OVER ({k} ORDER BY date ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING) = 31 THEN
    (sum(y) OVER ({k} ORDER BY date ROWS BETWEEN 14 PRECEDING AND 14 FOLLOWING)
     + (lag(y, 15) {over} + lead(y, 15) {over}) / 2) / 30 END AS trend FROM dense),
slots AS (SELECT commodity, state, slot, avg(y - trend) AS sm FROM tr GROUP BY commodity, state, slot),
cent AS (SELECT commodity, state, avg(sm) AS c FROM slots GROUP BY commodity, state),
dec AS (SELECT commodity, state, date, y, trend, sm - c AS seasonal, y - trend - (sm - c) AS resid
  FROM tr JOIN slots USING (commodity, state, slot) JOIN cent USING (commodity, state))""".format(over=OVER, k=K)
add("decompose", lambda s, d: S.decompose(panel(s, d)).groupBy(*SERIES_KEY, F.year("date").alias("year")).agg(
    F.count("trend").alias("trends"), F.round(F.sum("trend"), 4).alias("trend"),
    F.round(F.stddev_pop("seasonal"), 4).alias("seasonal"), F.round(F.stddev_pop("resid"), 4).alias("resid")), """
SELECT commodity, state, CAST(year(date) AS INT) AS year, count(trend) AS trends, round(sum(trend), 4) AS trend,
       round(stddev_pop(seasonal), 4) AS seasonal, round(stddev_pop(resid), 4) AS resid
FROM dec GROUP BY ALL""", ctes=BASE + [_DECOMP])
add("seasonal_strength", lambda s, d: _round(S.seasonal_strength(panel(s, d)), fs=6), """
SELECT commodity, state, round(greatest(0, 1 - r), 6) AS fs, CASE WHEN 1 - r > 0.4 THEN 12 ELSE 1 END AS m
FROM (SELECT commodity, state, var_pop(resid) / nullif(var_pop(seasonal + resid), 0) AS r FROM dec
      WHERE resid IS NOT NULL GROUP BY commodity, state)""", ctes=BASE + [_DECOMP])


def _lb(k):
    terms = " + ".join(f"pow(g[{i + 1}] / g[1], 2) / (n - {i})" for i in range(1, k + 1))
    return f"n * (n + 2.0) * ({terms})"


def _tail(q, dof):
    terms, term = ["1.0"], "1.0"
    for i in range(1, dof // 2):
        term = f"({term} * ({q}) / 2 / {i})"
        terms.append(term)
    return f"exp(-({q}) / 2) * ({' + '.join(terms)})"


add("residual_diagnostics", lambda s, d: _round(
    S.residual_diagnostics(W.difference(panel(s, d)).withColumnRenamed("y", "resid")),
    residual_mean=6, residual_std=4, lb_stat_10=4, lb_stat_20=4, lb_p_10=6, lb_p_20=6), f"""
SELECT commodity, state, n, round(m, 6) AS residual_mean, round(sd, 4) AS residual_std,
       round(q10, 4) AS lb_stat_10, round(q20, 4) AS lb_stat_20,
       round({_tail('q10', 10)}, 6) AS lb_p_10, round({_tail('q20', 20)}, 6) AS lb_p_20,
       {_tail('q10', 10)} > 0.05 AND {_tail('q20', 20)} > 0.05 AS white_noise
FROM (SELECT commodity, state, acov.n, m, sd, {_lb(10)} AS q10, {_lb(20)} AS q20
      FROM acov JOIN (SELECT commodity, state, avg(y) AS m, stddev_samp(y) AS sd FROM diffs GROUP BY 1, 2)
      USING (commodity, state))""",
    ctes=BASE + [f"diffs AS (SELECT * FROM (SELECT commodity, state, date, y - lag(y) {OVER} AS y FROM dense) WHERE y IS NOT NULL)",
                 _acov("diffs", 20)])

# --- ARIMA --------------------------------------------------------------------------
_E = " - ".join(["w.y"] + [f"l.phi[{i}] * w.l{i}" for i in range(1, 11)])
def arima_ctes(src: str = "dense") -> list[str]:
    """Fit of ARIMA(1,1,1) per (commodity, state) on the rows of ``src``."""
    return [
        f"w AS (SELECT * FROM (SELECT commodity, state, date, y AS level, y - lag(y) {OVER} AS y FROM {src}) WHERE y IS NOT NULL)",
        _acov("w", 10, centred=False), _lev("10"),
        f"wl AS (SELECT *, {', '.join(f'lag(y, {i}) {OVER} AS l{i}' for i in range(1, 11))} FROM w)",
        f"er AS (SELECT w.commodity, w.state, w.date, w.y, {_E} AS e FROM wl w JOIN lev l ON l.k = 10 AND w.commodity = l.commodity AND w.state = l.state)",
        f"""reg AS (SELECT commodity, state, sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab, sum(a * y) AS ay,
             sum(b * y) AS yb, sum(y * y) AS tt, count(*) AS m
           FROM (SELECT commodity, state, y, lag(y) {OVER} AS a, lag(e) {OVER} AS b FROM er) WHERE b IS NOT NULL GROUP BY 1, 2)""",
        """par AS (SELECT *, greatest(0, (tt - 2 * phi * ay - 2 * theta * yb + phi * phi * aa + 2 * phi * theta * ab + theta * theta * bb) / m) AS sigma2
           FROM (SELECT *, greatest(-0.99, least(0.99, CASE WHEN flat THEN ay / nullif(aa, 0) ELSE (ay * bb - yb * ab) / det END)) AS phi,
                        greatest(-0.99, least(0.99, CASE WHEN flat THEN 0 ELSE (yb * aa - ay * ab) / det END)) AS theta
                 FROM (SELECT *, aa * bb - ab * ab AS det, aa * bb - ab * ab <= aa * bb * 1e-10 AS flat FROM reg)))""",
    ]

# where each series ends, for forecasting
FIN = f"""fin AS (SELECT commodity, state, any_value(phi) AS phi, any_value(theta) AS theta, any_value(sigma2) AS sigma2,
          max(date) AS last, arg_max(level, date) AS yn, arg_max(y, date) AS wn,
          sum((y - phi * prev) * pow(-theta, back)) AS en
        FROM (SELECT *, lag(y) {OVER} AS prev, row_number() OVER ({K} ORDER BY date DESC) - 1 AS back FROM w)
        JOIN par USING (commodity, state) GROUP BY commodity, state)"""


def arima_path(steps: int) -> str:
    """Rows (commodity, state, h, date, f) of the point forecast."""
    return f"""fc AS (SELECT commodity, state, h, last + CAST(h AS INT) AS date,
      yn + (phi * wn + theta * en) * (1 - pow(phi, h)) / (1 - phi) AS f
      FROM fin, (SELECT unnest(range(1, {steps + 1})) AS h))"""


ARIMA_CTES = BASE + arima_ctes()


def _parameters(fitted):
    return fitted.select(
        *SERIES_KEY, "model", "n", F.round(F.col("phi")[0], 4).alias("phi"), F.round("theta", 4).alias("theta"),
        F.round("sigma2", 2).alias("sigma2"), F.round("aic", 3).alias("aic"), F.round("bic", 3).alias("bic"))


_PARAMETERS = """
SELECT commodity, state, 'ARIMA(1,1,1)' AS model, CAST(n AS INT) AS n, round(phi, 4) AS phi, round(theta, 4) AS theta,
       round(sigma2, 2) AS sigma2, round(n * (ln(2 * pi() * sigma2) + 1) + 6, 3) AS aic,
       round(n * (ln(2 * pi() * sigma2) + 1) + 3 * ln(n), 3) AS bic
FROM par JOIN acov USING (commodity, state)"""
add("arima_fit", lambda s, d: _parameters(M.fit(panel(s, d))), _PARAMETERS, ctes=ARIMA_CTES, recursive=True)


def _registered_twice(s, d):
    """Parameters stored for the history up to a date, then asked for with all of it."""
    root, days = new_path(s, "models"), cut_lineage(panel(s, d))
    ensure_arima(days.where("date < DATE '1997-06-01'"), root).count()
    return _parameters(ensure_arima(days, root))


add("registry_arima", _registered_twice, _PARAMETERS, ctes=ARIMA_CTES, recursive=True)
add("arima_forecast", lambda s, d: _round(
    M.forecast(M.fit(panel(s, d)), 30, None), forecast=2, lower_80=2, upper_80=2, lower_95=2, upper_95=2), f"""
SELECT commodity, state, 'ARIMA(1,1,1)' AS model, CAST(h AS INT) AS step, last + CAST(h AS INT) AS date, round(f, 2) AS forecast,
       round(f - 1.2815515655446004 * sd, 2) AS lower_80, round(f + 1.2815515655446004 * sd, 2) AS upper_80,
       round(f - 1.959963984540054 * sd, 2) AS lower_95, round(f + 1.959963984540054 * sd, 2) AS upper_95
FROM (SELECT *, yn + (phi * wn + theta * en) * (1 - pow(phi, h)) / (1 - phi) AS f,
        sqrt(sigma2 * sum(pow(1 + (phi + theta) * (1 - pow(phi, h - 1)) / (1 - phi), 2)) OVER (PARTITION BY commodity, state ORDER BY h)) AS sd
      FROM fin, (SELECT unnest(range(1, 31)) AS h))""",
    ctes=ARIMA_CTES + [FIN], recursive=True)
WEEKLY_DAYS = WEEK + ["""wcal AS (SELECT commodity, state, CAST(unnest(generate_series(CAST(min(date) AS TIMESTAMP),
    CAST(max(date) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM weekly GROUP BY commodity, state)""", f"""
wdense AS (SELECT commodity, state, c.date, last_value(y IGNORE NULLS) {OVER[:-1]}
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y
  FROM wcal c LEFT JOIN weekly USING (commodity, state, date))"""]
# weekly medians end in half hundredths, so two digits would meet ties
add("arima_forecast_weekly", lambda s, d: _round(M.forecast(M.fit(panel(s, d, "W")), 30, None), forecast=3)
    .select(*SERIES_KEY, "step", "date", "forecast"), """
SELECT commodity, state, CAST(h AS INT) AS step, date, round(f, 3) AS forecast FROM fc""",
    ctes=WEEKLY_DAYS + arima_ctes("wdense") + [FIN, arima_path(30)], recursive=True)
add("arima_forecast_short", lambda s, d: M.forecast(M.fit(W.last_rows(panel(s, d), 4)), 7, 2)
    .select(*SERIES_KEY, "model", "step", "date", "forecast", "upper_95"), """
SELECT commodity, state, 'insufficient_history' AS model, CAST(h AS INT) AS step, last + CAST(h AS INT) AS date,
       round(y, 2) AS forecast, CAST(NULL AS DOUBLE) AS upper_95
FROM (SELECT commodity, state, max(date) AS last, arg_max(y, date) AS y FROM dense GROUP BY commodity, state),
     (SELECT unnest(range(1, 8)) AS h)""", ctes=BASE)
_ORD = " UNION ALL ".join(
    [f"SELECT commodity, state, 'ARIMA({p},1,0)' AS model, n * (ln(2 * pi() * v) + 1) + {2 * (p + 1)} AS aic FROM lev WHERE k = {p}"
     for p in range(6)]
    + ["SELECT commodity, state, 'ARIMA(1,1,1)', n * (ln(2 * pi() * sigma2) + 1) + 6 FROM par JOIN acov USING (commodity, state)"])
add("arima_select_order", lambda s, d: M.select_order(panel(s, d)).select(
    *SERIES_KEY, "model", F.round("aic", 3).alias("aic")), """
SELECT commodity, state, model, round(aic, 3) AS aic FROM cand
QUALIFY row_number() OVER (PARTITION BY commodity, state ORDER BY aic, model) = 1""",
    ctes=ARIMA_CTES + [f"cand AS ({_ORD})"], recursive=True)
add("arima_residuals", lambda s, d: S.residual_diagnostics(
    M.residuals(panel(s, d), M.fit(panel(s, d)))))
add("arima_auto_order", lambda s, d: M.auto_select(cut_lineage(panel(s, d))).select(*SERIES_KEY, "model", "d", "aic", "bic"))
