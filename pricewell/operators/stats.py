"""Time-series statistics of a whole panel in one job.

Autocovariances come from lagged columns and one grouped sum; everything that follows
(partial autocorrelation, KPSS, Ljung-Box) works on the resulting short array per series.
The Dickey-Fuller regressions of all lags are one elimination of one moment matrix per series.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewell.operators.series import by_date, difference
from pricewell.plans.session import cut_lineage
from pricewell.schema import SERIES_KEY

# Fixed values (published): finite-sample critical values of the Dickey-Fuller test with
# a constant, as b0 + b1/T + b2/T^2 + b3/T^3 (MacKinnon 2010).
ADF_CRITICAL = {
    "1%": (-3.43035, -6.5393, -16.786, -79.433),
    "5%": (-2.86154, -2.8903, -4.234, -40.040),
    "10%": (-2.56677, -1.5384, -2.809, 0.0),
}
# Fixed values (published): p-value polynomials of the same test (MacKinnon 1994), the
# statistic where they meet, and the range outside which p is 1 or 0.
ADF_P_LEFT = (2.1659, 1.4412, 0.038269)
ADF_P_RIGHT = (1.7339, 0.93202, -0.12745, -0.010368)
ADF_P_MEET, ADF_P_MIN, ADF_P_MAX = -1.61, -18.83, 2.74
# Fixed values (published): level-stationarity critical values and their p-values
# (Kwiatkowski, Phillips, Schmidt and Shin 1992).
KPSS_CRITICAL = {0.10: 0.347, 0.05: 0.463, 0.025: 0.574, 0.01: 0.739}
LJUNG_BOX_LAGS = (10, 20)


# --- autocorrelation ---------------------------------------------------------------

def autocovariances(
    panel: DataFrame, max_lag: int, key: list[str] = SERIES_KEY, column: str = "y"
) -> DataFrame:
    """``n``, ``mean`` and ``gamma``: the sums of products at lags 0..max_lag, over n."""
    w = by_date(key)
    x = panel.where(F.col(column).isNotNull()).select(
        *key, "date", F.col(column).alias("_y"),
        F.avg(column).over(Window.partitionBy(*key)).alias("_mean"),
    )
    x = x.withColumn("_x", F.col("_y") - F.col("_mean"))
    lagged = x.select(
        *key, "_mean", "_x", *[F.lag("_x", k).over(w).alias(f"_x{k}") for k in range(1, max_lag + 1)]
    )
    sums = lagged.groupBy(*key).agg(
        F.count("*").alias("n"),
        F.first("_mean").alias("mean"),
        F.sum(F.col("_x") * F.col("_x")).alias("_g0"),
        *[F.sum(F.col("_x") * F.col(f"_x{k}")).alias(f"_g{k}") for k in range(1, max_lag + 1)],
    )
    gamma = F.array(*[F.coalesce(F.col(f"_g{k}"), F.lit(0.0)) / F.col("n") for k in range(max_lag + 1)])
    return sums.select(*key, "n", "mean", gamma.alias("gamma"))


def lag_count(n: Column, most: int = 40) -> Column:
    """How many lags to show: 40 % of the length, between 2 and ``most``."""
    return F.least(F.lit(most), F.greatest(F.lit(2), F.floor(n * F.lit(0.4)).cast("int")))


def autocorrelation(panel: DataFrame, max_lag: int = 40, key: list[str] = SERIES_KEY) -> DataFrame:
    """Rows ``(key, lag, acf)``; constant series give NULL."""
    cov = autocovariances(panel, max_lag, key)
    rho = F.transform(
        F.slice("gamma", 2, lag_count(F.col("n"), max_lag)),
        lambda g: F.try_divide(g, F.col("gamma")[0]),
    )
    return cov.select(*key, F.posexplode(rho).alias("_i", "acf")).select(
        *key, (F.col("_i") + 1).alias("lag"), "acf"
    )


def levinson(gamma: Column, order: Column | int) -> Column:
    """Durbin-Levinson recursion as a fold over lags 1..order.

    Gives a struct of ``phi`` (coefficients of the last order), ``pacf`` and ``vars``
    (innovation variance after each order, order 0 first).
    """
    empty = F.array().cast("array<double>")
    start = F.struct(
        empty.alias("phi"), empty.alias("pacf"), F.array(gamma[0]).cast("array<double>").alias("vars")
    )

    def step(acc: Column, k: Column) -> Column:
        phi, last = acc["phi"], F.element_at(acc["vars"], -1)
        explained = F.aggregate(
            F.zip_with(phi, F.reverse(F.slice(gamma, 2, k - 1)), lambda a, b: a * b),
            F.lit(0.0), lambda a, x: a + x,
        )
        kappa = F.try_divide(F.element_at(gamma, k + 1) - explained, last)
        newer = F.concat(
            F.zip_with(phi, F.reverse(phi), lambda a, b: a - kappa * b), F.array(kappa)
        )
        return F.struct(
            newer.alias("phi"),
            F.concat(acc["pacf"], F.array(kappa)).alias("pacf"),
            F.concat(acc["vars"], F.array(last * (1 - kappa * kappa))).alias("vars"),
        )

    last_lag = F.lit(order) if isinstance(order, int) else order.cast("int")
    return F.aggregate(F.sequence(F.lit(1), last_lag), start, step)


def partial_autocorrelation(panel: DataFrame, max_lag: int = 40, key: list[str] = SERIES_KEY) -> DataFrame:
    """Rows ``(key, lag, pacf)`` from the Yule-Walker equations."""
    cov = autocovariances(panel, max_lag, key)
    pacf = F.slice(levinson(F.col("gamma"), max_lag)["pacf"], 1, lag_count(F.col("n"), max_lag))
    return cov.select(*key, F.posexplode(pacf).alias("_i", "pacf")).select(
        *key, (F.col("_i") + 1).alias("lag"), "pacf"
    )


# --- stationarity ------------------------------------------------------------------

def adf_p_value(stat: float) -> float:
    """The p-value of one statistic; ``adf_p`` is the same for a column."""
    if stat > ADF_P_MAX:
        return 1.0
    if stat < ADF_P_MIN:
        return 0.0
    coef = ADF_P_LEFT if stat <= ADF_P_MEET else ADF_P_RIGHT
    return 0.5 * math.erfc(-sum(c * stat**i for i, c in enumerate(coef)) / math.sqrt(2.0))


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def normal_cdf(x: Column, terms: int = 150) -> Column:
    """The normal distribution by its power series, which has converged where |x| is at most 8."""
    def term(acc: Column, k: Column) -> Column:
        t = acc["t"] * x * x / (2 * k + 1)
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.struct(x.alias("t"), x.alias("s")), term, lambda acc: acc["s"])
    inside = 0.5 + series * F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    return F.when(x > 8, 1.0).when(x < -8, 0.0).otherwise(inside)


def adf_p(stat: Column, z: Column) -> Column:
    """The p-value of a statistic whose normal equivalent is ``z``."""
    return F.when(stat > ADF_P_MAX, 1.0).when(stat < ADF_P_MIN, 0.0).when(stat.isNotNull(), normal_cdf(z))


def adf_z(stat: Column) -> Column:
    def polynomial(coef: tuple[float, ...]) -> Column:
        return sum((c * F.pow(stat, F.lit(i)) for i, c in enumerate(coef[1:], 1)), F.lit(coef[0]))

    return F.when(stat <= ADF_P_MEET, polynomial(ADF_P_LEFT)).otherwise(polynomial(ADF_P_RIGHT))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, z: x * z), F.lit(0.0), lambda s, x: s + x)


def _moments(y: Column, d: Column, n: Column, skip: Column) -> Column:
    """Sums of products over the rows from ``skip`` of: one, level, difference, and its lags 1..``skip``.

    ``y`` has ``n`` + 1 levels and ``d`` their ``n`` differences.  Only products with the unlagged difference are summed;
    those of two lags follow from the entry before on the diagonal, which differs by a row at either end.
    """
    rows, lags = n - skip, F.sequence(F.lit(0), skip)
    level, now = F.slice(y, skip + 1, rows), F.slice(d, skip + 1, rows)
    lagged = F.transform(lags, lambda j: F.slice(d, skip + 1 - j, rows))
    ones = F.transform(lags, lambda j: F.get(y, n - j) - F.get(y, skip - j))  # differences add up to levels
    levels = F.transform(lagged, lambda v: _dot(level, v))

    def next_row(acc: Column, i: Column) -> Column:
        above = F.element_at(acc, -1)
        row = F.transform(lags, lambda j: F.when(j < i, F.get(F.get(acc, j), i)).otherwise(
            F.get(above, j - 1) + F.get(d, skip - i) * F.get(d, skip - j) - F.get(d, n - i) * F.get(d, n - j)))
        return F.concat(acc, F.array(row))

    products = F.aggregate(
        F.slice(lags, F.lit(2), skip), F.array(F.transform(lagged, lambda v: _dot(now, v))), next_row)
    total = F.aggregate(level, F.lit(0.0), lambda s, x: s + x)
    return _named(F.struct(ones.alias("o"), levels.alias("l"), products.alias("p"), total.alias("t")), lambda m: F.concat(
        F.array(F.concat(F.array(rows.cast("double"), m["t"]), m["o"]), F.concat(F.array(m["t"], _dot(level, level)), m["l"])),
        F.transform(lags, lambda i: F.concat(F.array(F.get(m["o"], i), F.get(m["l"], i)), F.get(m["p"], i))),
    ))


def _arranged(moments: Column, order: Column) -> Column:
    return _named(F.struct(moments.alias("m"), order.alias("o")), lambda v: F.transform(
        v["o"], lambda i: F.transform(v["o"], lambda j: F.get(F.get(v["m"], i), j))))


def eliminated(m: Column) -> Column:
    """The moment matrix of what its first variable does not explain of the others; all NULL if that is constant."""
    first = m[0]
    rest = F.slice(first, F.lit(2), F.size(first) - 1)
    return F.transform(
        F.slice(m, F.lit(2), F.size(m) - 1),
        lambda row: F.zip_with(F.slice(row, F.lit(2), F.size(row) - 1), rest,
                               lambda x, f: x - F.try_divide(row[0] * f, first[0])),
    )


def adf_test(panel: DataFrame, key: list[str] = SERIES_KEY) -> DataFrame:
    """Augmented Dickey-Fuller test with a constant, one row per series.

    The number of lags is chosen by AIC.  All candidates are fitted on the same rows: eliminating level, constant and
    one lag after the other from one moment matrix leaves the residual sum of squares of each.  Series that are constant or
    too short have no statistic.
    """
    kept = panel.where(F.col("y").isNotNull()).groupBy(*key).agg(
        F.sort_array(F.collect_list(F.struct("date", "y"))).alias("_rows"), F.avg("y").alias("_m"),
        F.min("y").alias("_low"), F.max("y").alias("_high"), F.count("*").alias("_n"))  # as long as the calendar
    size = F.col("_n").cast("int")
    most = F.least(F.ceil(12.0 * F.pow(size / 100.0, F.lit(0.25))).cast("int"), F.floor(size / 2).cast("int") - 2)
    rows = kept.select(
        *key, F.transform("_rows", lambda r: r["y"] - F.col("_m")).alias("_y"),
        F.when((most >= 0) & (F.col("_low") < F.col("_high")), most).alias("_most"), (size - 1).alias("_d_n"))
    y, n, most = F.col("_y"), F.col("_d_n"), F.col("_most")
    differences = F.transform(F.slice(y, F.lit(2), n), lambda v, i: v - F.get(y, i))
    rows = rows.withColumn("_d", differences)
    d = F.col("_d")

    def lag_places(lags: Column) -> Column:
        """Where the lags 1..``lags`` stand in the moment matrix."""
        return F.slice(F.sequence(F.lit(2), lags + 2), F.lit(2), lags)

    nested = F.concat(F.array(F.lit(1), F.lit(0)), lag_places(most), F.array(F.lit(2)))
    start = F.struct(_arranged(_moments(y, d, n, most), nested).alias("m"), F.array().cast("array<double>").alias("rss"))

    def one_more(acc: Column, _: Column) -> Column:
        return _named(eliminated(acc["m"]), lambda m: F.struct(
            m.alias("m"), F.concat(acc["rss"], F.array(F.element_at(F.element_at(m, -1), -1))).alias("rss")))

    rss = F.aggregate(F.sequence(F.lit(1), most + 2), start, one_more, lambda acc: acc["rss"])
    used = (n - most).cast("double")
    aics = F.transform(F.slice(rss, F.lit(2), most + 1), lambda r, lag: F.struct(
        (used * F.ln(F.greatest(r, F.lit(1e-300)) / used) + 2 * (lag + 2)).alias("aic"), lag.alias("lag"), r.alias("rss")))
    best = F.array_min(F.filter(aics, lambda a: a["rss"].isNotNull()))["lag"]
    rows = rows.withColumn("_lags", F.when(most.isNotNull(), best))
    lags = F.col("_lags")
    last = F.aggregate(
        F.sequence(F.lit(1), lags + 1),
        _arranged(_moments(y, d, n, lags), F.concat(F.array(F.lit(0)), lag_places(lags), F.array(F.lit(1), F.lit(2)))),
        lambda m, _: eliminated(m))
    rows = rows.withColumn("_left", F.when(lags.isNotNull(), last))
    a, b, t = F.col("_left")[0][0], F.col("_left")[0][1], F.col("_left")[1][1]
    dof = n - lags - (lags + 2)
    scale = F.when(dof > 0, (t - F.try_divide(b * b, a)) / dof)
    stat = F.when(scale * a > 0, b / F.sqrt(scale * a))
    obs = F.coalesce(n - lags, F.lit(0))
    tests = rows.select(*key, stat.alias("adf_stat"), F.coalesce(lags, F.lit(0)).alias("adf_lags"), obs.alias("adf_obs"))
    tests = tests.withColumn("_z", adf_z(F.col("adf_stat")))
    tests = tests.withColumn("adf_p", adf_p(F.col("adf_stat"), F.col("_z"))).drop("_z")
    t = F.col("adf_obs").cast("double")
    critical = {
        f"adf_crit_{level[:-1]}": b[0] + F.try_divide(F.lit(b[1]), t)
        + F.try_divide(F.lit(b[2]), t * t) + F.try_divide(F.lit(b[3]), t * t * t)
        for level, b in ADF_CRITICAL.items()
    }
    return tests.withColumns(critical).withColumn("adf_stationary", F.col("adf_p") < 0.05)


def _kpss_auto_lag(n: Column, gamma: Column) -> Column:
    """Data-driven lag (Hobijn, Franses and Ooms 1998) from the autocovariances."""
    few = F.floor(F.pow(n, F.lit(2.0 / 9.0))).cast("int")
    head = F.slice(gamma, 2, few)
    # products are averaged over n/2, hence the factor 2
    s0 = gamma[0] + 2 * F.aggregate(head, F.lit(0.0), lambda a, g: a + g)
    s1 = 2 * F.aggregate(
        F.transform(head, lambda g, i: g * (i + 1)), F.lit(0.0), lambda a, g: a + g
    )
    ratio = F.try_divide(s1, s0)
    rate = 1.1447 * F.pow(ratio * ratio, F.lit(1.0 / 3.0))
    lag = F.floor(rate * F.pow(n, F.lit(1.0 / 3.0))).cast("int")
    return F.greatest(F.lit(0), F.least(lag, (n - 1).cast("int")))


def kpss_test(
    panel: DataFrame, lags: int | None = None, key: list[str] = SERIES_KEY, most: int = 64
) -> DataFrame:
    """KPSS test for level stationarity; ``lags=None`` picks the lag from the data.

    ``most`` is how many autocovariances are prepared.  A series whose own lag is larger
    than that is not cut short: its statistic comes from a second pass with more lags.
    """
    prepared = most if lags is None else lags
    w = by_date(key).rowsBetween(Window.unboundedPreceding, 0)
    x = panel.where(F.col("y").isNotNull()).withColumn(
        "_e", F.col("y") - F.avg("y").over(Window.partitionBy(*key))
    )
    partial = (
        x.withColumn("_s", F.sum("_e").over(w))
        .groupBy(*key).agg(F.sum(F.col("_s") * F.col("_s")).alias("_eta"))
    )
    cov = autocovariances(panel, prepared, key)
    n = F.col("n").cast("double")
    chosen = F.lit(lags) if lags is not None else _kpss_auto_lag(n, F.col("gamma"))
    cov = cov.withColumn("kpss_lags", chosen)
    if lags is None:
        cov = cut_lineage(cov)  # one row per series
        # lags grow with the cube root of the length, so a second pass is rare
        longest = cov.agg(F.max("kpss_lags")).first()[0] or 0
        if longest > prepared:
            return kpss_test(panel, None, key, most=int(longest))
    weights = F.transform(
        F.slice("gamma", 2, F.col("kpss_lags")),
        lambda g, i: g * (1 - (i + 1) / (F.col("kpss_lags") + 1)),
    )
    long_run = F.col("gamma")[0] + 2 * F.aggregate(weights, F.lit(0.0), lambda a, g: a + g)
    stat = F.try_divide(F.try_divide(F.col("_eta"), n * n), long_run)
    out = cov.join(partial, key).select(*key, "n", "kpss_lags", stat.alias("kpss_stat"))
    critical = {f"kpss_crit_{100 * p:g}".replace(".", "_"): F.lit(crit) for p, crit in KPSS_CRITICAL.items()}
    return out.withColumn("kpss_p", kpss_p_value(F.col("kpss_stat"))).withColumns(
        {"kpss_stationary": F.col("kpss_p") >= 0.05} | critical
    )


def kpss_p_value(stat: Column) -> Column:
    """Linear between the tabulated points, held at the ends."""
    points = sorted((crit, p) for p, crit in KPSS_CRITICAL.items())
    expr = F.when(stat <= points[0][0], F.lit(points[0][1]))
    for (c0, p0), (c1, p1) in zip(points, points[1:]):
        expr = expr.when(stat <= c1, p0 + (stat - c0) / (c1 - c0) * (p1 - p0))
    return expr.when(stat > points[-1][0], F.lit(points[-1][1]))


def check_stationarity(panel: DataFrame, key: list[str] = SERIES_KEY) -> DataFrame:
    """Both tests and the order of differencing they suggest.

    Both stationary: 0.  Both not: test the first difference, 1 if that is stationary,
    else 2.  They disagree: 1.
    """
    level = adf_test(panel, key).select(*key, "adf_stat", "adf_p", "adf_stationary")
    kpss = kpss_test(panel, key=key).select(*key, "kpss_stat", "kpss_p", "kpss_stationary")
    diff = adf_test(difference(panel, 1, key), key).select(
        *key, F.col("adf_stationary").alias("diff_stationary")
    )
    adf = F.coalesce("adf_stationary", F.lit(False))
    lvl = F.coalesce("kpss_stationary", F.lit(False))
    d = (
        F.when(adf & lvl, 0)
        .when(~adf & ~lvl, F.when(F.coalesce("diff_stationary", F.lit(False)), 1).otherwise(2))
        .otherwise(1)
    )
    return level.join(kpss, key, "left").join(diff, key, "left").withColumn(
        "is_stationary", adf & lvl
    ).withColumn("d", d)


# --- seasonality -------------------------------------------------------------------

def decompose(panel: DataFrame, period: int = 30, key: list[str] = SERIES_KEY) -> DataFrame:
    """Classical additive decomposition into ``trend``, ``seasonal`` and ``resid``.

    The trend is the centred moving average over one period (half weights at both ends
    for an even period), the seasonal part the mean detrended value per position in the
    period, centred to zero.  Trend and residual are NULL within half a period of the ends.
    """
    w = by_date(key)
    half = period // 2
    inner = w.rowsBetween(-half, half)
    if period % 2:
        trend = F.when(F.count("y").over(inner) == period, F.avg("y").over(inner))
    else:
        ends = F.lag("y", half).over(w) + F.lead("y", half).over(w)
        core = F.sum("y").over(w.rowsBetween(-half + 1, half - 1))
        full = F.count("y").over(inner) == period + 1
        trend = F.when(full, (core + ends / 2) / period)
    rows = panel.select(
        *key, "date", "y", trend.alias("trend"),
        ((F.row_number().over(w) - 1) % period).alias("_slot"),
    )
    slot_mean = F.avg(F.col("y") - F.col("trend")).over(Window.partitionBy(*key, "_slot"))
    rows = rows.withColumn("_slot_mean", slot_mean)
    first_of_slot = F.row_number().over(Window.partitionBy(*key, "_slot").orderBy("date")) == 1
    rows = rows.withColumn("_one", F.when(first_of_slot, F.col("_slot_mean")))
    centre = F.avg("_one").over(Window.partitionBy(*key))
    return (
        rows.withColumn("seasonal", F.col("_slot_mean") - centre)
        .withColumn("resid", F.col("y") - F.col("trend") - F.col("seasonal"))
        .select(*key, "date", "y", "trend", "seasonal", "resid")
    )


def seasonal_strength(panel: DataFrame, period: int = 30, key: list[str] = SERIES_KEY) -> DataFrame:
    """``fs``: one less the share of residual in detrended variance, not below 0; and the
    seasonal period ``m`` it suggests."""
    parts = decompose(panel, period, key).where(F.col("resid").isNotNull())
    ratio = F.try_divide(F.var_pop("resid"), F.var_pop(F.col("seasonal") + F.col("resid")))
    fs = F.greatest(F.lit(0.0), 1 - ratio)
    return parts.groupBy(*key).agg(F.when(ratio.isNotNull(), fs).alias("fs")).withColumn(
        "m", seasonal_period(F.col("fs"))
    )


def seasonal_period(fs: Column, threshold: float = 0.4, period: int = 12) -> Column:
    return F.when(fs > threshold, period).otherwise(1)


# --- residuals ---------------------------------------------------------------------

def chi_square_tail(q: Column, dof: int) -> Column:
    """Upper tail of the chi-square distribution for an even ``dof`` (closed form)."""
    if dof % 2:
        raise ValueError("dof must be even")
    half = q / 2
    term, total = F.lit(1.0), F.lit(1.0)
    for i in range(1, dof // 2):
        term = term * half / i
        total = total + term
    return F.exp(-half) * total


def residual_diagnostics(
    residuals: DataFrame, column: str = "resid", key: list[str] = SERIES_KEY
) -> DataFrame:
    """Mean, deviation and Ljung-Box tests at lags 10 and 20; ``white_noise`` if all p > 0.05."""
    top = max(LJUNG_BOX_LAGS)
    cov = autocovariances(residuals, top, key, column)
    n = F.col("n").cast("double")
    out = cov.select(
        *key, "n", F.col("mean").alias("residual_mean"),
        F.sqrt(F.try_divide(F.col("gamma")[0] * n, n - 1)).alias("residual_std"),
        *[
            F.aggregate(
                F.transform(
                    F.slice("gamma", 2, k),
                    lambda g, i: F.try_divide(
                        F.pow(F.try_divide(g, F.col("gamma")[0]), F.lit(2.0)), n - i - 1
                    ),
                ),
                F.lit(0.0), lambda a, x: a + x,
            ).alias(f"_q{k}")
            for k in LJUNG_BOX_LAGS
        ],
    )
    stats = {f"lb_stat_{k}": n * (n + 2) * F.col(f"_q{k}") for k in LJUNG_BOX_LAGS}
    out = out.withColumns(stats)
    out = out.withColumns(
        {f"lb_p_{k}": chi_square_tail(F.col(f"lb_stat_{k}"), k) for k in LJUNG_BOX_LAGS}
    )
    white = F.lit(True)
    for k in LJUNG_BOX_LAGS:
        white = white & (F.col(f"lb_p_{k}") > 0.05)
    return out.withColumn("white_noise", white).drop(*[f"_q{k}" for k in LJUNG_BOX_LAGS])
