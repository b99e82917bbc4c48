"""ARIMA(1,d,1) and AR(p,d) for every series of a panel, without a constant.

Parameters follow Hannan and Rissanen: a long autoregression gives residuals, then the
series is regressed on its last value and last residual.  Each series is one array as
long as its calendar; the sums are folds over that array, the small systems are closed
forms.  The parameter table holds all that forecasting needs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewell.operators.stats import check_stationarity, levinson
from pricewell.plans.session import cut_lineage
from pricewell.plans.sizing import stacked
from pricewell.schema import SERIES_KEY

LONG_ORDER = 10
MAX_AR = 5
SHORT = 3  # differences that are too few to fit
BOUND = 0.99  # keeps both parameters inside the stable region
# Normal quantiles of two-sided 80 % and 95 % intervals.
Z80, Z95 = 1.2815515655446004, 1.959963984540054


# --- array helpers -----------------------------------------------------------------

def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def _dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def _diff(a: Column) -> Column:
    n = F.size(a)
    return F.zip_with(F.slice(a, 2, n), F.slice(a, 1, F.greatest(n - 1, F.lit(0))), lambda x, y: x - y)


def _running(a: Column) -> Column:
    empty = F.array().cast("array<double>")
    return F.aggregate(
        a, empty,
        lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)) + x)),
    )


def _shifted(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x + by)


def series_arrays(panel: DataFrame, key: list[str] = SERIES_KEY) -> DataFrame:
    """Each series as one array of daily values: as long as the calendar, never as the raw rows.

    A value holds until the next one, so weekly and monthly series have daily forecasts that
    start the day after their last value.
    """
    rows = panel.where(F.col("y").isNotNull()).groupBy(*key).agg(
        F.sort_array(F.collect_list(F.struct("date", "y"))).alias("_rows")
    )
    def held(row: Column, i: Column) -> Column:
        until = F.coalesce(F.get(F.col("_rows"), i + 1)["date"], F.date_add(row["date"], 1))
        return F.array_repeat(row["y"], F.datediff(until, row["date"]))

    return rows.select(
        *key, F.element_at("_rows", -1)["date"].alias("last_date"), F.flatten(F.transform("_rows", held)).alias("ys"),
    ).withColumn("length", F.size("ys"))


# --- fitting -----------------------------------------------------------------------

def _prepared(panel: DataFrame, d: int, key: list[str]) -> DataFrame:
    """Differenced arrays ``w`` with uncentred autocovariances and the long autoregression."""
    out = series_arrays(panel, key)
    w = F.col("ys")
    for _ in range(d):
        w = _diff(w)
    out = out.withColumn("w", w).withColumn("n", F.size("w"))
    # values each difference of the series ends with, to sum forecasts back up
    ends, level = [], F.col("ys")
    for _ in range(d):
        ends.append(F.try_element_at(level, F.lit(-1)))
        level = _diff(level)
    out = out.withColumn("ends", F.array(*ends).cast("array<double>"))
    gamma = F.array(
        *[F.try_divide(
            _dot(F.slice("w", k + 1, F.col("n")), F.slice("w", 1, F.greatest(F.col("n") - k, F.lit(0))))
            if k else _dot(F.col("w"), F.col("w")), F.col("n").cast("double"))
          for k in range(LONG_ORDER + 1)]
    )
    out = out.withColumn("gamma", F.transform(gamma, lambda g: F.coalesce(g, F.lit(0.0))))
    order = F.least(F.lit(LONG_ORDER), F.greatest(F.lit(1), F.floor(F.col("n") / 4))).cast("int")
    return out.withColumn("order", order)


def _less_lag(i: int):
    """Take the ``i``-th autoregressive term off, where the order reaches that far."""
    phi = F.get("ar", F.lit(i - 1))
    return lambda a, b: F.when(F.col("order") >= i, a - phi * b).otherwise(a)


def _with_residuals(out: DataFrame) -> DataFrame:
    """Residuals of the long autoregression, NULL for the first ``order`` values."""
    out = out.withColumn("ar", levinson(F.col("gamma"), F.col("order"))["phi"])
    # a constant series has no autoregression
    out = out.withColumn("ar", F.transform("ar", lambda p: F.coalesce(p, F.lit(0.0))))
    e = F.col("w")
    for i in range(1, LONG_ORDER + 1):
        shifted = F.concat(
            F.array_repeat(F.lit(None).cast("double"), i), F.slice("w", 1, F.greatest(F.col("n") - i, F.lit(0)))
        )
        e = F.zip_with(e, F.slice(shifted, 1, F.col("n")), _less_lag(i))
    return out.withColumn("e", e)


def fit(panel: DataFrame, d: int = 1, key: list[str] = SERIES_KEY) -> DataFrame:
    """Parameters of ARIMA(1,d,1): one row per series.

    A series with no more than three differences has a row of the model ``insufficient_history``:
    its last value goes on, without intervals.
    """
    out = _with_residuals(_prepared(panel, d, key))
    # rows (w_t, w_{t-1}, e_{t-1}) where the lagged residual exists
    first = F.col("order") + 2
    span = F.greatest(F.col("n") - F.col("order") - 1, F.lit(0))
    out = out.withColumns(
        {"_t": F.slice("w", first, span), "_a": F.slice("w", first - 1, span),
         "_b": F.slice("e", first - 1, span)}
    )
    a, b, t = F.col("_a"), F.col("_b"), F.col("_t")
    out = out.withColumns(
        {"_aa": _dot(a, a), "_bb": _dot(b, b), "_ab": _dot(a, b), "_at": _dot(a, t), "_bt": _dot(b, t),
         "_tt": _dot(t, t), "_m": F.size(t)}
    )
    det = F.col("_aa") * F.col("_bb") - F.col("_ab") * F.col("_ab")
    # nearly equal regressors: leave the residual out
    singular = det <= F.col("_aa") * F.col("_bb") * 1e-10
    phi = F.when(singular, F.try_divide("_at", "_aa")).otherwise(
        F.try_divide(F.col("_at") * F.col("_bb") - F.col("_bt") * F.col("_ab"), det)
    )
    theta = F.when(singular, F.lit(0.0)).otherwise(
        F.try_divide(F.col("_bt") * F.col("_aa") - F.col("_at") * F.col("_ab"), det)
    )
    inside = lambda c: F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), F.coalesce(c, F.lit(0.0))))
    out = out.withColumns({"phi1": inside(phi), "theta": inside(theta)})
    p, q = F.col("phi1"), F.col("theta")
    rss = (
        F.col("_tt") - 2 * p * F.col("_at") - 2 * q * F.col("_bt")
        + p * p * F.col("_aa") + 2 * p * q * F.col("_ab") + q * q * F.col("_bb")
    )
    out = out.withColumn("sigma2", F.greatest(F.lit(0.0), F.try_divide(rss, F.col("_m"))))
    # the last innovation, started from zero: e_t = w_t - phi w_{t-1} - theta e_{t-1}
    steps = F.zip_with(
        F.slice("w", 2, F.col("n")), F.slice("w", 1, F.greatest(F.col("n") - 1, F.lit(0))), lambda x, y: x - p * y
    )
    last_e = F.aggregate(steps, F.lit(0.0), lambda acc, u: u - q * acc)
    return _table(out, key, d, f"ARIMA(1,{d},1)", F.array(p), q, last_e, 3)


def _table(out, key, d, name, phi, theta, last_e, n_params) -> DataFrame:
    n = F.col("n").cast("double")
    short = F.col("n") <= SHORT
    out = out.withColumn("sigma2", F.when(~short, F.col("sigma2")))
    fit_term = n * (F.ln(2 * math.pi * F.col("sigma2")) + 1)
    none = F.array().cast("array<double>")
    last_value = F.array(F.try_element_at("ys", F.lit(-1)))
    return out.select(
        *key, F.when(short, "insufficient_history").otherwise(name).alias("model"),
        F.when(short, 1).otherwise(d).alias("d"),
        F.when(short, none).otherwise(phi.cast("array<double>")).alias("phi"),
        F.when(short, 0.0).otherwise(theta).alias("theta"), F.col("sigma2"),
        F.when(short, 0.0).otherwise(last_e).alias("last_e"),
        F.slice("w", F.greatest(F.col("n") - MAX_AR + 1, F.lit(1)), MAX_AR).alias("tail"),
        F.when(short, last_value).otherwise(F.col("ends")).alias("ends"), F.col("last_date"), F.col("n"),
        (fit_term + 2 * n_params).alias("aic"), (fit_term + n_params * F.ln(n)).alias("bic"),
    )


def fit_autoregressions(panel: DataFrame, d: int = 1, key: list[str] = SERIES_KEY) -> DataFrame:
    """Parameters of AR(0,d) ... AR(5,d): one recursion per series gives all orders."""
    out = _prepared(panel, d, key).where(F.col("n") > MAX_AR)
    tables = []
    for p in range(MAX_AR + 1):
        lev = levinson(F.col("gamma"), p) if p else None
        phi = lev["phi"] if p else F.array().cast("array<double>")
        sigma2 = F.element_at(lev["vars"], -1) if p else F.col("gamma")[0]
        tables.append(
            F.struct(
                F.lit(f"ARIMA({p},{d},0)").alias("model"),
                F.transform(phi, lambda x: F.coalesce(x, F.lit(0.0))).alias("phi"),
                F.coalesce(sigma2, F.lit(0.0)).alias("sigma2"), F.lit(p + 1).alias("k"),
            )
        )
    rows = out.withColumn("_fit", F.explode(F.array(*tables))).withColumn("sigma2", F.col("_fit.sigma2"))
    n = F.col("n").cast("double")
    fit_term = n * (F.ln(2 * math.pi * F.col("sigma2")) + 1)
    return rows.select(
        *key, F.col("_fit.model").alias("model"), F.lit(d).alias("d"), F.col("_fit.phi").alias("phi"),
        F.lit(0.0).alias("theta"), "sigma2", F.lit(0.0).alias("last_e"),
        F.slice("w", F.greatest(F.col("n") - MAX_AR + 1, F.lit(1)), MAX_AR).alias("tail"),
        "ends", "last_date", "n",
        (fit_term + 2 * F.col("_fit.k")).alias("aic"),
        (fit_term + F.col("_fit.k") * F.ln(n)).alias("bic"),
    )


def compare_orders(panel: DataFrame, d: int = 1, key: list[str] = SERIES_KEY) -> DataFrame:
    """All candidates of every series with their ``rank`` by AIC (best is 1)."""
    ranks = Window.partitionBy(*key).orderBy(F.asc_nulls_last("aic"), "model")
    both = stacked([fit(panel, d, key), fit_autoregressions(panel, d, key)], key)
    return both.withColumn("rank", F.row_number().over(ranks))


def select_order(panel: DataFrame, d: int = 1, key: list[str] = SERIES_KEY) -> DataFrame:
    """The parameter table of the candidate with the smallest AIC per series."""
    return compare_orders(panel, d, key).where(F.col("rank") == 1).drop("rank")


def auto_select(panel: DataFrame, key: list[str] = SERIES_KEY) -> DataFrame:
    """As ``select_order``, with each series differenced as its stationarity tests suggest."""
    verdict = check_stationarity(panel, key).select(*key, F.col("d").alias("_d"))
    tagged = cut_lineage(panel.join(verdict, key))
    parts = [
        cut_lineage(select_order(tagged.where(F.col("_d") == d).drop("_d"), d, key)) for d in (0, 1, 2)
    ]
    return stacked(parts, key)


def residuals(panel: DataFrame, params: DataFrame, d: int = 1, key: list[str] = SERIES_KEY) -> DataFrame:
    """In-sample innovations of the fitted ARMA part as rows ``(key, step, date, resid)``."""
    arrays = _prepared(panel, d, key).where(F.col("n") > SHORT).select(*key, "w", "n", "last_date")
    fitted = arrays.join(params.select(*key, "phi", "theta"), key)
    steps = F.zip_with(
        F.slice("w", 2, F.col("n")), F.slice("w", 1, F.col("n") - 1),
        lambda x, y: x - F.coalesce(F.get("phi", F.lit(0)), F.lit(0.0)) * y,
    )
    empty = F.array().cast("array<double>")
    innov = F.aggregate(
        steps, F.struct(F.lit(0.0).alias("e"), empty.alias("all")),
        lambda acc, u: F.struct(
            (u - F.col("theta") * acc["e"]).alias("e"),
            F.concat(acc["all"], F.array(u - F.col("theta") * acc["e"])).alias("all"),
        ),
    )["all"]
    return fitted.select(
        *key, "last_date", F.size("w").alias("n"), F.posexplode(innov).alias("step", "resid")
    ).select(
        *key, (F.col("step") + 1).alias("step"),
        F.date_sub("last_date", (F.col("n") - 2 - F.col("step")).cast("int")).alias("date"), "resid",
    )


# --- forecasting -------------------------------------------------------------------

def forecast(
    params: DataFrame, steps: Column | int = 30, digits: int | None = 2, key: list[str] = SERIES_KEY,
    carry: list[str] | None = None,
) -> DataFrame:
    """Point forecasts with 80 % and 95 % intervals from a parameter table.

    ``steps`` may be a column (a horizon per series); ``carry`` keeps more columns.
    """
    carry = carry or []
    h = F.lit(steps) if isinstance(steps, int) else steps
    d = F.col("d")
    p = F.size("phi")
    backwards = F.reverse("phi")
    path = F.aggregate(
        F.sequence(F.lit(1), h.cast("int")), F.col("tail"),
        lambda acc, i: F.concat(
            acc,
            F.array(
                _dot(F.slice(acc, F.greatest(F.size(acc) - p + 1, F.lit(1)), p), backwards)
                + F.when(i == 1, F.col("theta") * F.col("last_e")).otherwise(0.0)
            ),
        ),
    )
    psi = F.aggregate(
        F.sequence(F.lit(1), h.cast("int") - 1, F.lit(1)), F.array(F.lit(1.0)),
        lambda acc, i: F.concat(
            acc,
            F.array(
                _dot(F.slice(F.reverse(acc), 1, p), F.slice("phi", 1, F.least(p, F.size(acc))))
                + F.when(i == 1, F.col("theta")).otherwise(0.0)
            ),
        ),
    )
    # a one-step horizon needs no further weights
    psi = F.when(h == 1, F.array(F.lit(1.0))).otherwise(psi)
    rows = params.withColumns(
        {"_path": F.slice(path, F.size("tail") + 1, h.cast("int")), "_psi": psi}
    )
    # sum back up once per difference
    for level in (1, 0):
        need = d > level
        end = F.get("ends", F.lit(level))
        rows = rows.withColumns(
            {"_path": F.when(need, _shifted(_running(F.col("_path")), end)).otherwise(F.col("_path")),
             "_psi": F.when(need, _running(F.col("_psi"))).otherwise(F.col("_psi"))}
        )
    rows = rows.withColumn(
        "_var", _running(F.transform("_psi", lambda x: x * x * F.col("sigma2")))
    )
    rows = rows.select(
        *key, *carry, "model", "last_date",
        F.posexplode(F.arrays_zip(F.col("_path").alias("f"), F.col("_var").alias("v"))).alias("_i", "_z"),
    )
    value, sd = F.col("_z.f"), F.sqrt("_z.v")
    cols = {
        "forecast": value,
        "lower_80": value - Z80 * sd, "upper_80": value + Z80 * sd,
        "lower_95": value - Z95 * sd, "upper_95": value + Z95 * sd,
    }
    shown = [(F.round(c, digits) if digits is not None else c).alias(n) for n, c in cols.items()]
    return rows.select(
        *key, *carry, "model", (F.col("_i") + 1).alias("step"),
        F.date_add("last_date", F.col("_i") + 1).alias("date"), *shown,
    )
