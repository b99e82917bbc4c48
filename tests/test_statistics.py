import numpy as np
import pytest
from pyspark.sql import functions as F

from pricewell.models import arima as M
from pricewell.operators import drift as D
from pricewell.operators import stats as S
from pricewell.operators.advisory import crop_advisory
from pricewell.operators.evaluate import metrics


def _arma(rng, n, phi, theta):
    e = rng.normal(size=n)
    w = np.zeros(n)
    for t in range(1, n):
        w[t] = phi * w[t - 1] + e[t] + theta * e[t - 1]
    return 500 + np.cumsum(w)


@pytest.fixture(scope="module")
def panel(make_panel):
    rng = np.random.default_rng(0)
    t = np.arange(900)
    return make_panel({
        ("noise", "a"): rng.normal(10, 1, 600), ("walk", "a"): np.cumsum(rng.normal(size=600)),
        ("season", "a"): 100 + 0.01 * t + 10 * np.sin(2 * np.pi * t / 30) + rng.normal(0, 1, 900),
        ("arima", "a"): _arma(rng, 4000, 0.6, 0.3), ("flat", "a"): np.full(120, 3.0)})


def test_stationarity_verdicts(panel):
    got = {r["commodity"]: r for r in S.check_stationarity(panel.where("commodity in ('noise','walk','flat')")).collect()}
    assert got["noise"]["adf_stationary"] and got["noise"]["d"] == 0
    assert not got["walk"]["adf_stationary"] and not got["walk"]["kpss_stationary"] and got["walk"]["d"] == 1
    assert got["flat"]["adf_stat"] is None


def test_adf_equals_least_squares(panel, spark):
    def plain(y):
        n = len(y)
        most = min(int(np.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2)
        dy = np.diff(y)

        def fit(lags, skip):
            rows = np.arange(skip, len(dy))
            x = np.column_stack([y[rows], np.ones(len(rows))] + [dy[rows - i] for i in range(1, lags + 1)])
            beta, *_ = np.linalg.lstsq(x, dy[rows], rcond=None)
            rest = dy[rows] - x @ beta
            scale = rest @ rest / (len(rows) - lags - 2)
            return beta[0] / np.sqrt(scale * np.linalg.inv(x.T @ x)[0, 0]), len(rows) * np.log(rest @ rest / len(rows)) + 2 * (lags + 2)

        best = min(range(most + 1), key=lambda k: fit(k, most)[1])
        return fit(best, best)[0], best, len(dy) - best

    rng = np.random.default_rng(9)
    series = {"ar": [1.0], "short": list(rng.normal(size=9)), "tiny": [1.0, 2.0, 4.0]}
    for e in rng.normal(size=400):
        series["ar"].append(0.7 * series["ar"][-1] + 0.4 * np.sin(len(series["ar"])) + e)
    rows = [(c, "s", i, float(v)) for c, values in series.items() for i, v in enumerate(values)]
    data = spark.createDataFrame(rows, "commodity string, state string, i int, y double").withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("i")))
    got = {r["commodity"]: r for r in S.adf_test(data).collect()}
    for name in ("ar", "short"):
        stat, lags, obs = plain(np.array(series[name]))
        assert (got[name]["adf_lags"], got[name]["adf_obs"]) == (lags, obs)
        assert got[name]["adf_stat"] == pytest.approx(stat, rel=1e-6)
        assert got[name]["adf_p"] == pytest.approx(S.adf_p_value(stat), abs=1e-9)
    assert got["tiny"]["adf_stat"] is None and got["tiny"]["adf_p"] is None


def test_adf_p_value_at_the_critical_value():
    assert S.adf_p_value(-2.86154) == pytest.approx(0.05, abs=0.002)
    assert S.adf_p_value(3.0) == 1.0 and S.adf_p_value(-20.0) == 0.0


def test_kpss_second_pass_gives_the_same(panel):
    few = {r["commodity"]: r for r in S.kpss_test(panel.where("commodity in ('walk','noise')"), most=8).collect()}
    many = {r["commodity"]: r for r in S.kpss_test(panel.where("commodity in ('walk','noise')")).collect()}
    assert few["walk"]["kpss_lags"] > 8
    for c in few:
        assert few[c]["kpss_stat"] == pytest.approx(many[c]["kpss_stat"])


def test_partial_autocorrelation_solves_yule_walker(panel):
    rows = S.partial_autocorrelation(panel.where("commodity = 'season'"), 12).collect()
    y = np.array([r["y"] for r in panel.where("commodity = 'season'").orderBy("date").collect()])
    x = y - y.mean()
    g = np.array([x[k:] @ x[: len(x) - k] for k in range(13)]) / len(x)
    for r in rows:
        k = r["lag"]
        toeplitz = g[np.abs(np.subtract.outer(np.arange(k), np.arange(k)))]
        assert r["pacf"] == pytest.approx(np.linalg.solve(toeplitz, g[1 : k + 1])[-1], abs=1e-8)


def test_seasonal_strength(panel):
    got = {r["commodity"]: r for r in S.seasonal_strength(panel).collect()}
    assert got["season"]["fs"] > 0.9 and got["season"]["m"] == 12
    assert got["noise"]["fs"] < 0.4 and got["noise"]["m"] == 1
    assert got["flat"]["fs"] is None and got["flat"]["m"] == 1


def test_ljung_box(panel):
    resid = panel.withColumnRenamed("y", "resid")
    got = {r["commodity"]: r["white_noise"] for r in S.residual_diagnostics(resid).collect()}
    assert got["noise"] is True and got["season"] is False


def test_arima_recovers_parameters(panel):
    fit = M.fit(panel.where("commodity = 'arima'")).first()
    assert fit["phi"][0] == pytest.approx(0.6, abs=0.05) and fit["theta"] == pytest.approx(0.3, abs=0.06)
    assert fit["sigma2"] == pytest.approx(1.0, abs=0.1)


def test_arima_intervals_cover(make_panel):
    rng = np.random.default_rng(5)
    paths = {("c", f"s{i}"): _arma(rng, 430, 0.5, 0.2) for i in range(60)}
    panel = make_panel({k: v[:400] for k, v in paths.items()})
    inside = []
    for r in M.forecast(M.fit(panel), 30, None).collect():
        truth = paths[("c", r["state"])][399 + r["step"]]
        inside.append(r["lower_95"] <= truth <= r["upper_95"])
    assert 0.88 <= np.mean(inside) <= 0.99


@pytest.mark.parametrize("d", [0, 1, 2])
def test_forecast_follows_the_difference_order(make_panel, d):
    rng = np.random.default_rng(2)
    y = _arma(rng, 300, 0.4, 0.2)
    row = M.fit(make_panel({("c", "s"): y}), d).first()
    got = [r["forecast"] for r in M.forecast(M.fit(make_panel({("c", "s"): y}), d), 5, None).orderBy("step").collect()]
    w = np.diff(y, n=d)
    path, last = [], row["phi"][0] * w[-1] + row["theta"] * row["last_e"]
    for _ in range(5):
        path.append(last)
        last = row["phi"][0] * last
    for k in range(d - 1, -1, -1):
        path = np.diff(y, n=k)[-1] + np.cumsum(path)
    assert got == pytest.approx(list(path))


def test_order_selection_and_constant_series(panel):
    best = {r["commodity"]: r for r in M.select_order(panel).collect()}
    assert best["walk"]["model"].startswith("ARIMA(") and best["flat"]["sigma2"] == 0.0
    flat = M.forecast(M.fit(panel.where("commodity = 'flat'")), 4).collect()
    assert {r["forecast"] for r in flat} == {3.0}


def _psi(expected, actual, bins=10):
    cuts = np.quantile(expected, np.linspace(0, 1, bins + 1))
    cuts[0], cuts[-1] = -np.inf, np.inf
    cuts = np.unique(cuts)
    e, a = np.histogram(expected, cuts)[0], np.histogram(actual, cuts)[0]
    e, a = np.where(e == 0, 1e-6, e / e.sum()), np.where(a == 0, 1e-6, a / a.sum())
    return float(np.sum((a - e) * np.log(a / e)))


def test_psi_and_drift(make_panel, spark):
    rng = np.random.default_rng(7)
    data = {("c", "shift"): np.r_[rng.normal(10, 1, 365), rng.normal(12, 1, 90)],
            ("c", "ties"): rng.integers(1, 4, 455), ("c", "flat"): np.full(455, 2.0),
            ("c", "short"): rng.normal(size=454)}
    got = {r["state"]: r for r in D.drift_report(make_panel(data), digits=None).collect()}
    for s in ("shift", "ties", "flat"):
        v = np.asarray(data[("c", s)], float)
        assert got[s]["psi"] == pytest.approx(_psi(v[:365], v[365:]), abs=1e-9)
    assert got["flat"]["psi"] == 0.0 and got["short"]["insufficient_history"] and got["short"]["psi"] is None
    lonely = spark.createDataFrame([("c", "s", 1.0, "expected")], "commodity string, state string, y double, part string")
    assert D.population_stability_index(lonely).first()["psi"] is None


@pytest.mark.parametrize("path,volatile,advice,confidence", [
    ([101, 103, 106], False, "Hold stock or sell in phases", "High"),
    ([107, 108, 106], False, "Hold stock or sell in phases", "Medium"),
    ([99, 97, 94], False, "Sell sooner", "High"),
    ([100, 101, 101], False, "Hold / stagger sales", "Medium"),
    ([101, 103, 106], True, "Hold stock or sell in phases", "Medium"),
    ([106], False, "Hold stock or sell in phases", "Medium")])
def test_advisory(spark, make_panel, path, volatile, advice, confidence):
    past = [70, 130] * 14 + [100] if volatile else [100] * 29
    fc = spark.createDataFrame([("c", "s", i + 1, float(v)) for i, v in enumerate(path)],
                               "commodity string, state string, step int, forecast double")
    why = spark.createDataFrame([("c", "s", "lag_1")], "commodity string, state string, top_feature string")
    got = crop_advisory(make_panel({("c", "s"): past}), fc, why).first()
    assert (got["recommendation"], got["confidence"]) == (advice, confidence)
    assert len(got["rationale"]) == (4 if volatile else 3) and "lag_1" in got["rationale"][-1]
    assert got["metrics"]["last_forecast"] == path[-1]


def test_metrics_guard(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0), ("a", 2.0, 1.0)], "k string, actual double, predicted double")
    assert metrics(df, ["k"]).first()["mape"] == pytest.approx(50.0)
    assert metrics(df, ["k"], 1e-6).first()["mape"] == pytest.approx((1e6 + 0.5) / 2 * 100)
