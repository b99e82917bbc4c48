import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pricewell.operators import features as E
from pricewell.operators import series as W

DAYS = [dt.date(2023, 12, 28), dt.date(2023, 12, 30), dt.date(2024, 1, 3), dt.date(2024, 1, 10), dt.date(2024, 2, 2)]
VALUES = [1.0, 5.0, 3.0, 8.0, 2.0]


@pytest.fixture(scope="module")
def daily(spark):
    return spark.createDataFrame(
        [("C", "S", d, v) for d, v in zip(DAYS, VALUES)], "commodity string, state string, date date, y double")


def _pandas(freq):
    s = pd.Series(VALUES, index=pd.to_datetime(DAYS)).asfreq("D").ffill()
    return s.resample(freq).median().dropna()


@pytest.mark.parametrize("freq", ["D", "W", "MS"])
def test_resample_equals_pandas(daily, freq):
    got = {r["date"]: r["y"] for r in W.resample(W.densify(daily), freq).collect()}
    assert got == {i.date(): v for i, v in _pandas(freq).items()}


def test_dense_rows(daily):
    out = W.densify(daily)
    assert out.count() == (DAYS[-1] - DAYS[0]).days + 1
    assert out.where("observed").count() == len(DAYS)
    with pytest.raises(ValueError):
        W.period_label("Q")


def test_null_days_are_filled_but_not_observed(spark):
    rows = spark.createDataFrame(
        [("C", "S", dt.date(2024, 1, 1), None), ("C", "S", dt.date(2024, 1, 2), 3.0), ("C", "S", dt.date(2024, 1, 4), None)],
        "commodity string, state string, date date, y double")
    got = [(r["y"], r["observed"]) for r in W.densify(rows).orderBy("date").collect()]
    assert got == [(None, False), (3.0, True), (3.0, False), (3.0, False)]


def test_rolling_needs_full_window(make_panel):
    out = W.rolling_mean(make_panel({("C", "S"): [1, 2, 3, 4]}), 3).orderBy("date").collect()
    assert [r["rolling_3"] for r in out] == [None, None, 2.0, 3.0]


@pytest.mark.parametrize("n,expected", [(1, None), (2, 1), (29, 9), (30, 29), (91, 90), (120, 90)])
def test_split_sizes(make_panel, n, expected):
    out = W.split_train_test(make_panel({("C", "S"): range(n)}), 90)
    assert (out.where("part = 'test'").count() or None) == expected


def test_standardise_constant(make_panel):
    out = W.unstandardise(W.standardise(make_panel({("C", "S"): [5, 5, 5]})), "z", "back")
    assert {(r["z"], r["scale"], r["back"]) for r in out.collect()} == {(0.0, 1.0, 5.0)}


def _reference_frame(values, horizon):
    """Definition of the feature frame, by direct indexing."""
    room = len(values) - horizon
    lags = [k for k in E.LAGS if k < room] or [1]
    wins = [n for n in E.WINDOWS if n < room] or [1]
    rows = {}
    for origin in range(max(lags + wins) - 1, len(values) - horizon):
        past = np.array(values[: origin + 1], float)
        row = {f"lag_{k}": past[-k] for k in lags}
        for n in wins:
            part = past[-n:]
            row |= {f"roll_mean_{n}": part.mean(), f"roll_std_{n}": part.std(),
                    f"roll_min_{n}": part.min(), f"roll_max_{n}": part.max()}
        rows[dt.date(2020, 1, 1) + dt.timedelta(origin + horizon)] = row
    return rows


@pytest.mark.parametrize("horizon", [1, 3])
def test_feature_frame_for_all_lengths(make_panel, horizon):
    rng = np.random.default_rng(1)
    data = {("C", f"n{n}"): rng.uniform(1, 9, n) for n in (1, 2, 3, 8, 9, 29, 60, 100)}
    out = E.feature_frame(make_panel(data), horizon=horizon)
    got = {}
    for r in out.collect():
        got.setdefault(r["state"], {})[r["date"]] = r
    for (_, state), values in data.items():
        want = _reference_frame(list(values), horizon)
        assert set(got.get(state, {})) == set(want), state
        for day, row in want.items():
            for name in E.lag_names((1, *E.LAGS[1:])) + E.roll_names((1, *E.WINDOWS)):
                value = got[state][day][name]
                assert value == (pytest.approx(row[name], abs=1e-9) if name in row else None), (state, name)


def test_calendar_features(spark):
    days = [dt.date(2021, 1, 3), dt.date(2024, 2, 29), dt.date(2024, 12, 30)]
    df = spark.createDataFrame([(d,) for d in days], "date date").withColumns(E.calendar_features())
    for r in df.collect():
        t = pd.Timestamp(r["date"])
        assert (r["dayofweek"], r["weekofyear"], r["quarter"]) == (t.dayofweek, t.isocalendar().week, t.quarter)
        assert (r["is_month_start"], r["is_month_end"], r["is_weekend"]) == (
            int(t.is_month_start), int(t.is_month_end), int(t.dayofweek >= 5))


def test_sliding_windows_of_short_series(make_panel):
    panel = make_panel({("C", "n2"): [1, 2], ("C", "n3"): [1, 2, 3], ("C", "n5"): [1, 2, 3, 4, 5]})
    out = {}
    for r in E.sliding_windows(panel, 30, column="y").collect():
        out.setdefault(r["state"], []).append((list(r["inputs"]), r["target"]))
    assert sorted(out["n3"]) == [([1.0], 2.0), ([2.0], 3.0)]
    assert sorted(out["n5"]) == [([1.0, 2.0, 3.0], 4.0), ([2.0, 3.0, 4.0], 5.0)]
    assert "n2" not in out


def test_windows_are_partitioned(make_panel):
    df = E.feature_frame(make_panel({("C", "S"): range(100)}))
    text = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in text and "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString()


def test_rolling_query_returns_every_day_and_window(spark, make_panel, monkeypatch):
    from checks import series as checked

    rng = np.random.default_rng(8)
    data = {("C", "S"): rng.normal(100, 9, 130), ("C", "T"): rng.normal(50, 3, 95)}
    monkeypatch.setattr(checked, "panel", lambda s, d: make_panel(data))
    rows = checked.rolling_query(spark, None).collect()
    assert len(rows) == sum(len(v) - 90 for v in data.values())
    for r in rows:
        y, at = data[r["commodity"], r["state"]], (r["date"] - dt.date(2020, 1, 1)).days
        for n in (7, 14, 30, 90):
            part = y[at - n : at]
            want = part.mean(), part.std(), part.min(), part.max()
            assert [r[f"roll_{k}_{n}"] for k in ("mean", "std", "min", "max")] == pytest.approx(want)
