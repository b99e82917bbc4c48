import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pricewell.functions.quantiles import aggregate_with_percentiles, grouped_percentiles

PROBS = {"p5": 0.05, "mid": 0.5, "p95": 0.95}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    groups = {
        "hot": rng.lognormal(7, 1, 3000), "tied": rng.integers(1, 5, 400).astype(float),
        "signed": rng.normal(0, 50, 300), "small": rng.normal(10, 1, 7), "one": np.array([4.0]),
        "flat": np.full(250, 12.5),
    }
    pdf = pd.concat([pd.DataFrame({"g": k, "v": v}) for k, v in groups.items()])
    pdf = pd.concat([pdf, pd.DataFrame({"g": None, "v": rng.normal(5, 2, 200)}), pd.DataFrame({"g": "none", "v": [None]})])
    return spark.createDataFrame(pdf, "g string, v double")


def _expected(rows):
    pdf = rows.toPandas()
    return {
        g: (np.quantile(p["v"].dropna(), list(PROBS.values())) if p["v"].notna().any() else None, len(p))
        for g, p in pdf.groupby("g", dropna=False)
    }


def test_groups_give_exact_percentiles(rows):
    out = aggregate_with_percentiles(rows, ["g"], "v", PROBS, {"n": "rows"})
    got = {r["g"]: r for r in out.collect()}
    want = {(None if isinstance(g, float) else g): w for g, w in _expected(rows).items()}
    assert set(got) == set(want)
    for g, (values, n) in want.items():
        assert got[g]["n"] == n
        if values is None:
            assert got[g]["mid"] is None
        else:
            assert [got[g][p] for p in PROBS] == pytest.approx(list(values), rel=1e-12)


def test_whole_table(rows):
    got = aggregate_with_percentiles(rows, [], "v", PROBS).first()
    values = rows.toPandas()["v"].dropna()
    assert [got[p] for p in PROBS] == pytest.approx(list(np.quantile(values, list(PROBS.values()))))


def test_both_ways_agree(rows):
    one = {r["g"]: r for r in aggregate_with_percentiles(rows, ["g"], "v", PROBS).collect()}
    two = {r["g"]: r for r in grouped_percentiles(rows, ["g"], "v", PROBS).collect()}
    assert set(one) == set(two)
    for g in one:
        for p in PROBS:
            assert one[g][p] == (None if two[g][p] is None else pytest.approx(two[g][p], rel=1e-12)), (g, p)


def test_statistics_from_frequencies(rows):
    stats = {"n": "rows", "lo": "low", "hi": "high", "m": "mean", "s": "std", "cv": "cv"}
    got = {r["g"]: r for r in aggregate_with_percentiles(rows, ["g"], "v", {"mid": 0.5}, stats).collect()}
    want = {r["g"]: r for r in rows.groupBy("g").agg(
        F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("m"),
        F.stddev_samp("v").alias("s"), F.try_divide(F.stddev_samp("v"), F.avg("v")).alias("cv")).collect()}
    assert set(got) == set(want)
    for g in want:
        for c in stats:
            assert got[g][c] == (None if want[g][c] is None else pytest.approx(want[g][c], rel=1e-9, abs=1e-12)), (g, c)
    assert got["flat"]["s"] == 0.0 and got["one"]["s"] is None and got["none"]["m"] is None


def test_spread_of_close_values_far_from_zero(spark):
    rows = spark.createDataFrame([(1e6 + i / 8,) for i in range(9)], "v double")
    got = aggregate_with_percentiles(rows, [], "v", {"mid": 0.5}, {"s": "std"}).first()
    assert got["s"] == pytest.approx(np.std(np.arange(9) / 8, ddof=1), rel=1e-6) and got["mid"] == 1e6 + 0.5


def test_distinct_counts_and_extremes_with_clashing_names(spark):
    data = [("x", "m", 1.0, 5), ("x", "n", 1.0, 7), ("x", None, None, 6), (None, "m", 4.0, None), ("y", None, None, 2)]
    rows = spark.createDataFrame(data, "_v string, _band string, _c double, _rank int")
    got = {r["_v"]: r for r in aggregate_with_percentiles(
        rows, ["_v"], "_c", {"mid": 0.5}, {"n": "rows"}, {"kinds": "_band"}, {"first": ("min", "_rank"), "last": ("max", "_rank")},
    ).collect()}
    assert tuple(got["x"])[1:] == (3, 2, 5, 7, 1.0)
    assert tuple(got[None])[1:] == (1, 1, None, None, 4.0)
    assert tuple(got["y"])[1:] == (1, 0, 2, 2, None)


def test_nan_and_empty_tables(spark):
    rows = spark.createDataFrame([("a", float("nan")), ("a", 2.0)], "g string, v double")
    got = aggregate_with_percentiles(rows, ["g"], "v", {"mid": 0.5}, {"n": "rows", "hi": "high"}).first()
    assert (got["n"], got["mid"], got["hi"]) == (2, 2.0, 2.0)
    empty = rows.where("false")
    assert aggregate_with_percentiles(empty, ["g"], "v", {"mid": 0.5}).count() == 0
    whole = aggregate_with_percentiles(empty, [], "v", {"mid": 0.5}, {"n": "rows"}, {"kinds": "g"}).collect()
    assert [tuple(r) for r in whole] == [(0, 0, None)]


@pytest.mark.parametrize("more", [
    {}, {"distinct": {"kinds": "h"}}, {"distinct": {"kinds": "h"}, "extremes": {"a": ("min", "i"), "z": ("max", "i")}}])
def test_the_input_is_scanned_once(spark, tmp_path, more):
    spark.range(2000).selectExpr("id % 7 AS g", "id % 3 AS h", "id / 4 AS v", "id AS i").write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup()
    out = aggregate_with_percentiles(table, ["g"], "v", PROBS, {"s": "std"}, **more)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup() == jobs  # planning runs no job
    out.collect()
    final = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 1, final
