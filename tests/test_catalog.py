import datetime as dt

import pytest
from pyspark.sql import functions as F

from pricewell.functions.names import match_loosely, miss_report, normalise_name, normalise_text
from pricewell.operators import catalog as C
from pricewell.schema import PRICES, require_columns
from pricewell.sources.star import star_prices

D = dt.date(2023, 1, 5)


def _rows(spark, rows):
    full = [
        (r.get("state", "S"), "d", r.get("market", "M"), r.get("commodity", "C"), "v", "g", r.get("day", D),
         r.get("lo", 1.0), r.get("hi", 3.0), r.get("price", 2.0), r.get("year", 2023), r.get("month", 1))
        for r in rows
    ]
    return spark.createDataFrame(full, PRICES)


@pytest.mark.parametrize(
    "name", ["Green  Chilli   Dry", " bhindi(ladies finger)", "o'brien mary-jane", "TAMIL nadu\t", "a1b c2d"])
def test_names_follow_python_title_case(spark, name):
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(normalise_name("n")).first()[0] == normalise_text(name)


def test_quality_audit_counts_each_problem(spark):
    rows = _rows(spark, [{"price": None}, {"lo": None}, {"hi": None}, {"state": None},
                         {"lo": 5.0, "price": 4.0, "hi": 9.0}, {"price": 7.0}])
    got = C.quality_audit(rows).first()
    assert (got["total"], got["null_modal"], got["null_min"], got["null_max"], got["null_state"]) == (6, 1, 1, 1, 1)
    assert got["min_gt_modal"] == 1 and got["modal_gt_max"] == 1
    assert got["null_modal_pct"] == pytest.approx(100 / 6)


def test_one_row_and_zero_mean_groups(spark):
    rows = _rows(spark, [{"market": "one"}, {"market": "zero", "price": -1.0}, {"market": "zero", "price": 1.0}])
    got = {r["market"]: r for r in C.top_volatile_markets(rows, "C", 10, 1).collect()}
    assert got["one"]["volatility"] is None and got["zero"]["cv"] is None
    assert list(got) == ["zero", "one"]


def test_ties_at_the_limit_go_by_name(spark):
    rows = _rows(spark, [{"commodity": c} for c in "ba"])
    assert C.top_crop(rows).first()["commodity"] == "a"


def test_best_state_needs_enough_records(spark):
    rows = _rows(spark, [{"state": "A"}, {"state": "B", "market": "N"}, {"state": "B", "market": "N"}])
    assert C.find_best_state(rows, "C", 2) == "B"
    with pytest.raises(ValueError):
        C.find_best_state(rows, "C", 3)


def test_null_state_is_a_group(spark):
    rows = _rows(spark, [{"state": None}, {"state": None, "price": 4.0}, {"state": "A"}])
    got = {r["state"]: r for r in C.state_summary(rows).collect()}
    assert got[None]["median_price"] == 3.0 and got[None]["records"] == 2
    assert C.state_summary(rows, 0).count() == 0  # year 0 is a filter, not "all"


def test_matching_and_miss_report(spark):
    rows = _rows(spark, [{"commodity": " Tomato ", "state": "Tamil Nadu (x)"}, {"commodity": "Tomato Big"}])
    assert match_loosely(rows, "tomato", "nadu (", "commodity").count() == 1
    report = miss_report(rows, "TOMATO", "commodity")
    assert report["rows"].first()[0] == 2 and report["crops"].count() == 2


def test_schema_check(spark):
    with pytest.raises(TypeError, match="modal_price"):
        require_columns(spark.createDataFrame([("a",)], "state string"), PRICES)


def test_sql_parameters_are_values(spark):
    C.register_prices(_rows(spark, [{"commodity": "o'x"}]))
    assert C.scalar(spark, "SELECT count(*) FROM prices WHERE commodity = :c", c="o'x") == 1


def test_only_needed_columns_are_read(spark):
    plan = star_prices(spark, "/root/testdata/sf0.001").groupBy("state").agg(F.count("*"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "p_retailprice" not in text and "l_extendedprice" not in text
