import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricewell.functions.names import match_name
from pricewell.models import arima, ensemble, gbt, registry, sequence
from pricewell.operators.align import side_by_side
from pricewell.plans.session import new_path
from pricewell.sources import prices as P
from pricewell.sources import sinks as K
from pricewell.sources.star import star_prices

SF = "/root/testdata/sf0.001"
TREES = gbt.TreeSettings(trees=3, depth=3)


@pytest.fixture(scope="module")
def panel(make_panel):
    rng = np.random.default_rng(4)
    t = np.arange(200)
    return make_panel({("c", f"s{i}"): 100 * (i + 1) + 8 * np.sin(2 * np.pi * t / 7) + rng.normal(0, 1, 200) for i in range(6)})


def test_tree_prunes_years(spark):
    root = new_path(spark, "tree")
    P.write_tree(star_prices(spark, SF), root)
    df = P.read_tree(spark, root).where(F.col("year") == 1997).groupBy("commodity").count()
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in text and "modal_price" not in text
    by_name = P.read_tree(spark, root).where(F.col("commodity") == "Brand#2").select("state")
    assert "PushedFilters: [IsNotNull(commodity), EqualTo(commodity,Brand#2)]" in by_name._jdf.queryExecution().executedPlan().toString()


def test_missing_sources(spark):
    with pytest.raises(FileNotFoundError):
        P.read_tree(spark, new_path(spark, "nothing"))
    with pytest.raises(FileNotFoundError):
        P.open_prices(spark, "files", files=new_path(spark, "nothing"), years=(2016, 2017))
    with pytest.raises(ValueError):
        P.open_prices(spark, "files")
    assert len(P.year_paths("/x")) == 11


def test_write_modes(spark):
    df = spark.range(3)
    with pytest.raises(ValueError):
        K.write_table(df, "t_modes", "upsert")
    path = new_path(spark, "t")
    K.write_table(df, "t_modes", "append", path)
    K.write_table(df, "t_modes", "append")
    assert spark.table("t_modes").count() == 6
    K.write_table(df, "t_modes", "replace", path)
    assert spark.table("t_modes").count() == 3
    spark.sql("DROP TABLE t_modes")


def test_log_fills_missing_columns(spark):
    fc = spark.createDataFrame([("c", "s", "gbt", dt.date(2024, 1, 1), 5.0)],
                               "commodity string, state string, model string, date date, forecast double")
    path = new_path(spark, "log")
    K.save_forecast(fc, path)
    K.save_forecast(fc.withColumn("forecast", F.lit(6.0)), path)
    got = K.recent_forecasts(K.read_log(spark, path), 1).first()
    assert got["predicted_price"] == 6.0 and got["lower_80"] is None and got["created_at"] is not None


def test_sequence_recursion(panel):
    model = sequence.fit(panel, lookback=7)
    got = [r["forecast"] for r in sequence.forecast(model, panel, 10, None).where("state = 's2'").orderBy("step").collect()]
    y = np.array([r["y"] for r in panel.where("state = 's2'").orderBy("date").collect()])
    z = list((y - y.mean()) / y.std())
    for _ in range(10):
        z.append(float(np.dot(z[-7:], model.coefficients.toArray()) + model.intercept))
    assert got == pytest.approx(list(np.array(z[-10:]) * y.std() + y.mean()), rel=1e-9)
    # beats repeating the last value on a weekly pattern
    truth = 300 + 8 * np.sin(2 * np.pi * np.arange(200, 210) / 7)
    assert np.abs(got - truth).mean() < np.abs(y[-1] - truth).mean()


def test_tree_forecast_first_step_is_the_direct_one(panel):
    model = gbt.fit(panel, TREES)
    step = {r["state"]: r["forecast"] for r in gbt.forecast(model, panel, 2, None).where("step = 1").collect()}
    explained = gbt.explain_next_step(model, panel, 5)
    direct = {r["state"]: r["prediction"] for r in explained.collect()}
    assert step == pytest.approx(direct)
    assert explained.count() == 6 * 5 and gbt.top_feature(explained).count() == 6
    assert len(gbt.importances(model)) == len(gbt.FEATURES)


def test_walked_trees_equal_the_model(panel):
    from pyspark.ml.functions import vector_to_array

    from pricewell.operators.features import feature_frame

    model = gbt.fit(panel, gbt.TreeSettings(trees=12, depth=5, tolerance=0.0))
    rows = gbt.training_frame(feature_frame(panel)).select(vector_to_array("features").alias("x"), "features").limit(500)
    both = gbt.with_forest(model.transform(rows), model).select("prediction", gbt.walked(F.col("x")).alias("w")).collect()
    assert [r["w"] for r in both] == pytest.approx([r["prediction"] for r in both], rel=1e-9)
    assert gbt.node_table(model, panel.sparkSession).where("below < 0").count() > model.getNumTrees
    # every step of the fold is what the model says for the row of the values before it
    got = [r["forecast"] for r in gbt.forecast(model, panel, 4, None).where("state = 's2'").orderBy("step").collect()]
    last = panel.where("state = 's2'")
    for k, value in enumerate(got):
        one = gbt.forecast(model, last, 1, None).first()["forecast"]
        assert one == pytest.approx(value, rel=1e-9)
        day = last.agg(F.max("date").alias("d")).first()["d"] + dt.timedelta(days=1)
        last = last.unionAll(panel.sparkSession.createDataFrame([("c", "s2", day, one)], last.select("commodity", "state", "date", "y").schema)
                             .select(*last.columns)) if len(last.columns) == 4 else last


def test_boosting_stops_by_the_held_out_error(panel):
    from pricewell.operators.features import feature_frame

    frame = feature_frame(panel)
    stopped = gbt.fit_frame(frame, gbt.TreeSettings(trees=40, depth=3, tolerance=0.05))
    assert stopped.getNumTrees < 40
    curve = gbt.error_curve(stopped, frame)
    assert len(curve) == stopped.getNumTrees and curve[-1] == min(curve)


def test_ensemble_by_hand(spark):
    key = "commodity string, state string, "
    day = dt.date(2024, 1, 1)
    valid = spark.createDataFrame([("c", "s", day, 100.0)], key + "date date, y double")
    fc = spark.createDataFrame([("c", "s", day, m, v) for m, v in (("arima", 110.0), ("gbt", 105.0), ("seq", 80.0))],
                               key + "date date, model string, forecast double")
    weights = ensemble.score_and_weigh(valid, fc)
    got = {r["model"]: r["weight"] for r in weights.collect()}
    inv = {"arima": 1 / 10, "gbt": 1 / 5, "seq": 1 / 20}
    assert got == pytest.approx({m: v / sum(inv.values()) for m, v in inv.items()})
    out = ensemble.combine(fc, weights, None).first()
    assert out["forecast"] == pytest.approx(sum(got[m] * v for m, v in (("arima", 110), ("gbt", 105), ("seq", 80))))
    assert out["seq_forecast"] == 80.0 and 80 <= out["forecast"] <= 110


def test_short_series_are_left_out_of_validation(make_panel):
    out = ensemble.validation_split(make_panel({("c", "long"): range(45), ("c", "short"): range(44)}))
    assert {r["state"] for r in out.select("state").distinct().collect()} == {"long"}
    assert out.where("part = 'valid'").count() == 14


def test_registry_trains_only_what_is_missing(spark, panel):
    root = new_path(spark, "models")
    first = registry.ensure_arima(panel.where("state <> 's0'"), root)
    assert first.count() == 5
    seen = []

    def train(todo):
        seen.append(todo.select("state").distinct().count())
        return arima.fit(todo)

    assert registry.ensure_table(panel, registry.model_path(root, "arima"), train).count() == 6
    registry.ensure_table(panel, registry.model_path(root, "arima"), train)
    assert seen == [1, 0]
    model = registry.ensure_seq(panel, root)
    assert list(registry.ensure_seq(panel, root).coefficients) == list(model.coefficients)
    with pytest.raises(ValueError):
        registry.model_path(root, "other")


def test_side_by_side_keeps_all_models(spark):
    rows = [("c", "s", dt.date(2024, 1, 1), m, v) for m, v in (("a", 1.0), ("b", 2.0))]
    df = spark.createDataFrame(rows, "commodity string, state string, date date, model string, forecast double")
    got = side_by_side(df, ["a", "b", "z"]).first()
    assert (got["a_forecast"], got["b_forecast"], got["z_forecast"]) == (1.0, 2.0, None)


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_second_ingest_keeps_other_years(spark):
    root = new_path(spark, "two-batches")
    for year in (1996, 2031):
        raw = new_path(spark, "batch")
        spark.sql(f"""SELECT 'S' AS state, 'D' AS district, 'M' AS market, 'Green  Chilli' AS commodity, 'V' AS variety,
            'G' AS grade, DATE'{year}-02-03' AS arrival_date, 1.0D AS min_price, 3.0D AS max_price, 2.0D AS modal_price
            """).write.json(raw)
        P.ingest(spark, raw, root)
    rows = P.open_prices(spark, "tree", tree=root)
    assert sorted(r["year"] for r in rows.collect()) == [1996, 2031]
    assert match_name(rows, "commodity", " green   chilli").count() == 2
    assert P.open_prices(spark, "tree", tree=root, years=(2000, 2040)).count() == 1


def test_a_second_batch_of_a_year_is_merged(spark):
    from pricewell.streaming.ingest import ingest_new_files

    root, raw = new_path(spark, "merged"), new_path(spark, "raw")

    def batch(lines, path):
        spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.mode("append").text(path)

    def line(day, price, state='"S"'):
        return f'{{"state": {state}, "market": "M", "commodity": "C", "arrival_date": "2020-{day}", "modal_price": {price}}}'

    batch([line("01-05", 1.0), line("01-06", 2.0), line("01-06", 2.5), "{broken", line("01-07", 7.0, "null")], raw)
    P.ingest(spark, raw, root)
    second = new_path(spark, "raw")
    batch([line("02-05", 3.0), line("01-06", 9.0), line("01-07", 8.0, "null"), '{"state": "S"}'], second)
    for _ in range(2):  # the same batch again changes nothing
        P.ingest(spark, second, root, quarantine=new_path(spark, "q"))
    prices = sorted((str(r["arrival_date"]), r["modal_price"]) for r in P.read_tree(spark, root).collect())
    assert prices == [("2020-01-05", 1.0), ("2020-01-06", 9.0), ("2020-01-07", 8.0), ("2020-02-05", 3.0)]
    held = spark.read.parquet(P.quarantine_path(root)).collect()
    assert [(r["record"], r["reason"]) for r in held] == [("{broken", "unreadable")]
    P.ingest(spark, second, root, mode="overwrite")
    assert P.read_tree(spark, root).count() == 3
    streamed, progress = new_path(spark, "streamed"), new_path(spark, "progress")
    ingest_new_files(spark, raw, streamed, progress)
    batch([line("03-01", 4.0)], raw)
    ingest_new_files(spark, raw, streamed, progress)
    assert P.read_tree(spark, streamed).count() == 5


def test_ensemble_goes_on_without_a_component(spark):
    forecasts = spark.sql("""SELECT c AS commodity, 'S' AS state, DATE'2024-01-01' AS date, m AS model, f AS forecast
        FROM VALUES ('A', 'arima', 10.0D), ('A', 'xgb', 20.0D), ('B', 'arima', 4.0D), ('C', 'arima', 2.0D), ('C', 'xgb', 4.0D)
        AS t(c, m, f)""")
    weights = spark.sql("""SELECT c AS commodity, 'S' AS state, m AS model, w AS weight FROM VALUES
        ('A', 'arima', 0.25D), ('A', 'xgb', 0.75D), ('B', 'arima', 0.5D), ('B', 'xgb', 0.5D) AS t(c, m, w)""")
    got = ensemble.combine(forecasts, weights, components=["arima", "xgb"]).collect()
    assert {r["commodity"]: r["forecast"] for r in got} == {"A": 17.5, "B": 4.0, "C": 3.0}


def test_model_queries_run_at_production_size(spark, monkeypatch):
    from checks import models as checked
    from checks.registry import QUERIES

    seen = {}
    monkeypatch.setattr(checked, "_panel", lambda s, d: "panel")
    monkeypatch.setattr(checked, "star_prices", lambda s, d: "prices")
    monkeypatch.setattr(checked, "read_log", lambda s, log: spark.range(1).withColumnRenamed("id", "created_at"))
    monkeypatch.setattr(checked, "retrain", lambda p, log, models, **k: seen.update(retrain=k))
    monkeypatch.setattr(checked.N, "fit_weights", lambda p, trees, most: seen.update(weights=(trees, most)))
    monkeypatch.setattr(checked.G, "evaluate", lambda p, size, trees: seen.update(evaluate=(size, trees)))
    monkeypatch.setattr(checked.G, "fit", lambda p, trees: seen.setdefault("fits", []).append(trees))
    monkeypatch.setattr(checked.G, "forecast", lambda m, p, steps: seen.update(steps=steps))
    monkeypatch.setattr(checked.G, "explain_next_step", lambda m, p, top: seen.update(top=top))
    for name in ("gbt_evaluate", "gbt_forecast", "gbt_explain", "ensemble_weights", "retrain_log"):
        QUERIES[name](spark, "unused")
    full = gbt.TreeSettings()
    assert (full.trees, full.depth) == (500, 6)
    assert seen == {
        "retrain": {"steps": 30, "trees": full, "validation": 90}, "weights": (full, 90), "evaluate": (90, full),
        "fits": [full, full], "steps": 30, "top": 8,
    }


def counted(spark, df, column):
    """``df``, and how often its rows are computed: the number counts passes of a row through a Python function."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf(df.schema[column].dataType)
    def same(value):
        calls.add(1)
        return value

    return df.withColumn(column, same.asNondeterministic()(column)), calls


def records(spark, n=40):
    """Raw records of the years 1995 to 2001, some without names."""
    return spark.sql(f"""SELECT IF(id % 5 = 0, NULL, concat(' green  STATE ', id % 3)) AS state, concat('D', id % 2) AS district,
        IF(id % 7 = 0, NULL, 'M') AS market, concat('brand#', id % 2) AS commodity, 'V' AS variety, 'G' AS grade,
        make_date(1995 + id % 7, 1 + id % 12, 1 + id % 3) AS arrival_date, 1.0D AS min_price, 3.0D AS max_price,
        CAST(id AS DOUBLE) AS modal_price FROM range({n})""").select(*P.RAW_PRICES.fieldNames())


def test_yearly_files_compute_their_rows_once(spark, monkeypatch):
    from checks import storage as checked

    rows, calls = counted(spark, P.clean_records(records(spark)), "grade")
    monkeypatch.setattr(checked, "star_prices", lambda s, d: rows)
    base = checked._files(spark, "unused")
    assert calls.value == 40
    got = P.read_year_files(spark, base, 1995, 2001)
    assert sorted(r["modal_price"] for r in got.collect()) == [float(i) for i in range(40)]
    assert P.read_year_files(spark, base, 1997, 1997).select("year").distinct().collect() == [(1997,)]


def test_lines_are_not_shuffled_to_meet_small_tables(spark):
    base = new_path(spark, "star")
    for name, row in {
        "nation": "1 AS n_nationkey, 'N' AS n_name", "supplier": "id AS s_suppkey, 'S' AS s_name, 1 AS s_nationkey",
        "part": "id AS p_partkey, 'B' AS p_brand, 'T' AS p_type, 2.0D AS p_retailprice",
        "lineitem": "id AS l_partkey, id AS l_suppkey, 2.0D AS l_quantity, 6.0D AS l_extendedprice, 'F' AS l_returnflag, "
                    "TIMESTAMP_NTZ'1996-02-03 00:00:00' AS l_shipdate",
    }.items():
        spark.sql(f"SELECT {row} FROM range({1 if name == 'nation' else 3})").coalesce(1).write.parquet(f"{base}/{name}.parquet")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")  # each table is far below, a product of two is above
    try:
        prices = star_prices(spark, base)
        plan = prices._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert plan.count("BroadcastHashJoin") == 3 and "hashpartitioning" not in plan
    assert prices.select("district", "modal_price", "year").collect() == [(f"N-D{i}", 3.0, 1996) for i in range(3)]


def test_merge_takes_one_shuffle_and_compares_whole_keys(spark):
    held = P.clean_records(records(spark, 120)).withColumn("modal_price", -1 - F.col("modal_price"))
    held = held.unionByName(held.where("modal_price > -20"))  # some come twice
    batch = P.clean_records(records(spark, 60).where("modal_price % 3 = 0"))
    batch = batch.unionByName(batch.where("modal_price < 10")).withColumn("variety", F.when(F.col("modal_price") % 2 == 0, "V"))
    out = P.merged(held, batch)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange ") == 1 and plan.count("Exchange rangepartitioning") == 1
    key = lambda r: tuple(r[c] for c in P.RECORD_KEY)
    new = batch.collect()
    keys = {key(r) for r in new}
    wanted = [r for r in held.collect() if key(r) not in keys] + new
    assert 0 < len(wanted) < held.count() + len(new)
    assert sorted(map(str, out.collect())) == sorted(map(str, wanted))


def test_ingest_cleans_and_shuffles_once(spark, monkeypatch):
    calls = []

    def once(df, *names, clean=P.with_normal_names):
        out, n = counted(spark, clean(df, *names), "grade")
        calls.append(n)
        return out

    monkeypatch.setattr(P, "with_normal_names", once)
    root = new_path(spark, "once")
    for _ in range(2):  # into an empty tree, and merged
        raw = new_path(spark, "raw")
        records(spark).write.json(raw)
        P.ingest(spark, raw, root)
    assert [n.value for n in calls] == [40, 40]
    assert P.read_tree(spark, root).count() == 40


def test_normal_names_are_not_taken_apart(spark):
    import random

    from pricewell.functions.names import NORMAL, normal_words, normalise_name

    rng = random.Random(3)
    texts = ["".join(rng.choice("Aab B1#\t-Ééß\u2028\n ") for _ in range(rng.randrange(7))) for _ in range(4000)]
    texts += ["Green Chilli", "Brand#2", "O'Brien Mary-Jane", "Tamil Nadu ", "Ab " * 20000 + "C", None]
    df = spark.createDataFrame([(t,) for t in texts], "name string")
    assert df.where(~normalise_name("name").eqNullSafe(normal_words(F.col("name")))).collect() == []
    normal = df.where(F.col("name").rlike(NORMAL))
    assert {"Green Chilli", "Brand#2", "O'Brien Mary-Jane"} < {r["name"] for r in normal.collect()} and normal.count() > 200
    assert [r["n"] for r in df.where("name = 'Brand#2'").select(normalise_name("name").alias("n")).collect()] == ["Brand#2"]


@pytest.mark.parametrize("fmt", ["json", "csv"])
def test_raw_files_are_compressed_and_read_whole(spark, monkeypatch, fmt):
    from checks import storage as checked

    rows = records(spark, 2000).withColumn("state", F.trim("state"))  # CSV files are written without outer blanks
    monkeypatch.setattr(checked, "star_prices", lambda s, d: rows.repartition(2))
    monkeypatch.setattr(checked, "RAW_RECORDS", 300, raising=False)
    raw = checked._raw(spark, "unused", fmt)
    files = spark.read.format("binaryFile").load(raw).select("path", "length").collect()
    text = rows.select(F.sum(F.length(F.to_json(F.struct("*")) if fmt == "json" else F.concat_ws(",", "*")))).first()[0]
    assert sum(f["length"] for f in files) < 0.5 * text and len(files) == 8
    wanted = rows.fillna("") if fmt == "csv" else rows
    got = P.read_raw(spark, raw, fmt).drop(P.CORRUPT)
    assert sorted(map(str, got.fillna("").collect() if fmt == "csv" else got.collect())) == sorted(map(str, wanted.collect()))
