"""Gradient-boosted trees: one model for the whole panel, forecasting step by step.

Series differ in price level, so target and price features are divided by the longest
rolling mean a row has.  Short series leave features empty; those stand at the level.

Boosting stops when the error on held-out days no longer falls; the number of trees in the
settings is its upper end.  Forecasts and explanations don't call the model step by step: its
nodes become flat arrays that go to every task once, and expressions walk them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewell.operators.evaluate import metrics
from pricewell.operators.features import (
    CALENDAR, LAGS, WINDOWS, feature_frame, lag_names, next_row_features, recent_history, roll_names,
)
from pricewell.operators.series import daily_values, split_train_test
from pricewell.plans.session import cut_lineage, new_path
from pricewell.plans.sizing import stacked
from pricewell.schema import SERIES_KEY

PRICE_FEATURES = lag_names(LAGS) + roll_names(WINDOWS)
FEATURES = CALENDAR + PRICE_FEATURES
KEEP = max(LAGS + WINDOWS)


@dataclass(frozen=True)
class TreeSettings:
    # Number and depth of trees, learning rate, row and column shares, seed.
    trees: int = 500
    depth: int = 6
    rate: float = 0.03
    row_share: float = 0.85
    column_share: float = 0.85
    seed: int = 42
    # One day in so many is held out to judge when to stop, and the least share by which its error has to fall.
    held_out: int = 10
    tolerance: float = 1e-4


def level(names: set[str] | None = None, get: Callable[[str], Column] = F.col) -> Column:
    """The longest rolling mean of a row, else its last value; never zero."""
    means = [f"roll_mean_{n}" for n in sorted(WINDOWS, reverse=True)] + ["roll_mean_1", "lag_1"]
    known = [get(m) for m in means if names is None or m in names]
    value = F.coalesce(*known)
    return F.when(value == 0, F.lit(1.0)).otherwise(value)


def feature_array(get: Callable[[str], Column] = F.col) -> Column:
    """Calendar values as they are, price features relative to ``_level``."""
    calendar = [get(c).cast("double") for c in CALENDAR]
    prices = [
        F.coalesce(get(c) / get("_level"), F.lit(0.0 if "std" in c else 1.0)) for c in PRICE_FEATURES
    ]
    return F.array(*calendar, *prices)


def training_frame(frame: DataFrame, held_out: int = 10) -> DataFrame:
    """The frame with ``features``, ``label`` and ``held_out``, which is true on about one day in so many."""
    rows = frame.withColumn("_level", level(set(frame.columns)))
    return rows.withColumns({
        "features": array_to_vector(feature_array()), "label": F.col("target") / F.col("_level"),
        "held_out": F.pmod(F.xxhash64("date"), F.lit(held_out)) == 0,
    })


def fit(panel: DataFrame, settings: TreeSettings = TreeSettings(), key: list[str] = SERIES_KEY) -> GBTRegressionModel:
    """Train on every series of the panel at once, day by day."""
    return fit_frame(feature_frame(daily_values(panel, key), key=key), settings)


def fit_frame(frame: DataFrame, settings: TreeSettings = TreeSettings()) -> GBTRegressionModel:
    trainer = GBTRegressor(
        maxIter=settings.trees, maxDepth=settings.depth, stepSize=settings.rate,
        subsamplingRate=settings.row_share, featureSubsetStrategy=str(settings.column_share),
        seed=settings.seed, validationIndicatorCol="held_out", validationTol=settings.tolerance,
    )
    # the trainer reads its input several times
    rows = training_frame(frame, settings.held_out).select("features", "label", "held_out").persist()
    try:
        return trainer.fit(rows)
    finally:
        rows.unpersist()


def error_curve(model: GBTRegressionModel, frame: DataFrame, held_out: int = 10) -> list[float]:
    """Mean squared error on the held-out days after each tree, relative to the level."""
    return list(model.evaluateEachIteration(training_frame(frame, held_out).where("held_out"), "squared"))


def importances(model: GBTRegressionModel) -> list[tuple[str, float]]:
    return list(zip(FEATURES, [float(x) for x in model.featureImportances.toArray()]))


def predict(model: GBTRegressionModel, frame: DataFrame) -> DataFrame:
    """Add ``predicted`` prices to a feature frame."""
    out = model.transform(training_frame(frame))
    return out.withColumn("predicted", F.col("prediction") * F.col("_level")).drop(
        "features", "label", "prediction", "held_out"
    )


def evaluate(
    panel: DataFrame, test_size: int | DataFrame = 90, settings: TreeSettings = TreeSettings(),
    digits: int | None = 2, key: list[str] = SERIES_KEY,
) -> DataFrame:
    """Scores per series on its last rows, by a model trained on the rows before them.

    ``test_size`` is a number of rows, or a table with ``tree_test`` per series.
    """
    frame = feature_frame(daily_values(panel, key), key=key)
    if isinstance(test_size, int):
        parts = split_train_test(frame, test_size, key)
    else:
        sized = frame.join(test_size.select(*key, "tree_test"), key)
        parts = split_train_test(sized, "tree_test", key).drop("tree_test")
    model = fit_frame(parts.where("part = 'train'").drop("part"), settings)
    tested = predict(model, parts.where("part = 'test'").drop("part"))
    return metrics(tested.withColumnRenamed("target", "actual"), key, digits=digits)


# --- walking the trees -----------------------------------------------------------------------

def node_table(model: GBTRegressionModel, spark) -> DataFrame:
    """The stored ensemble: ``tree, node, feature, threshold, below, above, value``; leaves have no children (-1)."""
    path = new_path(spark, "trees")
    model.write().save(path)
    node = F.col("nodeData")
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), node["id"].alias("node"), node["split"]["featureIndex"].alias("feature"),
        F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
        node["leftChild"].alias("below"), node["rightChild"].alias("above"), node["prediction"].alias("value"),
    )


def forest(model: GBTRegressionModel, spark) -> DataFrame:
    """The ensemble as one row of flat arrays; their length is bounded by the number and depth of trees."""
    nodes = sorted(node_table(model, spark).collect(), key=lambda r: (r["tree"], r["node"]))
    at = {(r["tree"], r["node"]): i for i, r in enumerate(nodes)}
    rows = [
        (r["feature"], r["threshold"], at[r["tree"], r["below"]], at[r["tree"], r["above"]], r["value"])
        if r["below"] >= 0 else (0, 0.0, i, i, r["value"])  # a leaf leads to itself
        for i, r in enumerate(nodes)
    ]
    roots = [(at[tree, 0], float(weight)) for tree, weight in enumerate(model.treeWeights)]
    depth = max(tree.depth for tree in model.trees)
    return spark.createDataFrame(
        [(*(list(c) for c in zip(*rows)), roots, depth)],
        "t_feature array<int>, t_threshold array<double>, t_below array<int>, t_above array<int>, "
        "t_value array<double>, t_roots array<struct<root:int,weight:double>>, t_depth int",
    )


def with_forest(rows: DataFrame, model: GBTRegressionModel) -> DataFrame:
    """``rows`` with the arrays of ``forest`` beside each; the one row of arrays is broadcast."""
    trees = forest(model, rows.sparkSession).withColumn("_all", F.lit(1))
    return rows.withColumn("_all", F.lit(1)).join(F.broadcast(trees), "_all").drop("_all")


def walked(x: Column) -> Column:
    """The model's prediction for an array of features, from the columns of ``forest``."""
    def further(x: Column):
        return lambda n, _: F.when(
            F.get(x, F.get("t_feature", n)) <= F.get("t_threshold", n), F.get("t_below", n)
        ).otherwise(F.get("t_above", n))

    return _named(x, lambda x: F.aggregate(
        "t_roots", F.lit(0.0),
        lambda total, tree: total + tree["weight"] * F.get(
            "t_value", F.aggregate(F.sequence(F.lit(1), "t_depth"), tree["root"], further(x))),
    ))


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def _next_x(history: Column, length: Column, date: Column, use: Callable[[Column, Column], Column]) -> Column:
    """``use(x, level)`` for the feature array and level of the day ``date`` after a history."""
    features = next_row_features(history, length, date)
    names = set(features)
    row = F.struct(*[c.alias(n) for n, c in features.items()])
    return _named(row, lambda f: _named(
        level(names, lambda n: f[n]),
        lambda lv: use(feature_array(lambda n: lv if n == "_level" else f[n]), lv)))


def _recent(panel: DataFrame, model: GBTRegressionModel, key: list[str]) -> DataFrame:
    """The newest values of every series, beside the model; few rows, but much work in each: full width."""
    width = int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    state = recent_history(daily_values(panel, key), KEEP, key)
    return with_forest(state.repartition(width, *key), model)


def forecast(
    model: GBTRegressionModel, panel: DataFrame, steps: int = 30, digits: int | None = 2,
    key: list[str] = SERIES_KEY,
) -> DataFrame:
    """Recursive forecast of all series: predict a day, append it, build the next features.

    All steps are one fold over each series' newest values, in one plan.
    """
    state = _recent(panel, model, key)
    start = F.struct(F.col("history").alias("h"), F.col("length").alias("n"), F.array().cast("array<double>").alias("path"))

    def step(acc: Column, k: Column) -> Column:
        new = _next_x(acc["h"], acc["n"], F.date_add("last_date", k), lambda x, lv: walked(x) * lv)
        return _named(new, lambda v: F.struct(
            F.slice(F.concat(acc["h"], F.array(v)), F.greatest(F.lit(1), F.size(acc["h"]) + 2 - KEEP), KEEP).alias("h"),
            (acc["n"] + 1).alias("n"), F.concat(acc["path"], F.array(v)).alias("path"),
        ))

    path = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda acc: acc["path"])
    out = state.select(*key, "last_date", F.posexplode(path).alias("_i", "forecast"))
    value = F.col("forecast") if digits is None else F.round("forecast", digits)
    return out.select(
        *key, F.lit("gbt").alias("model"), (F.col("_i") + 1).alias("step"),
        F.date_add("last_date", F.col("_i") + 1).alias("date"), value.alias("forecast"),
    )


def forecast_direct(
    panel: DataFrame, horizons: list[int], settings: TreeSettings = TreeSettings(),
    key: list[str] = SERIES_KEY,
) -> DataFrame:
    """One model per horizon instead of feeding forecasts back."""
    panel = daily_values(panel, key)
    parts = []
    for h in horizons:
        model = fit_frame(feature_frame(panel, horizon=h, key=key), settings)
        value = _next_x(F.col("history"), F.col("length"), F.date_add("last_date", h), lambda x, lv: walked(x) * lv)
        parts.append(
            _recent(panel, model, key).select(
                *key, F.lit("gbt").alias("model"), F.lit(h).alias("step"),
                F.date_add("last_date", h).alias("date"), value.alias("forecast"),
            )
        )
    return stacked(parts, key)


def explain_next_step(
    model: GBTRegressionModel, panel: DataFrame, top_n: int = 10, key: list[str] = SERIES_KEY
) -> DataFrame:
    """The features that move the next forecast most, per series.

    A feature's contribution is how much the prediction changes when it is set to its
    mean over the panel's next rows; ``base_value`` is the prediction with all features
    at their means.  These are substitution effects, not Shapley values.
    """
    state = recent_history(daily_values(panel, key), KEEP, key)
    both = _next_x(F.col("history"), F.col("length"), F.date_add("last_date", 1),
                   lambda x, lv: F.struct(x.alias("x"), lv.alias("_level")))
    rows = state.select(*key, F.date_add("last_date", 1).alias("date"), both.alias("_b")).select(
        *key, "date", "_b._level", "_b.x")
    rows = cut_lineage(rows)  # one row per series, read for the means and for the effects
    means = [float(m) for m in rows.agg(*[F.avg(F.col("x")[i]) for i in range(len(FEATURES))]).first()]
    centre = F.array(*[F.lit(m) for m in means])
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def without(j: Column) -> Column:
        return walked(F.transform("x", lambda v, i: F.when(i == j, F.get(centre, i)).otherwise(v)))

    # one value per feature: bounded by the number of features
    effects = with_forest(rows.repartition(width, *key), model).select(
        *key, "date", "_level", "x", walked(F.col("x")).alias("_full"), walked(centre).alias("_base"),
        F.transform(F.sequence(F.lit(0), F.lit(len(FEATURES) - 1)), without).alias("_without"),
    )
    names = F.array(*[F.lit(n) for n in FEATURES])
    single = effects.select(
        *key, "date", "_level", "x", "_full", "_base", F.posexplode("_without").alias("_j", "_single"))
    contributions = single.select(
        *key, "date", (F.col("_full") * F.col("_level")).alias("prediction"),
        (F.col("_base") * F.col("_level")).alias("base_value"),
        F.get(names, F.col("_j")).alias("feature"), F.get("x", F.col("_j")).alias("value"),
        ((F.col("_full") - F.col("_single")) * F.col("_level")).alias("contribution"),
    )
    return top_contributions(contributions, top_n, key)


def top_contributions(contributions: DataFrame, top_n: int, key: list[str] = SERIES_KEY) -> DataFrame:
    """The ``top_n`` rows of each series by absolute contribution, with their rank."""
    ranks = Window.partitionBy(*key).orderBy(F.desc(F.abs("contribution")), "feature")
    return contributions.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= top_n)


def top_feature(explained: DataFrame, key: list[str] = SERIES_KEY) -> DataFrame:
    return explained.where(F.col("rank") == 1).select(*key, F.col("feature").alias("top_feature"))
