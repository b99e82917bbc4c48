"""Supervised frames: calendar, lag and rolling features, and sliding input windows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewell.operators.series import by_date
from pricewell.schema import SERIES_KEY

# Lags and window lengths (days) of the feature frame.
LAGS = (1, 7, 14, 28, 56)
WINDOWS = (7, 14, 30, 90)

CALENDAR = [
    "year", "month", "day", "dayofweek", "weekofyear", "quarter",
    "is_month_start", "is_month_end", "is_weekend",
]


def calendar_features(date: Column | str = "date") -> dict[str, Column]:
    """Calendar columns of a date; Monday is day 0 and weeks are ISO weeks."""
    d = F.col(date) if isinstance(date, str) else date
    return {
        "year": F.year(d),
        "month": F.month(d),
        "day": F.dayofmonth(d),
        "dayofweek": F.weekday(d),
        "weekofyear": F.weekofyear(d),
        "quarter": F.quarter(d),
        "is_month_start": (F.dayofmonth(d) == 1).cast("int"),
        "is_month_end": (d == F.last_day(d)).cast("int"),
        "is_weekend": (F.weekday(d) >= 5).cast("int"),
    }


def lag_names(lags: Iterable[int]) -> list[str]:
    return [f"lag_{k}" for k in lags]


def roll_names(windows: Iterable[int]) -> list[str]:
    return [f"roll_{s}_{n}" for n in windows for s in ("mean", "std", "min", "max")]


def _clean(sizes: Iterable[int]) -> list[int]:
    return sorted({int(s) for s in sizes})


def feature_frame(
    panel: DataFrame,
    lags: Iterable[int] = LAGS,
    windows: Iterable[int] = WINDOWS,
    horizon: int = 1,
    key: list[str] = SERIES_KEY,
) -> DataFrame:
    """One row per target date with the features known ``horizon`` days before.

    ``panel`` is daily and gap-free.  In a short series the lags and windows that do not
    fit are NULL, and when none fits the one-day lag or window stands in.  Rows start
    where the longest usable lookback is complete; too short series give no row.
    """
    lags, windows = _clean(lags), _clean(windows)
    w = by_date(key)
    room = F.col("_n") - F.lit(horizon)
    all_lags, all_windows = _clean([1, *lags]), _clean([1, *windows])

    def usable(size: int, asked: list[int]) -> Column:
        fits = (F.lit(size) < room) if size in asked else F.lit(False)
        return fits | ((room <= min(asked)) if size == 1 else F.lit(False))

    # One sort serves every frame.  Frames are re-read per row, which was measured to be
    # faster here than putting windows together from lagged blocks.
    out = panel.select(
        *key, "date", F.col("y").alias("target"),
        F.row_number().over(w).alias("_rn"),
        F.count("*").over(Window.partitionBy(*key)).alias("_n"),
        *[F.lag("y", k + horizon - 1).over(w).alias(f"lag_{k}") for k in all_lags],
        *[
            fn("y").over(w.rowsBetween(-(n + horizon - 1), -horizon)).alias(f"roll_{name}_{n}")
            for n in all_windows
            for name, fn in (
                ("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max)
            )
        ],
    )
    lookback = F.greatest(
        F.lit(1), *[F.when(usable(s, lags), F.lit(s)) for s in lags],
        *[F.when(usable(s, windows), F.lit(s)) for s in windows],
    )
    out = out.where(F.col("_rn") >= lookback + horizon)
    clipped = [
        F.when(usable(k, lags), F.col(f"lag_{k}")).alias(f"lag_{k}") for k in all_lags
    ] + [
        F.when(usable(n, windows), F.col(name)).alias(name)
        for n in all_windows for name in roll_names([n])
    ]
    return out.select(
        *key, "date", "target", *[c.alias(n) for n, c in calendar_features().items()], *clipped
    )


def recent_history(panel: DataFrame, keep: int, key: list[str] = SERIES_KEY) -> DataFrame:
    """The last ``keep`` values of every series as an array, with the series length."""
    back = Window.partitionBy(*key).orderBy(F.desc("date"))
    return (
        panel.withColumn("_back", F.row_number().over(back))
        .groupBy(*key)
        .agg(
            F.max("date").alias("last_date"),
            F.count("*").alias("length"),
            F.sort_array(
                F.collect_list(F.when(F.col("_back") <= keep, F.struct("date", "y")))
            ).alias("_rows"),
        )
        .select(*key, "last_date", "length", F.transform("_rows", lambda r: r["y"]).alias("history"))
    )


def _add_value(acc: Column, x: Column) -> Column:
    n, step = acc["n"] + 1, x - acc["m"]
    mean = acc["m"] + step / n
    return F.struct(n.alias("n"), mean.alias("m"), (acc["q"] + step * (x - mean)).alias("q"))


def next_row_features(
    history: Column | str,
    length: Column | str,
    date: Column,
    lags: Iterable[int] = LAGS,
    windows: Iterable[int] = WINDOWS,
) -> dict[str, Column]:
    """Features for ``date`` from an array of the latest values.

    ``length`` is the full series length: lags below it and windows up to it are given,
    others are NULL.
    """
    h = F.col(history) if isinstance(history, str) else history
    n = F.col(length) if isinstance(length, str) else length
    out = dict(calendar_features(date))
    for k in _clean(lags):
        out[f"lag_{k}"] = F.when(F.lit(k) < n, F.element_at(h, -k))
    for size in _clean(windows):
        part = F.slice(h, -size, size)
        # one pass for mean and deviation (Welford)
        moments = F.aggregate(
            part,
            F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("q")),
            _add_value,
        )
        fits = F.lit(size) <= n
        out[f"roll_mean_{size}"] = F.when(fits, moments["m"])
        out[f"roll_std_{size}"] = F.when(fits, F.sqrt(moments["q"] / size))
        out[f"roll_min_{size}"] = F.when(fits, F.array_min(part))
        out[f"roll_max_{size}"] = F.when(fits, F.array_max(part))
    return out


def next_feature_row(
    panel: DataFrame,
    lags: Iterable[int] = LAGS,
    windows: Iterable[int] = WINDOWS,
    key: list[str] = SERIES_KEY,
) -> DataFrame:
    """The feature row of the day after each series ends."""
    lags, windows = _clean(lags), _clean(windows)
    recent = recent_history(panel, max(lags + windows), key).withColumn(
        "date", F.date_add("last_date", 1)
    )
    feats = next_row_features("history", "length", F.col("date"), lags, windows)
    return recent.select(*key, "date", *[c.alias(n) for n, c in feats.items()])


def sliding_windows(
    scaled: DataFrame,
    lookback: int = 30,
    column: str = "z",
    key: list[str] = SERIES_KEY,
) -> DataFrame:
    """Rows of ``inputs`` (the values before) and ``target``.

    The lookback shrinks to ``n - 2`` in short series (at least one); series that then
    have no full sample give no row.
    """
    w = by_date(key)
    n = F.count("*").over(Window.partitionBy(*key))
    rows = (
        scaled.withColumn("_n", n)
        .withColumn("_look", F.least(F.lit(lookback), F.greatest(F.lit(1), F.col("_n") - 2)))
        .where(F.col("_n") > F.col("_look") + 1)
    )
    held = F.collect_list(column).over(w.rowsBetween(-lookback, -1))
    return (
        rows.withColumn("_held", held)
        .where(F.size("_held") >= F.col("_look"))
        .withColumn("inputs", F.slice("_held", -F.col("_look"), F.col("_look")))
        .withColumn("target", F.col(column))
        .drop("_held", "_n", "_look")
    )
