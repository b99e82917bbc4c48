"""Series operators over the panel ``(commodity, state, date, y)``.

The daily median reduces the raw records to at most one row per series and calendar
day, so every window below is bounded by the length of the calendar, whatever share
of the raw rows one pair holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewell.functions.names import match_loosely, match_name
from pricewell.functions.quantiles import grouped_percentiles
from pricewell.schema import SERIES_KEY


def by_date(key: list[str] = SERIES_KEY, date: str = "date"):
    return Window.partitionBy(*key).orderBy(date)


def daily_median(prices: DataFrame, key: list[str] = SERIES_KEY) -> DataFrame:
    """Median price per series and arrival date.

    A buffer holds the distinct prices of one series and day, counted map-side, however many rows that day has.
    """
    dated = prices.where(F.col("arrival_date").isNotNull())
    out = grouped_percentiles(dated, key + ["arrival_date"], "modal_price", {"y": 0.5})
    return out.withColumnRenamed("arrival_date", "date")


def densify(daily: DataFrame, key: list[str] = SERIES_KEY, fill: bool = True) -> DataFrame:
    """One row per calendar day from the first to the last observation of a series.

    Each observed row is stretched to the day before the next one, so no calendar is
    joined and only observed rows are shuffled.  ``fill`` carries the last known value
    forward; without it the added days are NULL.  ``observed`` marks days with a value.
    """
    w = by_date(key)
    # Few observed rows become many days after this shuffle, so its width is fixed by the
    # session setting; adaptive merging would only see the small input.
    width = int(daily.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = daily.repartition(width, *key).select(
        *key, "date", "y",
        F.lead("date").over(w).alias("_next"),
        F.last("y", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_filled"),
    )
    days = F.explode(F.sequence("date", F.coalesce(F.date_sub("_next", 1), F.col("date"))))
    out = rows.withColumn("_day", days).withColumn("_own", F.col("_day") == F.col("date"))
    value = F.col("_filled") if fill else F.when(F.col("_own"), F.col("y"))
    return out.select(
        *key, F.col("_day").alias("date"), value.alias("y"),
        (F.col("_own") & F.col("y").isNotNull()).alias("observed"),
    )


def daily_values(panel: DataFrame, key: list[str] = SERIES_KEY) -> DataFrame:
    """``key, date, y`` for every calendar day; weekly and monthly series are carried forward."""
    return densify(panel, key).select(*key, "date", "y")


def forward_fill(panel: DataFrame, key: list[str] = SERIES_KEY) -> DataFrame:
    frame = by_date(key).rowsBetween(Window.unboundedPreceding, 0)
    return panel.withColumn("y", F.last("y", ignorenulls=True).over(frame))


def period_label(freq: str, date: Column | str = "date") -> Column:
    """Label of the period: the day, the Sunday ending the week, or the month's first day."""
    d = F.col(date) if isinstance(date, str) else date
    if freq == "D":
        return d
    if freq == "W":
        return F.date_add(F.to_date(F.date_trunc("week", d)), 6)
    if freq == "MS":
        return F.to_date(F.trunc(d, "MM"))
    raise ValueError(f"freq must be 'D', 'W' or 'MS', not {freq!r}")


def resample(dense: DataFrame, freq: str = "W", key: list[str] = SERIES_KEY) -> DataFrame:
    """Median per period; periods without a value are dropped."""
    if freq == "D":
        return dense.select(*key, "date", "y").where(F.col("y").isNotNull())
    label = period_label(freq)
    return (
        dense.groupBy(*key, label.alias("_period"))
        .agg(F.median("y").alias("y"))
        .where(F.col("y").isNotNull())
        .select(*key, F.col("_period").alias("date"), "y")
    )


def crop_series(
    prices: DataFrame,
    commodity: str | None = None,
    state: str | None = None,
    freq: str = "W",
    strict: bool = False,
) -> DataFrame:
    """Gap-free series at the wanted frequency: all pairs, or those of the given names.

    ``strict`` raises when nothing matches.
    """
    rows = match_name(match_name(prices, "commodity", commodity), "state", state)
    rows = rows.where(F.col("commodity").isNotNull() & F.col("state").isNotNull())
    panel = resample(densify(daily_median(rows)), freq)
    if strict and panel.isEmpty():
        raise ValueError(f"no prices for commodity={commodity!r}, state={state!r}")
    return panel


def csv_series(clean: DataFrame, crop: str, state: str, strict: bool = True) -> DataFrame:
    """Daily series from cleaned flat rows, over all states that contain the text."""
    rows = match_loosely(clean, crop, state).withColumn("commodity", F.lit(crop)).withColumn(
        "state", F.lit(state)
    )
    if strict and rows.isEmpty():
        raise ValueError(f"no rows for crop={crop!r}, state={state!r}")
    return resample(densify(daily_median(rows)), "D")


def rolling_mean(
    panel: DataFrame, n: int, column: str = "y", name: str | None = None, key: list[str] = SERIES_KEY
) -> DataFrame:
    """Mean of the last ``n`` rows; NULL until ``n`` values are there."""
    frame = by_date(key).rowsBetween(-(n - 1), 0)
    full = F.count(column).over(frame) == n
    return panel.withColumn(name or f"rolling_{n}", F.when(full, F.avg(column).over(frame)))


def difference(panel: DataFrame, lag: int = 1, key: list[str] = SERIES_KEY) -> DataFrame:
    """``y`` minus ``y`` of ``lag`` rows before; the first ``lag`` rows are dropped."""
    prev = F.lag("y", lag).over(by_date(key))
    return panel.withColumn("y", F.col("y") - prev).where(F.col("y").isNotNull())


def repeated_difference(panel: DataFrame, order: int, key: list[str] = SERIES_KEY) -> DataFrame:
    """First difference taken ``order`` times."""
    for _ in range(order):
        panel = difference(panel, 1, key)
    return panel


def last_rows(panel: DataFrame, n: int, key: list[str] = SERIES_KEY) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(F.desc("date"))
    return panel.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def split_train_test(frame: DataFrame, test_size: int | str = 90, key: list[str] = SERIES_KEY) -> DataFrame:
    """Mark each row ``train`` or ``test`` by time.

    Series below 30 rows give a third (at least one row) to the test part, longer ones
    ``test_size`` rows (a number or a column) but never all.  A one-row series cannot be
    split: its ``part`` is NULL.
    """
    if isinstance(test_size, int) and test_size <= 0:
        raise ValueError("test_size must be positive")
    asked = F.lit(test_size) if isinstance(test_size, int) else F.col(test_size)
    n = F.count("*").over(Window.partitionBy(*key))
    size = F.when(n < 30, F.greatest(F.lit(1), F.floor(n / 3))).otherwise(F.least(asked, n - 1))
    back = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("date")))
    return (
        frame.withColumn("_size", size).withColumn("_n", n).withColumn("_back", back)
        .withColumn(
            "part",
            F.when(F.col("_size") >= F.col("_n"), F.lit(None))
            .when(F.col("_back") <= F.col("_size"), "test").otherwise("train"),
        )
        .drop("_size", "_n", "_back")
    )


def standardise(panel: DataFrame, key: list[str] = SERIES_KEY) -> DataFrame:
    """Add ``z`` with the series mean and population deviation it was made with."""
    whole = Window.partitionBy(*key)
    spread = F.stddev_pop("y").over(whole)
    return (
        panel.withColumn("mean", F.avg("y").over(whole))
        .withColumn("scale", F.when(spread == 0, F.lit(1.0)).otherwise(spread))
        .withColumn("z", (F.col("y") - F.col("mean")) / F.col("scale"))
    )


def unstandardise(df: DataFrame, column: str = "z", name: str = "y") -> DataFrame:
    return df.withColumn(name, F.col(column) * F.col("scale") + F.col("mean"))


def describe(panel: DataFrame, digits: int | None = 2, key: list[str] = SERIES_KEY) -> DataFrame:
    """Count, mean, deviation, quartiles, range and dates of every series."""
    # A series has at most one value per day.
    quartiles = F.percentile("y", [0.25, 0.5, 0.75]).alias("_pct")
    out = panel.groupBy(*key).agg(
        F.count("y").alias("count"), F.avg("y").alias("mean"), F.stddev_samp("y").alias("std"),
        F.min("y").alias("min"), F.max("y").alias("max"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), quartiles,
    ).withColumns({name: F.col("_pct")[i] for i, name in enumerate(("p25", "p50", "p75"))}).drop("_pct")
    nums = ["mean", "std", "min", "p25", "p50", "p75", "max"]
    return out if digits is None else out.withColumns({c: F.round(c, digits) for c in nums})
