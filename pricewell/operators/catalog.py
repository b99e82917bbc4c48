"""Descriptive queries over the ``prices`` table.

Medians, percentiles, spreads and distinct counts of a query come from one frequency table
(``functions.quantiles``): one scan, exact, and safe for huge groups.  ``digits=None`` turns
the presentation rounding off.
"""

from __future__ import annotations

from itertools import combinations
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricewell.functions.expressions import percent_of, price_bucket, rounded, years_covered
from pricewell.functions.names import match_name
from pricewell.functions.quantiles import aggregate_with_percentiles

PRICE = "modal_price"


# --- SQL access -----------------------------------------------------------------

def register_prices(prices: DataFrame, name: str = "prices") -> None:
    prices.createOrReplaceTempView(name)


def query(spark: SparkSession, sql: str, **params: Any) -> DataFrame:
    """Any Spark SQL; values go in as named parameters, never as text."""
    return spark.sql(sql, args=params or None)


def scalar(spark: SparkSession, sql: str, **params: Any):
    """First column of the first row."""
    row = query(spark, sql, **params).first()
    return None if row is None else row[0]


# --- helpers --------------------------------------------------------------------

def _desc(*names: str) -> list[Column]:
    return [F.desc_nulls_last(n) for n in names]


def _asc(*names: str) -> list[Column]:
    return [F.asc_nulls_last(n) for n in names]


def _for_year(prices: DataFrame, year: int | None) -> DataFrame:
    return prices if year is None else prices.where(F.col("year") == F.lit(year))


def between_years(prices: DataFrame, first: int, last: int) -> DataFrame:
    return prices.where(F.col("year").between(first, last))


def below_price(prices: DataFrame, bound: float, column: str = PRICE) -> DataFrame:
    """Upper bound; rows without a price drop out too."""
    return prices.where(F.col(column) < F.lit(float(bound)))


# --- overview and lists -----------------------------------------------------------

def overview(prices: DataFrame, digits: int | None = 2) -> DataFrame:
    out = aggregate_with_percentiles(
        prices, [], PRICE, {"median_modal_price": 0.5},
        {"total_rows": "rows", "avg_modal_price": "mean"},
        {"unique_crops": "commodity", "unique_markets": "market", "unique_states": "state"},
        {"date_from": ("min", "arrival_date"), "date_to": ("max", "arrival_date")},
    )
    return out.select(
        "total_rows", "unique_crops", "unique_markets", "unique_states", "date_from", "date_to",
        *[rounded(F.col(c), digits).alias(c) for c in ("avg_modal_price", "median_modal_price")],
    )


def list_crops(prices: DataFrame, min_records: int = 100, digits: int | None = 2) -> DataFrame:
    out = aggregate_with_percentiles(
        prices, ["commodity"], PRICE, {"median_price": 0.5}, {"records": "rows"},
        {"markets": "market", "states": "state"},
    )
    return (
        out.where(F.col("records") >= min_records)
        .select("commodity", "records", "markets", "states", rounded(F.col("median_price"), digits).alias("median_price"))
        .orderBy(*_desc("records"), *_asc("commodity"))
    )


def list_states(prices: DataFrame, commodity: str | None = None) -> DataFrame:
    return (
        match_name(prices, "commodity", commodity)
        .groupBy("state")
        .agg(
            F.count("*").alias("records"),
            F.min("arrival_date").alias("first_date"),
            F.max("arrival_date").alias("last_date"),
        )
        .orderBy(*_desc("records"), *_asc("state"))
    )


def state_summary(prices: DataFrame, year: int | None = None, digits: int | None = 2) -> DataFrame:
    rows = _for_year(prices, year)
    out = aggregate_with_percentiles(
        rows, ["state"], PRICE, {"median_price": 0.5}, {"records": "rows", "price_stddev": "std"},
        {"crops": "commodity", "markets": "market"},
    )
    return (
        out
        .select(
            "state", "crops", "markets", "records",
            rounded(F.col("median_price"), digits).alias("median_price"),
            rounded(F.col("price_stddev"), digits).alias("price_stddev"),
        )
        .orderBy(*_desc("records"), *_asc("state"))
    )


def distinct_names(prices: DataFrame, column: str) -> DataFrame:
    return prices.select(column).distinct().orderBy(*_asc(column))


def top_crop(prices: DataFrame) -> DataFrame:
    return (
        prices.groupBy("commodity").agg(F.count("*").alias("records"))
        .orderBy(*_desc("records"), *_asc("commodity")).limit(1)
    )


def largest_then_by(df: DataFrame, by: str, k: int, then: str, *ties: str) -> DataFrame:
    """The ``k`` largest rows by one column, shown in the order of another."""
    return df.orderBy(*_desc(by), *_asc(*ties)).limit(k).orderBy(*_asc(then, *ties))


# --- seasonality and trend ----------------------------------------------------------

def seasonal_average(prices: DataFrame, commodity: str, digits: int | None = 2) -> DataFrame:
    out = aggregate_with_percentiles(
        match_name(prices, "commodity", commodity), ["month"], PRICE, {"median_price": 0.5},
        {"avg_price": "mean", "price_stddev": "std", "records": "rows"},
    )
    return out.select(
        "month",
        *[rounded(F.col(c), digits).alias(c) for c in ("avg_price", "median_price", "price_stddev")],
        "records",
    ).orderBy("month")


def monthly_pattern(prices: DataFrame, digits: int | None = 2) -> DataFrame:
    out = aggregate_with_percentiles(
        prices, ["month"], PRICE, {"median_price": 0.5}, {"std_price": "std"}
    )
    return out.select(
        "month", *[rounded(F.col(c), digits).alias(c) for c in ("median_price", "std_price")]
    ).orderBy("month")


def yearly_trend(prices: DataFrame, commodity: str | None = None, digits: int | None = 2) -> DataFrame:
    out = aggregate_with_percentiles(
        match_name(prices, "commodity", commodity), ["year"], PRICE, {"median_price": 0.5},
        {"avg_price": "mean", "records": "rows"},
    )
    return out.select(
        "year", *[rounded(F.col(c), digits).alias(c) for c in ("median_price", "avg_price")], "records"
    ).orderBy("year")


def records_per_year(prices: DataFrame) -> DataFrame:
    return prices.groupBy("year").agg(F.count("*").alias("records")).orderBy("year")


def state_month_medians(prices: DataFrame, commodity: str, digits: int | None = 2) -> DataFrame:
    """Monthly median price of a crop per state."""
    out = aggregate_with_percentiles(
        match_name(prices, "commodity", commodity), ["year", "month", "state"], PRICE,
        {"median_price": 0.5},
    )
    return out.withColumn("median_price", rounded(F.col("median_price"), digits)).orderBy(
        *_asc("year", "month", "state")
    )


def state_correlation(
    prices: DataFrame, commodity: str, top_states: int, min_months: int = 3
) -> DataFrame:
    """Correlation of monthly medians between the ``top_states`` states with most records.

    The monthly medians become one column per state, and every correlation is one
    aggregate over the months, so no pair rows are ever produced.
    """
    rows = match_name(prices, "commodity", commodity)
    names = [
        r["state"]
        for r in rows.where(F.col("state").isNotNull()).groupBy("state")
        .agg(F.count("*").alias("records"))
        .orderBy(*_desc("records"), *_asc("state")).limit(top_states).collect()
    ]
    names.sort()
    monthly = state_month_medians(rows.where(F.col("state").isin(names)), commodity, digits=None)
    wide = monthly.groupBy("year", "month").agg(
        *[F.max(F.when(F.col("state") == n, F.col("median_price"))).alias(f"s{i}")
          for i, n in enumerate(names)]
    )
    pairs = list(combinations(range(len(names)), 2))
    if not pairs:
        return wide.sparkSession.createDataFrame(
            [], "state_a string, state_b string, correlation double, months bigint"
        )
    # Only months that both states have enter a pair, also in the variance test: the
    # correlation of a constant is NULL here, not NaN.
    cells = []
    for i, j in pairs:
        a, b = F.col(f"s{i}"), F.col(f"s{j}")
        both = a.isNotNull() & b.isNotNull()
        r = F.corr(F.when(both, a), F.when(both, b))
        cells.append(
            F.struct(
                F.lit(names[i]).alias("state_a"), F.lit(names[j]).alias("state_b"),
                F.nanvl(r, F.lit(None).cast("double")).alias("correlation"),
                F.count(F.when(both, 1)).alias("months"),
            )
        )
    out = wide.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
    return out.where(F.col("months") >= min_months).orderBy("state_a", "state_b")


# --- spread, quality, distribution ---------------------------------------------------

def top_volatile_markets(
    prices: DataFrame, commodity: str, top_n: int = 10, min_records: int = 52,
    digits: int | None = 2, cv_digits: int | None = 3,
) -> DataFrame:
    out = aggregate_with_percentiles(
        match_name(prices, "commodity", commodity), ["market", "state"], PRICE,
        {"median_price": 0.5},
        {"volatility": "std", "cv": "cv", "records": "rows"},
    )
    return (
        out.where(F.col("records") >= min_records)
        .orderBy(*_desc("volatility"), *_asc("market", "state"))
        .limit(top_n)
        .select(
            "market", "state", rounded(F.col("volatility"), digits).alias("volatility"),
            rounded(F.col("median_price"), digits).alias("median_price"),
            rounded(F.col("cv"), cv_digits).alias("cv"), "records",
        )
    )


def quality_audit(prices: DataFrame) -> DataFrame:
    """Counts of missing values and order violations, with their share of all rows."""
    checks = {
        "null_modal": F.col("modal_price").isNull(),
        "null_min": F.col("min_price").isNull(),
        "null_max": F.col("max_price").isNull(),
        "null_state": F.col("state").isNull(),
        "min_gt_modal": F.col("min_price") > F.col("modal_price"),
        "modal_gt_max": F.col("modal_price") > F.col("max_price"),
    }
    counts = prices.agg(
        F.count("*").alias("total"), *[F.count_if(cond).alias(n) for n, cond in checks.items()]
    )
    return counts.withColumns({f"{n}_pct": percent_of(n, "total") for n in checks})


def price_distribution(prices: DataFrame, digits: int | None = 2) -> DataFrame:
    out = aggregate_with_percentiles(
        prices, [], PRICE, {"p5": 0.05, "median": 0.5, "p95": 0.95},
        {"min": "low", "mean": "mean", "max": "high", "std": "std"},
    )
    order = ["min", "median", "mean", "max", "std", "p5", "p95"]
    return out.select(*[rounded(F.col(c), digits).alias(c) for c in order])


def price_histogram(prices: DataFrame, width: int = 1000, below: float = 30000) -> DataFrame:
    return (
        below_price(prices, below)
        .groupBy(price_bucket(PRICE, width).alias("bucket"))
        .agg(F.count("*").alias("cnt"))
        .orderBy("bucket")
    )


def pair_summary(
    prices: DataFrame, min_records: int = 365, digits: int | None = 2, cv_digits: int | None = 3
) -> DataFrame:
    out = aggregate_with_percentiles(
        prices, ["commodity", "state"], PRICE, {"median_price": 0.5},
        {"records": "rows", "low": "low", "high": "high", "mean_price": "mean", "std_price": "std", "cv": "cv"},
    ).where(F.col("records") >= min_records)
    return out.select(
        "commodity", "state", "records",
        rounded(F.col("low"), digits).alias("min_price"),
        rounded(F.col("median_price"), digits).alias("median_price"),
        rounded(F.col("high"), digits).alias("max_price"),
        rounded(F.col("mean_price"), digits).alias("mean_price"),
        rounded(F.col("std_price"), digits).alias("std_price"),
        rounded(F.col("cv"), cv_digits).alias("cv"),
    ).orderBy(*_desc("records"), *_asc("commodity", "state"))


# --- coverage ---------------------------------------------------------------------

def _coverage(prices: DataFrame) -> DataFrame:
    return prices.groupBy("commodity", "market", "state").agg(
        F.count("*").alias("total_records"),
        F.min("arrival_date").alias("date_from"),
        F.max("arrival_date").alias("date_to"),
        years_covered(F.min("arrival_date"), F.max("arrival_date")).alias("years_of_data"),
    )


def best_covered_markets(
    prices: DataFrame, commodity: str | None = None, min_records: int = 1000, top_n: int = 1
) -> DataFrame:
    """The ``top_n`` best covered (market, state) rows of every commodity, or of one."""
    ranks = Window.partitionBy("commodity").orderBy(
        *_desc("total_records"), *_asc("market", "state")
    )
    return (
        _coverage(match_name(prices, "commodity", commodity))
        .where(F.col("total_records") >= min_records)
        .withColumn("rank", F.row_number().over(ranks))
        .where(F.col("rank") <= top_n)
    )


def find_best_state(prices: DataFrame, commodity: str, min_records: int = 1000) -> str:
    """The state of the best covered market of a crop."""
    top = best_covered_markets(prices, commodity, min_records, 1).select("state").first()
    if top is None:
        raise ValueError(
            f"no market of {commodity!r} has {min_records} records or more; "
            "lower min_records or check the name"
        )
    return top["state"]


def suggest_states(prices: DataFrame, commodity: str, limit: int = 5, more_than: int = 500) -> DataFrame:
    return (
        _coverage(match_name(prices, "commodity", commodity))
        .where(F.col("total_records") > more_than)
        .orderBy(*_desc("total_records"), *_asc("market", "state"))
        .limit(limit)
        .select("market", "state", F.col("total_records").alias("records"),
                F.col("years_of_data").alias("years"))
    )


def priciest_pairs(
    prices: DataFrame, first_year: int, last_year: int, limit: int = 20, digits: int | None = None
) -> DataFrame:
    """Highest median price per (state, commodity) in a range of years."""
    out = aggregate_with_percentiles(
        between_years(prices, first_year, last_year), ["state", "commodity"], PRICE,
        {"median_price": 0.5},
    )
    return (
        out.orderBy(*_desc("median_price"), *_asc("state", "commodity"))
        .limit(limit)
        .withColumn("median_price", rounded(F.col("median_price"), digits))
    )
