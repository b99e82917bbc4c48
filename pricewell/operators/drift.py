"""Distribution drift of every series: population stability index and window report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewell.functions.quantiles import grouped_percentiles
from pricewell.schema import SERIES_KEY

EMPTY_SHARE = 1e-6  # stands for the share of an empty bin


def _share(count: Column, total: Column) -> Column:
    return F.when(count == 0, F.lit(EMPTY_SHARE)).otherwise(count / total)


def population_stability_index(
    samples: DataFrame, bins: int = 10, digits: int | None = 4, key: list[str] = SERIES_KEY
) -> DataFrame:
    """PSI per series from rows ``(key, y, part)`` with part ``expected`` or ``actual``.

    Bins are half-open, cut at the inner quantiles of the expected part (equal cuts count
    once).  A bin that is empty on one side keeps a small share; one empty on both adds
    nothing.  A series with an empty side gets NULL.
    """
    rows = samples.where(F.col("y").isNotNull()).select(*key, "y", "part")
    expected, actual = F.col("part") == "expected", F.col("part") == "actual"
    inner = {f"_q{i}": i / bins for i in range(1, bins)}
    sizes = rows.groupBy(*key).agg(
        F.count_if(expected).alias("_ne"), F.count_if(actual).alias("_na")
    )
    if not inner:
        return sizes.select(*key, F.when((F.col("_ne") > 0) & (F.col("_na") > 0), 0.0).alias("psi"))
    edges = grouped_percentiles(rows.where(expected), key, "y", inner).select(
        *key, F.array_distinct(F.array(*inner)).alias("_edges")
    )
    counts = (
        rows.join(edges, key)
        .withColumn("_bin", F.size(F.filter("_edges", lambda c: c <= F.col("y"))))
        .groupBy(*key, "_bin")
        .agg(F.count_if(expected).alias("_e"), F.count_if(actual).alias("_a"))
    )
    e, a = _share(F.col("_e"), F.col("_ne")), _share(F.col("_a"), F.col("_na"))
    psi = F.sum((a - e) * F.ln(a / e))
    out = counts.join(sizes.where((F.col("_ne") > 0) & (F.col("_na") > 0)), key).groupBy(*key).agg(
        psi.alias("psi")
    )
    out = sizes.select(*key).join(out, key, "left")
    return out if digits is None else out.withColumn("psi", F.round("psi", digits))


def drift_report(
    panel: DataFrame, baseline_rows: int = 365, recent_rows: int = 90, digits: int | None = 2,
    bins: int = 10, key: list[str] = SERIES_KEY,
) -> DataFrame:
    """The latest rows against the baseline rows before them.

    Windows count rows, whatever the frequency.  Series that are too short are kept, with
    ``insufficient_history`` set and NULL measures.
    """
    back = Window.partitionBy(*key).orderBy(F.desc("date"))
    need = baseline_rows + recent_rows
    rows = panel.where(F.col("y").isNotNull()).withColumns(
        {"_back": F.row_number().over(back), "_n": F.count("*").over(Window.partitionBy(*key))}
    )
    window = rows.where((F.col("_n") >= need) & (F.col("_back") <= need)).withColumn(
        "part", F.when(F.col("_back") <= recent_rows, "actual").otherwise("expected")
    )
    base = F.when(F.col("part") == "expected", F.col("y"))
    recent = F.when(F.col("part") == "actual", F.col("y"))
    # at most baseline_rows + recent_rows values per series
    stats = window.groupBy(*key).agg(
        F.avg(base).alias("baseline_mean"), F.avg(recent).alias("recent_mean"),
        F.median(base).alias("_base_median"), F.median(recent).alias("_recent_median"),
    )
    shift = lambda new, old: F.try_divide(F.col(new) - F.col(old), F.col(old)) * 100
    stats = stats.withColumns(
        {"mean_shift_pct": shift("recent_mean", "baseline_mean"),
         "median_shift_pct": shift("_recent_median", "_base_median")}
    ).drop("_base_median", "_recent_median")
    if digits is not None:
        stats = stats.withColumns({c: F.round(c, digits) for c in stats.columns if c not in key})
    psi = population_stability_index(window, bins, 4 if digits is not None else None, key)
    lengths = rows.groupBy(*key).agg(F.count("*").alias("points"))
    return (
        lengths.join(stats, key, "left").join(psi, key, "left")
        .withColumn("baseline_days", F.lit(baseline_rows)).withColumn("recent_days", F.lit(recent_rows))
        .withColumn("insufficient_history", F.col("points") < need)
    )
