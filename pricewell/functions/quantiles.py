"""Exact grouped percentiles and statistics from one frequency table.

``aggregate_with_percentiles`` counts rows per (keys, value) with map-side combining, so a group with a third of
all rows is shuffled as its distinct values only.  Values fall into narrow bands; running counts over the bands of a
group (bounded by the range of numbers, not by rows) tell which bands hold the wanted ranks, and only the values of
those bands are ordered.  Both levels read the same shuffle, so the input is scanned once, and planning runs no job.

``grouped_percentiles`` is for groups whose values are few by meaning, as the prices of one series and day: Spark's
``percentile`` holds a group's distinct values in one buffer, combined map-side.

Spreads are taken from the centres of bands: their variance is right to about 1e-16 * (value / 4096)^2.

Defined cases: NULL and NaN values count as rows, but take no part in anything else; a group without values gets
NULL percentiles; NULL keys are groups; without keys there is one row, also for an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BANDS_PER_E_FOLD = 4096


def grouped_percentiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Percentiles of ``value`` per group of few distinct values, in one aggregate."""
    picked = F.percentile(value, [float(p) for p in probs.values()])
    out = df.groupBy(*keys).agg(picked.alias("_pct"))
    return out.select(*keys, *[F.col("_pct")[i].alias(name) for i, name in enumerate(probs)])


def aggregate_with_percentiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probs: dict[str, float],
    stats: dict[str, str] | None = None,
    distinct: dict[str, str] | None = None,
    extremes: dict[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """One row per group with exact percentiles and statistics of ``value``.

    ``probs`` maps output names to probabilities, ``stats`` to one of ``rows, low, high, mean, std, cv``, ``distinct``
    to columns whose distinct values are counted, ``extremes`` to ``("min" | "max", column)``.
    """
    stats, distinct, extremes = stats or {}, distinct or {}, extremes or {}
    ks = [f"_k{i}" for i in range(len(keys))] or ["_k0"]
    spans = list(dict.fromkeys(column for _, column in extremes.values()))
    number = F.col(value).cast("double")
    rows = df.select(
        *([F.col(k).alias(a) for k, a in zip(keys, ks)] if keys else [F.lit(0).alias("_k0")]),
        F.when(~F.isnan(number), number).alias("_v"),
        *[F.col(c).alias(f"_d{i}") for i, c in enumerate(distinct.values())],
        *[F.col(c).alias(f"_x{i}") for i, c in enumerate(spans)],
    ).withColumn("_band", _band(F.col("_v")))
    table = _frequencies(rows, ks, len(distinct), len(spans))
    out = _picked(table, _wanted(table, ks, probs), ks)

    names = {"rows": F.col("_rows"), "low": F.col("_low"), "high": F.col("_high"), "mean": F.col("_mean"),
             "std": F.col("_std"), "cv": F.try_divide("_std", "_mean")}
    out = out.select(
        *ks, *[names[kind].alias(name) for name, kind in stats.items()],
        *[_interpolated(p).alias(name) for name, p in probs.items()],
    )
    if distinct or extremes:
        more = table.groupBy(*[F.col(k).alias(f"_o{k}") for k in ks]).agg(
            # The count is read so that this branch keeps the shuffle of the others.
            *[F.countDistinct(F.when(F.col("_n") > 0, F.col(f"_d{i}"))).alias(name) for i, name in enumerate(distinct)],
            *[(F.min if kind == "min" else F.max)(F.when(F.col("_n") > 0, F.col(f"_x{spans.index(c)}"))).alias(name)
              for name, (kind, c) in extremes.items()],
        )
        out = out.join(more, _same([(k, f"_o{k}") for k in ks]), "inner")
    found = [*stats, *distinct, *extremes, *probs]
    if keys:
        return out.select(*[F.col(a).alias(k) for k, a in zip(keys, ks)], *found)
    counts = {name for name, kind in stats.items() if kind == "rows"} | set(distinct)
    whole = out.agg(*[F.max(c).alias(c) for c in found])
    return whole.select(*[F.coalesce(c, F.lit(0)).alias(c) if c in counts else c for c in found])


def _same(pairs: list[tuple[str, str]]) -> Column:
    cond = F.lit(True)
    for a, b in pairs:
        cond = cond & F.col(a).eqNullSafe(F.col(b))
    return cond


def _band(v: Column) -> Column:
    """A narrow, order-preserving band (about 1/4096 of the value wide)."""
    return F.signum(v) * F.floor(F.log1p(F.abs(v)) * BANDS_PER_E_FOLD)


def _centre(band: Column) -> Column:
    """A number in or beside the band, to take differences from."""
    return F.signum(band) * F.expm1(F.abs(band) / BANDS_PER_E_FOLD)


def _frequencies(rows: DataFrame, ks: list[str], n_distinct: int, n_spans: int) -> DataFrame:
    """Rows per (keys, band, value), and per combination of the columns with more to count, those with ``_c`` 0."""
    ds, xs = [f"_d{i}" for i in range(n_distinct)], [f"_x{i}" for i in range(n_spans)]
    if not ds and not xs:
        return rows.groupBy(*ks, "_band", "_v").agg(F.count("*").alias("_c"))
    sets = [[*ks, "_band", "_v"], *[[*ks, *names] for names in (ds, xs) if names]]
    table = rows.groupingSets(sets, *ks, *ds, *xs, "_band", "_v").agg(
        F.count("*").alias("_n"), F.grouping("_v").alias("_combined"))
    return table.withColumn("_c", F.when(F.col("_combined") == 0, F.col("_n")).otherwise(0))


def _wanted(table: DataFrame, ks: list[str], probs: dict[str, float]) -> DataFrame:
    """The bands that hold wanted ranks, with the statistics of their group; one row for a group without values."""
    v, c, d = F.col("_v"), F.col("_c"), F.col("_v") - _centre(F.col("_band"))
    bands = table.groupBy(*ks, "_band").agg(
        F.sum(c).alias("_all"), F.min(v).alias("_min"), F.max(v).alias("_max"), F.sum(c * v).alias("_s"),
        F.sum(c * d).alias("_d"), F.sum(c * d * d).alias("_dd"),
    ).withColumn("_c", F.when(F.col("_band").isNotNull(), F.col("_all")).otherwise(0))
    group = Window.partitionBy(*ks)
    order = group.orderBy(F.asc_nulls_last("_band"))
    bands = bands.withColumns({
        "_upto": F.sum("_c").over(order), "_place": F.row_number().over(order),
        "_total": F.sum("_c").over(group), "_rows": F.sum("_all").over(group),
        "_low": F.min("_min").over(group), "_high": F.max("_max").over(group),
        "_mean": F.try_divide(F.sum("_s").over(group), F.sum("_c").over(group)),
    }).withColumn("_before", F.col("_upto") - F.col("_c"))
    # Squares are taken from the band's centre, then between bands, so that nothing large cancels.
    own = F.greatest(F.lit(0.0), F.col("_dd") - F.try_divide(F.col("_d") * F.col("_d"), F.col("_c")))
    away = _centre(F.col("_band")) + F.try_divide("_d", "_c") - F.col("_mean")
    bands = bands.withColumn("_m2", F.sum(own + F.col("_c") * away * away).over(group))
    spread = F.when(F.col("_low") == F.col("_high"), 0.0).otherwise(F.sqrt(F.col("_m2") / (F.col("_total") - 1)))
    ranks = []
    for p in probs.values():
        position = (F.col("_total") - 1) * F.lit(float(p))
        ranks += [F.floor(position), F.ceil(position)]
    here = F.filter(F.array_distinct(F.array(*ranks)), lambda r: (r >= F.col("_before")) & (r < F.col("_upto")))
    return bands.withColumns({"_want": here, "_std": F.when(F.col("_total") > 1, spread)}).where(
        (F.size("_want") > 0) | ((F.col("_total") == 0) & (F.col("_place") == 1))
    ).select(
        *[F.col(k).alias(f"_w{k}") for k in [*ks, "_band"]],
        "_want", "_before", "_total", "_rows", "_low", "_high", "_mean", "_std",
    )


def _picked(table: DataFrame, wanted: DataFrame, ks: list[str]) -> DataFrame:
    """Per group, its statistics and ``_at``: the values at the wanted ranks."""
    carried = ["_total", "_rows", "_low", "_high", "_mean", "_std"]
    on = [*ks, "_band"]
    met = table.select(*on, "_v", "_c").join(wanted, _same([(k, f"_w{k}") for k in on]), "inner")
    by_value = Window.partitionBy(*on).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    met = met.withColumn("_upto", F.col("_before") + F.sum("_c").over(by_value))
    here = F.filter("_want", lambda r: (r >= F.col("_upto") - F.col("_c")) & (r < F.col("_upto")))
    met = met.withColumn("_here", here).where((F.size("_here") > 0) | (F.col("_total") == 0))
    ranked = met.select(*ks, "_v", *carried, F.explode_outer("_here").alias("_rank"))
    entry = F.when(F.col("_rank").isNotNull(), F.struct("_rank", "_v"))
    return ranked.groupBy(*ks).agg(
        *[F.first(c).alias(c) for c in carried], F.map_from_entries(F.collect_list(entry)).alias("_at")
    )


def _interpolated(p: float) -> Column:
    position = (F.col("_total") - 1) * F.lit(float(p))
    low, high = F.try_element_at("_at", F.floor(position)), F.try_element_at("_at", F.ceil(position))
    share = position - F.floor(position)
    return F.when(share == 0, low).otherwise((1 - share) * low + share * high)
