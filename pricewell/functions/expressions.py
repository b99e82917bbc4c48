"""Scalar expressions over price records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def rounded(col: Column, digits: int | None) -> Column:
    """Presentation rounding; ``None`` keeps full precision."""
    return col if digits is None else F.round(col, digits)


def variation(col: Column | str) -> Column:
    """Coefficient of variation (sample standard deviation over mean), NULL for mean 0."""
    return F.try_divide(F.stddev_samp(_c(col)), F.avg(_c(col)))


def price_bucket(col: Column | str, width: int = 1000) -> Column:
    return F.floor(_c(col) / width).cast("double") * width


def years_covered(first: Column, last: Column, digits: int | None = 1) -> Column:
    return rounded(F.datediff(last, first) / F.lit(365.25), digits)


def calendar_columns(day: Column | str = "arrival_date") -> dict[str, Column]:
    return {"year": F.year(_c(day)), "month": F.month(_c(day))}


def thousands(col: Column | str) -> Column:
    return _c(col) / 1000


def percent_of(part: Column | str, total: Column | str) -> Column:
    return F.try_divide(_c(part), _c(total)) * 100


def season_band(median: Column | str, spread: Column | str, factor: float = 0.3) -> dict[str, Column]:
    """Median plus and minus a share of the standard deviation."""
    return {
        "band_low": _c(median) - _c(spread) * factor,
        "band_high": _c(median) + _c(spread) * factor,
    }


def natural_log(col: Column | str) -> Column:
    """NULL for values that are not positive."""
    return F.ln(_c(col))
