"""Commodity and state names: normalising, matching, and what to show on a miss."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: ASCII names that are normal as they are: words of a capital and small letters, other signs, single blanks between.
#: Possessive, so that long texts are matched without recursion.
NORMAL = r"^(?! )(?:[A-Z][a-z]*(?![A-Za-z])|[!-@\[-`{-~]| (?! |$))*+\z"


def normalise_text(text: str) -> str:
    """Trim, title-case and collapse whitespace of a literal."""
    return re.sub(r"\s+", " ", text.strip().title())


def normalise_name(col: Column | str) -> Column:
    """The same for a column: a letter after a non-letter is a capital, others are small.

    ``initcap`` differs, since it only looks at blanks.  Names that are plainly normal are not taken apart.
    """
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.rlike(NORMAL), c).otherwise(normal_words(c))


def normal_words(c: Column) -> Column:
    """``normalise_name`` for any text."""
    trimmed = F.regexp_replace(c, r"^\s+|\s+$", "")
    words = F.split(F.lower(trimmed), r"(?<![\p{L}])(?=\p{L})")
    capitals = F.transform(
        words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))
    )
    return F.regexp_replace(F.array_join(capitals, ""), r"\s+", " ")


def with_normal_names(df: DataFrame, *names: str) -> DataFrame:
    """Normalise name columns once, at ingest, so that later filters are plain equalities."""
    return df.withColumns({n: normalise_name(n) for n in names})


def match_name(df: DataFrame, column: str, text: str | None) -> DataFrame:
    """Keep rows whose (ingest-normalised) name equals ``text``, as given or normalised; no text keeps all."""
    return df if text is None else df.where(F.col(column).isin(sorted({text, normalise_text(text)})))


def match_loosely(df: DataFrame, crop: str, state: str, crop_column: str = "crop") -> DataFrame:
    """Crop equal ignoring case and outer blanks; state contains the text, taken literally."""
    return df.where(
        (F.lower(F.trim(crop_column)) == crop.strip().lower())
        & F.lower("state").contains(state.strip().lower())
    )


def miss_report(df: DataFrame, crop: str, crop_column: str = "crop", max_states: int | None = None) -> dict[str, DataFrame]:
    """What to look at when a crop was not found: row count, crop names, states (the first ``max_states``)."""
    near = df.where(F.lower(crop_column).contains(crop.lower()))
    states = near.select("state").distinct().orderBy(F.asc_nulls_last("state"))
    return {
        "rows": near.agg(F.count("*").alias("matching_rows")),
        "crops": near.select(crop_column).distinct().orderBy(crop_column),
        "states": states if max_states is None else states.limit(max_states),
    }
