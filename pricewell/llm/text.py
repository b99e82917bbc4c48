"""Column helpers shared by the text operators."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewell.plans.session import new_path

#: Space and the five ASCII control characters that count as white space everywhere here.
ASCII_SPACE = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else unchanged; pure ASCII values take the faster ``lower``."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def word_count(text: Column) -> Column:
    """Number of words as long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def private(name: str) -> str:
    """A column name that no input can clash with."""
    return f"_{name}_{uuid.uuid4().hex[:8]}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later steps don't depend on lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_place(df: DataFrame, name: str, label: str = "rows") -> DataFrame:
    """``df`` with a string column ``name`` that tells each row from all others, however often it is computed.

    A table read straight from Parquet files has its rows' places in them, so no copy of it is needed; any
    other ``df`` is numbered and stored.
    """
    # Only in the scan itself does every row have a place of its own: above it, an explode repeats them.
    plan = df._jdf.queryExecution().analyzed()
    if plan.children().isEmpty() and plan.metadataOutput().nonEmpty() and "_metadata" not in df.columns:
        at = F.concat(F.md5("_metadata.file_path"), F.lit("#"), F.col("_metadata.row_index").cast("string"))
        try:
            return df.select("*", at.alias(name))
        except AnalysisException:
            pass  # not a Parquet table
    return stored(df.withColumn(name, F.monotonically_increasing_id().cast("string")), label)


def row_digest(columns: list[str], text: str = "text") -> Column:
    """A digest of these columns, so that rows with equal ones can stand for each other."""
    rest = [F.col("`" + c.replace("`", "``") + "`") for c in columns if c != text]
    parts = [F.coalesce(F.md5(F.col(text)), F.lit("null")), *([F.to_json(F.struct(*rest))] if rest else [])]
    return F.md5(F.concat(*parts))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
