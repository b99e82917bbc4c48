"""Reading price records: partitioned tree, yearly files, raw records, cleaned CSV.

Credentials never appear here; remote stores take them from the Hadoop configuration.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricewell.functions.expressions import calendar_columns
from pricewell.functions.names import with_normal_names
from pricewell.plans.session import new_path
from pricewell.schema import CLEAN_CSV, PRICES, RAW_PRICES, require_columns

# The years covered by default and the name of a yearly file.
FIRST_YEAR, LAST_YEAR = 2016, 2026
YEAR_FILE = "data_{year}.parquet"

NAME_COLUMNS = ("commodity", "state")
#: What one price record is about; a later batch replaces all rows that it has of a key.
RECORD_KEY = ("state", "district", "market", "commodity", "variety", "grade", "arrival_date")
#: Order of the rows in the tree.
TREE_ORDER = ("year", "commodity", "state", "arrival_date", "market")
CORRUPT = "_corrupt_record"


def year_paths(base: str, first: int = FIRST_YEAR, last: int = LAST_YEAR) -> list[str]:
    """Paths of the yearly files, first and last year included."""
    return [f"{base.rstrip('/')}/{YEAR_FILE.format(year=y)}" for y in range(first, last + 1)]


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """Prices under ``root/year=YYYY/``; a filter on ``year`` prunes folders."""
    try:
        df = spark.read.schema(PRICES).option("basePath", root).parquet(root)
        empty = df.isEmpty()
    except AnalysisException as e:
        raise FileNotFoundError(f"no price folder at {root}; run the ingest first") from e
    if empty:
        raise FileNotFoundError(f"no price files under {root}; run the ingest first")
    return require_columns(df.select(*PRICES.fieldNames()), PRICES)


def read_year_files(
    spark: SparkSession, base: str, first: int = FIRST_YEAR, last: int = LAST_YEAR
) -> DataFrame:
    """Prices from one file per year; only the files of the wanted years are opened."""
    try:
        df = spark.read.schema(PRICES).parquet(*year_paths(base, first, last))
    except AnalysisException as e:
        raise FileNotFoundError(f"a yearly file {first}-{last} is missing under {base}") from e
    return df.select(*PRICES.fieldNames())


def open_prices(
    spark: SparkSession,
    source: str = "auto",
    tree: str | None = None,
    files: str | None = None,
    years: tuple[int, int] | None = None,
) -> DataFrame:
    """``files`` reads yearly files, ``tree`` the partitioned tree; ``auto`` prefers files.

    Without ``years`` the whole tree is read; yearly files need a range.
    """
    if source not in {"auto", "files", "tree"}:
        raise ValueError("source must be 'auto', 'files' or 'tree'")
    if source == "files" or (source == "auto" and files):
        if not files:
            raise ValueError("no location of the yearly files given")
        if years is None:
            raise ValueError("yearly files need a range of years")
        return read_year_files(spark, files, *years)
    if not tree:
        raise ValueError("no location of the price tree given")
    prices = read_tree(spark, tree)
    return prices if years is None else prices.where(F.col("year").between(*years))


def clean_records(raw: DataFrame, *keep: str) -> DataFrame:
    """Raw records with normal names and the derived ``year`` and ``month``, and the columns ``keep``."""
    out = with_normal_names(require_columns(raw, RAW_PRICES), *NAME_COLUMNS)
    return out.withColumns(calendar_columns()).select(*PRICES.fieldNames(), *keep)


def raw_reader(reader, fmt: str):
    """A batch or stream reader of raw records; lines that cannot be read keep their text in ``CORRUPT``."""
    if fmt not in {"json", "csv"}:
        raise ValueError("fmt must be 'json' or 'csv'")
    reader = reader.schema(T.StructType([*RAW_PRICES.fields, T.StructField(CORRUPT, T.StringType())]))
    return reader.format(fmt).option("columnNameOfCorruptRecord", CORRUPT).option("header", True)


def read_raw(spark: SparkSession, path: str | list[str], fmt: str = "json") -> DataFrame:
    """Raw market records as JSON lines or CSV with a header, with unreadable lines in ``CORRUPT``."""
    return raw_reader(spark.read, fmt).load(path)


def write_tree(prices: DataFrame, root: str, mode: str = "overwrite", sort_by: Iterable[str] | None = None) -> None:
    """Write prices partitioned by year.

    Rows are ranged by year, then by names and date, so every task writes few files, a
    year or a crop that holds much of the data is spread over many tasks, and a filter on
    a name skips most row groups.  ``overwrite`` replaces the years that are present in
    ``prices`` and leaves others as they are.
    """
    order = list(sort_by or TREE_ORDER)
    write_ranged(prices.repartitionByRange(*order), root, mode, order)


def write_ranged(ranged: DataFrame, root: str, mode: str, order: Iterable[str]) -> None:
    """Sort each range and write it by year."""
    (
        ranged.sortWithinPartitions(*order)
        .write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(root)
    )


def merged(held: DataFrame, batch: DataFrame) -> DataFrame:
    """All rows of ``batch``, and those of ``held`` of whose ``RECORD_KEY`` it has none, ranged by ``TREE_ORDER``.

    The ranges follow columns of the key (the year is that of the date), so rows of one key meet in the shuffle that
    the tree needs anyway.
    """
    both = held.withColumn("fresh", F.lit(False)).unionByName(batch.withColumn("fresh", F.lit(True)))
    key = [*TREE_ORDER, *(c for c in RECORD_KEY if c not in TREE_ORDER)]
    replaced = F.max("fresh").over(Window.partitionBy(*key))
    return (
        both.repartitionByRange(*TREE_ORDER).withColumn("replaced", replaced)
        .where(F.col("fresh") | ~F.col("replaced")).drop("fresh", "replaced")
    )


def ingest(
    spark: SparkSession, raw_path: str | list[str], root: str, fmt: str = "json", mode: str = "merge",
    quarantine: str | None = None,
) -> None:
    """Raw records to the partitioned tree; see ``ingest_rows``."""
    ingest_rows(read_raw(spark, raw_path, fmt), root, mode, quarantine)


def ingest_rows(raw: DataFrame, root: str, mode: str = "merge", quarantine: str | None = None) -> None:
    """Add a batch as read by ``read_raw`` to the tree.

    ``merge`` keeps what the touched years hold besides: rows of the batch replace those of their
    ``RECORD_KEY``, so a batch may come twice.  ``overwrite`` replaces the years of the batch, ``append`` only adds.
    Lines that cannot be read and records without a date go to ``quarantine`` (default: beside
    ``root``) as ``record``, ``reason`` and ``noted_at``.  The batch, read and cleaned, is written down first, and so
    is what the touched years hold: each is read again without the raw files or the folders that are replaced.
    """
    spark = raw.sparkSession
    names = RAW_PRICES.fieldNames()
    staged = new_path(spark, "ingest-batch")
    broken, undated = F.col(CORRUPT).isNotNull(), F.col("arrival_date").isNull()
    noted = raw.select(
        *names, F.when(broken, "unreadable").when(undated, "no arrival_date").alias("reason"),
        F.when(broken, F.col(CORRUPT)).when(undated, F.to_json(F.struct(*names))).alias("record"))
    clean_records(noted, "reason", "record").write.parquet(staged)
    batch = spark.read.parquet(staged)
    fit = F.col("reason").isNull()
    good = batch.where(fit).select(*PRICES.fieldNames())
    # one row per calendar year and reason
    found = batch.select("reason", F.when(fit, F.col("year")).alias("year")).distinct().collect()
    years = [r["year"] for r in found if r["reason"] is None]
    if any(r["reason"] for r in found):
        batch.where(~fit).select("record", "reason", F.current_timestamp().alias("noted_at")).write.mode("append").parquet(
            quarantine or quarantine_path(root))
    if mode != "merge":
        write_tree(good, root, mode)
        return
    if not years:
        return
    try:
        held = spark.read.schema(PRICES).option("basePath", root).parquet(root).where(F.col("year").isin(years))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        write_tree(good, root)
        return
    kept = new_path(spark, "ingest-held")
    held.select(*PRICES.fieldNames()).write.parquet(kept)
    write_ranged(merged(spark.read.schema(PRICES).parquet(kept), good), root, "overwrite", TREE_ORDER)


def quarantine_path(root: str) -> str:
    return f"{root.rstrip('/')}-quarantine"


def read_clean_csv(spark: SparkSession, path: str) -> DataFrame:
    """Cleaned flat prices ``crop, state, arrival_date, modal_price``."""
    return spark.read.schema(CLEAN_CSV).option("header", True).csv(path)
