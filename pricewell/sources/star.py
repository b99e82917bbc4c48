"""Prices derived from the supplied star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def star_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as market records: part brand = commodity, supplier nation = state.

    Join strategies are left to Spark, which knows the file sizes.  The tables are joined to the lines one by one,
    since it takes a join of two small tables for a large one and would shuffle the lines to meet it.
    """
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    nation = read("nation").select("n_nationkey", "n_name")
    supplier = read("supplier").select("s_suppkey", "s_name", "s_nationkey")
    part = read("part").select("p_partkey", "p_brand", "p_type", "p_retailprice")
    lines = read("lineitem").select(
        "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate"
    )
    joined = (
        lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    )
    day = F.to_date("l_shipdate")
    return joined.select(
        F.col("n_name").alias("state"),
        F.concat("n_name", F.lit("-D"), (F.col("s_suppkey") % 4).cast("string")).alias("district"),
        F.col("s_name").alias("market"),
        F.col("p_brand").alias("commodity"),
        F.col("p_type").alias("variety"),
        F.col("l_returnflag").alias("grade"),
        day.alias("arrival_date"),
        F.col("p_retailprice").alias("min_price"),
        (F.col("p_retailprice") * 40).alias("max_price"),
        F.try_divide("l_extendedprice", "l_quantity").alias("modal_price"),
        F.year(day).alias("year"),
        F.month(day).alias("month"),
    )
