"""Rendezvous hashing of stable record keys over weighted shards.

Every (key, shard) pair has a score that depends on nothing else, and a record lives in the shard
with the best one.  A further shard can only win records for itself, so growing from n to n + 1
equal shards moves about one record in n + 1 and none between old shards.

The hash is MD5 of ``key:shard`` (stable between engines and versions).  With u its first 52 bits as
a number in (0, 1), the score is ``-ln(u) / weight`` and the least wins: shards then receive records in
proportion to their weights.  Everything is a projection: no shuffle, no skew.

Defined cases: a null key is the key ``null`` (all such records share a shard); repeated rows go to
the same shard; equal scores go to the smaller shard number; an empty table gives an empty result.
Other columns of the input stay as they are; those named like a result column give way to it (the key
must not be one of them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewell.llm.text import private, row_digest, shuffle_width, stored, with_place


def rendezvous_shard(key: Column, weights: list[float]) -> Column:
    """The shard (from 0) of a record key, as int; weight 0 closes a shard."""
    open_shards = [(i, float(w)) for i, w in enumerate(weights) if w > 0]
    if not open_shards or min(weights) < 0:
        raise ValueError("weights must not be negative, and one must be positive")
    name = F.coalesce(key.cast("string"), F.lit("null"))

    def score(shard: int, weight: float) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat(name, F.lit(f":{shard}"))), 1, 13), 16, 10).cast("double")
        return F.struct((-F.ln((bits + 0.5) / 2.0**52) / weight).alias("s"), F.lit(shard).alias("shard"))

    scores = [score(i, w) for i, w in open_shards]
    return (scores[0] if len(scores) == 1 else F.least(*scores))["shard"]


def number_within(df: DataFrame, group: str, order: list[str], slot: str = "slot") -> DataFrame:
    """``df`` with a gapless number from 0 within each group, in the given order.

    A group may hold most of the rows, so no task ever owns a group: rows are range-partitioned by
    (group, order) and written, each keeps its place in its partition, and the partitions' counts,
    one row per partition and group, give the offsets.
    """
    spark = df.sparkSession
    part, place, before, same, at = (private(n) for n in ("part", "place", "before", "same", "at"))
    run = df.repartitionByRange(shuffle_width(spark), group, *order).sortWithinPartitions(group, *order)
    run = stored(
        run.withColumn(part, F.spark_partition_id())
        .withColumn(place, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "numbered",
    )
    # At most partitions + groups rows, as a partition holds a range: bounded by the shuffle's width.
    runs = run.groupBy(group, part).agg(F.count("*").alias("_n"), F.min(place).alias("_first"))
    earlier = F.sum("_n").over(Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    offsets = runs.select(
        F.col(group).alias(same), F.col(part).alias(at),
        (F.coalesce(earlier, F.lit(0)) - F.col("_first")).alias(before),
    )
    joined = run.join(F.broadcast(offsets), F.col(group).eqNullSafe(F.col(same)) & (F.col(part) == F.col(at)))
    return joined.withColumn(slot, F.col(place) + F.col(before)).drop(part, place, before, same, at)


def assign_shards(
    df: DataFrame, key: str, shards: int = 24, weights: list[float] | None = None, order: list[str] = (),
) -> DataFrame:
    """``df`` plus ``shard``, ``slot`` (gapless in the shard, in key order) and ``grown_shard``.

    ``grown_shard`` is the place with one more shard, of the mean weight.  ``order`` names further
    columns that make the order of equal keys definite.
    """
    weights = list(weights or [1.0] * shards)
    own = ["shard", "grown_shard", "slot"]
    if key in own:
        raise ValueError(f"the key must not be named {key!r}")
    placed = df.drop(*own).select(
        "*",
        rendezvous_shard(F.col(key), weights).alias("shard"),
        rendezvous_shard(F.col(key), [*weights, sum(weights) / len(weights)]).alias("grown_shard"),
    )
    return number_within(placed, "shard", [key, *order])


def shard_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 24, weights: list[float] | None = None,
) -> DataFrame:
    """``assign_shards`` for rows with long texts: places are found on narrow rows, and texts are shuffled once.

    Equal keys, null ones too, are ordered by a digest of the row, so only equal rows can change places, and rows without a
    key spread over many ranges.
    """
    place = private("place")
    placed = with_place(docs, place, "shard-rows")
    narrow = stored(
        placed.select(F.col(key).alias("key"), row_digest(docs.columns, text).alias("row"), F.col(place).alias("place")),
        "shard-keys",
    )
    own = ["shard", "slot", "grown_shard"]
    found = assign_shards(narrow, "key", shards, weights, ["row", "place"]).select(F.col("place").alias(place), *own)
    return placed.drop(*own).join(found, place).drop(place)
