"""Broadcast only what has been counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, rows: int, limit: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when the counted ``rows`` fit; otherwise leave Spark to shuffle."""
    return F.broadcast(df) if rows <= limit else df


def stacked(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of frames, shuffled by ``keys`` once.

    A later window or join on the key then does not depend on how each side of the union
    happened to be partitioned.  The frames are small: rows per series, not raw rows.
    """
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    width = int(out.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartition(width, *keys)
