"""Mix sources to target weights along a low-discrepancy schedule of equal-token blocks.

Each source's documents, in an order shuffled by a keyed hash, are one ring of tokens that is cut into
blocks of ``block`` tokens.  Slot t of the schedule is the t-th golden-ratio point; the cumulative
shares of the sources map it to a source, and its rank among that source's slots names the block that
it takes (around the ring again for a second epoch).  Any stretch of the schedule has all sources near their
shares.  The sequence ends when each source has its blocks; the last one is cut to the target, so the tokens
taken are the targets rounded, and no source goes round more than ``most`` times.  ``pieces`` gives the mix itself in
this order; ``mix`` sums it up per document, and ``mixed`` has whole documents in the order of their first slots.

A source may hold a third of all rows, so no task owns one: places on the ring are prefix sums over ranges
of the order, one a partition, ranks are prefix sums over chunks of 65,536 slots, and documents meet slots on
(source, block).  Only the sources' totals go to the driver; more than ``MAX_SOURCES`` is an error.

Defined cases: null text has size 0; documents of size 0 take 0; the null source comes last; equal hashes
are ordered by key, then size; rows with a null key are shuffled by their text; repeated rows are rows of their own;
no tokens at all means targets of 0; an empty table gives an empty result; other columns are not read (``mixed`` keeps
them).  ``mixed`` shuffles by key and text and tells equal rows apart by a number, so its result doesn't depend on how the rows
lie in files.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewell.llm.text import private, row_digest, shuffle_width, stored, with_place, word_count
from pricewell.plans.session import ship_package

#: The golden ratio's fraction in 64-bit fixed point.
GOLDEN = np.uint64(11400714819323198485)
CHUNK = 1 << 16
#: Copies of one row that a task numbers at once.
COPY_ROWS = 1 << 16
MAX_SOURCES = 100_000
WEIGHTS = (3, 1, 2)


def targets(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Shares of ``share * sum(sizes)`` by weight, none above ``most`` times its size; excess goes on by weight."""
    left = share * sum(sizes)
    order = sorted(range(len(sizes)), key=lambda i: (most * sizes[i] / weights[i], i))
    weight_left = sum(weights)
    out = [0.0] * len(sizes)
    for place, i in enumerate(order):
        rate = left / weight_left
        if rate * weights[i] <= most * sizes[i]:
            for j in order[place:]:
                out[j] = rate * weights[j]
            return out
        out[i] = float(most * sizes[i])
        left -= out[i]
        weight_left -= weights[i]
    return out


def shuffle_key(key: Column, seed: str) -> Column:
    """60 bits of the MD5 of seed and key."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def _ring(rows: DataFrame) -> DataFrame:
    """``rows`` plus ``begin``: where a row's tokens begin on its source's ring, by ``h``, ``key`` and ``size``.

    The ring is cut by ranges of all three, so equal hashes are no hot task.
    """
    order = ["h", "key", "size"]
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(shuffle_width(spark), "k", *order)
    ranged = stored(ranged.withColumn("range", F.spark_partition_id()), "ring")
    # At most partitions + sources rows, as a partition is one range.
    sums = ranged.groupBy("k", "range").agg(F.sum("size").alias("tokens"))
    earlier = Window.partitionBy("k").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("k", "range", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("k", "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(F.broadcast(starts), ["k", "range"])
    return placed.withColumn("begin", F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))


def schedule(spark, ranks: list[int]) -> DataFrame:
    """``slot, k, rank``: the order in which ``ranks[k]`` blocks of each source k are taken."""
    ship_package(spark)
    total = sum(ranks)
    schema = "slot long, k int, rank long"
    if not total:
        return spark.createDataFrame([], schema)
    quota = np.array(ranks, dtype=np.int64)
    # Upper ends of the sources' shares in 64-bit fixed point; exact integers, so that no source of 0 is met.
    ends, run = [], 0
    for r in ranks:
        run += r
        ends.append(min((run << 64) // total, (1 << 64) - 1))
    ends = np.array(ends, dtype=np.uint64)
    last = int(np.flatnonzero(quota)[-1])

    def sources(chunk: int) -> np.ndarray:
        slots = np.arange(chunk * CHUNK, min(total, (chunk + 1) * CHUNK), dtype=np.uint64)
        return np.minimum(np.searchsorted(ends, slots * GOLDEN, side="right"), last)

    def count(batches):
        for batch in batches:
            for chunk in batch.column(0).to_pylist():
                met, times = np.unique(sources(chunk), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk] * len(met), pa.int64()), pa.array(met, pa.int32()), pa.array(times, pa.int64())],
                    ["chunk", "k", "n"],
                )

    chunks = spark.range(-(-total // CHUNK)).withColumnRenamed("id", "chunk")
    counts = stored(chunks.mapInArrow(count, "chunk long, k int, n long"), "slot-counts")
    earlier = Window.partitionBy("k").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    lists = before.groupBy("chunk").agg(F.collect_list("k").alias("ks"), F.collect_list("before").alias("befores"))

    def expand(batches):
        for batch in batches:
            for chunk, ks, befores in zip(*(c.to_pylist() for c in batch.columns)):
                k = sources(chunk)
                base = np.zeros(len(quota), dtype=np.int64)
                base[ks] = befores
                order = np.argsort(k, kind="stable")
                sorted_k = k[order]
                rank = np.arange(len(k)) - np.searchsorted(sorted_k, sorted_k) + base[sorted_k]
                good = rank < quota[sorted_k]
                slot = chunk * CHUNK + order[good]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slot), pa.array(sorted_k[good], pa.int32()), pa.array(rank[good])], ["slot", "k", "rank"]
                )

    main = lists.select("chunk", "ks", "befores").mapInArrow(expand, schema)
    # A source's count is off its share by a few slots; missing ranks follow at the end.
    met = {r["k"]: r["n"] for r in counts.groupBy("k").agg(F.sum("n").alias("n")).collect()}
    short, at = [], total
    for k, r in enumerate(ranks):
        if met.get(k, 0) < r:
            short.append((k, met.get(k, 0), r, at))
            at += r - met.get(k, 0)
    if not short:
        return main
    tail = spark.createDataFrame(short, "k int, low long, high long, at long")
    tail = tail.select("k", "low", "at", F.explode(F.sequence(F.col("low"), F.col("high") - 1)).alias("rank"))
    return main.unionAll(tail.select((F.col("at") + F.col("rank") - F.col("low")).alias("slot"), "k", "rank"))


def _sized(documents: DataFrame, key: str, text: str, source: str, seed: str) -> DataFrame:
    """``key, source, size, h`` of each document."""
    name = F.when(F.col(key).isNull(), F.concat(F.lit("null:"), F.md5(F.col(text)))).otherwise(F.col(key).cast("string"))
    return documents.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"),
                            word_count(F.col(text)).alias("size"), shuffle_key(name, seed).alias("h"))


def _dealt(
    rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = 256,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parts of ``_sized`` rows with the slots that take them and how many ``tokens``; sources; rows of size 0."""
    spark = rows.sparkSession
    rows = stored(rows, "sizes")
    totals = rows.groupBy("source").agg(F.sum("size").alias("size"))
    totals = totals.limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in totals]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share, most)
    take = [math.floor(t + 0.5) for t in goal]
    blocks = [-(-s // block) for s in sizes]
    ranks = [(c // s) * b + -(-(c % s) // block) if s else 0 for c, s, b in zip(take, sizes, blocks)]
    names = spark.createDataFrame(
        [(i, r["source"], r["size"], g, c, b) for i, (r, g, c, b) in enumerate(zip(totals, goal, take, blocks))],
        "k int, name string, source_size long, target double, take long, blocks long",
    )
    named = rows.join(F.broadcast(names), rows["source"].eqNullSafe(names["name"]))
    empty = named.filter("size = 0").select("key", "size", "source_size", "target")
    placed = _ring(named.filter("size > 0").select("key", "size", "h", "k"))
    parts = placed.select(
        "key", "k", "size", "begin",
        F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.col("size") - 1) / block)))
        .alias("block"),
    )
    slots = schedule(spark, ranks).join(F.broadcast(names), "k").select(
        "k", "slot", (F.col("rank") % F.col("blocks")).alias("block"),
        F.floor(F.col("rank") / F.col("blocks")).alias("turn"),
        # Tokens that the source gives before this slot, and where the slot ends on the ring.
        (F.col("take") - F.floor(F.col("rank") / F.col("blocks")) * F.col("source_size")).alias("until"),
    )
    ends = F.least((F.col("block") + 1) * block, "until", F.col("begin") + F.col("size"))
    # A block that no slot takes has no ``until``; least() would pass over that null.
    overlap = F.when(F.col("until").isNotNull(), F.greatest(F.lit(0), ends - F.greatest("begin", F.col("block") * block)))
    dealt = parts.join(slots, ["k", "block"], "left").withColumn("tokens", F.coalesce(overlap, F.lit(0)).cast("long"))
    return dealt.withColumn("from", F.greatest("begin", F.col("block") * block) - F.col("begin")), names, empty


def mix(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix",
        **options) -> DataFrame:
    """Per row: ``key, size, source_size, target`` (its source's), ``taken`` (tokens, repeats counted) and ``slots``.

    ``slots`` has the first slot of each time that the ring comes to the row, in order.
    """
    return _mix(_sized(documents, key, text, source, seed), **options)


def _mix(rows: DataFrame, most: float = 2.0, **options) -> DataFrame:
    dealt, names, empty = _dealt(rows, most=most, **options)
    columns = ["key", "size", "source_size", "target"]
    # No source goes round more than ``most`` times, so these are few.
    firsts = [F.min(F.when((F.col("tokens") > 0) & (F.col("turn") == t), F.col("slot"))) for t in range(math.ceil(most))]
    taken = (
        dealt.groupBy("key", "k", "size", "begin")
        .agg(F.sum("tokens").alias("taken"), F.array_compact(F.array(*firsts)).alias("slots"))
        .join(F.broadcast(names), "k")
    )
    none = empty.select(*columns, F.lit(0).cast("long").alias("taken"), F.array().cast("array<long>").alias("slots"))
    return taken.select(*columns, "taken", "slots").unionAll(none)


def pieces(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix",
           **options) -> DataFrame:
    """The mix in its order: ``slot, key, from, to``, the tokens (from 0, without the last) that each slot takes."""
    dealt, _, _ = _dealt(_sized(documents, key, text, source, seed), **options)
    taken = dealt.filter("tokens > 0").orderBy("slot", "begin", "key")
    return taken.select("slot", "key", "from", (F.col("from") + F.col("tokens")).alias("to"))


def mixed(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
          slot: str | None = None, ordered: bool = True, seed: str = "mix", **options) -> DataFrame:
    """The rows of ``documents`` in as many whole copies as the mix takes of them, nearest, in schedule order.

    A copy stands at the first slot that takes from it, which goes into the column ``slot``, if named.  Without
    ``ordered`` each partition is in schedule order for itself, which saves a second shuffle of the texts.
    """
    place, at, copy = (private(n) for n in ("place", "slot", "copy"))
    placed = with_place(documents, place, "mix-rows")
    rows = stored(
        placed.select(F.col(place).alias("place"), row_digest(documents.columns, text).alias("row"),
                      row_digest([key, text], text).alias("name"), F.col(source).cast("string").alias("source"),
                      word_count(F.col(text)).alias("size")),
        "mix-sizes",
    )
    # Equal rows stand for each other: one of them gives its text, and each copy is dealt with by its number.
    alike = rows.groupBy("row", "name", "source", "size").agg(F.count("*").alias("n"), F.min("place").alias("place"))
    low = F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(COPY_ROWS))).alias("low")
    runs = alike.select("row", "name", "source", "size", "n", low).repartition("row", "low")
    high = F.least(F.col("low") + COPY_ROWS, "n") - 1
    copies = runs.select("row", "name", "source", "size", F.explode(F.sequence(F.col("low"), high)).alias("copy"))
    h = shuffle_key(F.concat_ws("#", "name", "copy"), seed)
    dealt = _mix(
        copies.select(F.concat_ws("#", "row", "copy").alias("key"), "source", "size", h.alias("h")), **options
    )
    times = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    taken = dealt.filter("size > 0").select(
        F.substring("key", 1, 32).alias("row"), F.col("key").alias(copy),
        F.explode(F.slice("slots", F.lit(1), times)).alias(at),
    )
    where = taken.join(alike.select("row", F.col("place").alias(place)), "row").select(place, copy, at)
    each = placed.join(where, place)
    each = each.orderBy(at, copy) if ordered else each.sortWithinPartitions(at, copy)
    each = each.select(*documents.columns, at)
    return each.drop(at) if slot is None else each.withColumnRenamed(at, slot)
