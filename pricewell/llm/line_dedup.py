"""Line dedup: keep each repeated line only in the largest document id that holds it.

A line's key is the line stripped of ASCII white space with A-Z lower-cased.  Keys of at least
``min_length`` code points found in at least ``min_documents`` documents lose their lines everywhere
but in the largest id.

Only hashes move: each line long enough gives (128-bit hash of its key, document, position), written
once.  Those rows are range-partitioned by hash and sorted by hash, document descending and position, so
that one pass over each run sees the first occurrence first.  Keys that hold over one in ``hot_share``
rows are few by that definition; they are counted by partial aggregates and their verdicts broadcast, so
that no task gets all rows of such a key.  The result per document is a bitmap of dropped lines in
64-line words without the zero words; text is never shuffled to find it.

Defined cases: null or empty text is one empty line; a null id is one document below all others; rows that
repeat an id are one document for counting and each keeps a bitmap of its own (by id and text hash);
a repeated row repeats its result; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewell.llm.text import ASCII_SPACE, ascii_lower, shuffle_width, stored


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _row_key(doc_id: str, text: str) -> list[Column]:
    return [F.col(doc_id).cast("long").alias("doc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("version")]


def dropped_lines(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text",
    min_length: int = 20, min_documents: int = 3, hot_share: int = 2000,
) -> DataFrame:
    """``doc, version, words``: a sparse bitmap of the dropped lines of each document that loses some.

    ``words`` is an array of (word, bits) in ascending order; bit b of word w is line 64 w + b.
    ``version`` is the hash of the text and tells rows with the same id apart.
    """
    spark = documents.sparkSession
    line = F.btrim(F.col("line"), F.lit(ASCII_SPACE))
    key = ascii_lower(F.col("line"))
    occurrences = stored(
        documents.select(*_row_key(doc_id, text), F.posexplode(_lines(F.col(text))).alias("pos", "line"))
        .select("doc", "version", "pos", line.alias("line"))
        .filter(F.char_length("line") >= min_length)
        .select("doc", "version", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")),
        "lines",
    )
    key_of = ["h1", "h2"]

    # Hot keys: at most hot_share of them, since each has over 1 / hot_share of all rows.
    total = occurrences.count()
    hot = occurrences.groupBy(*key_of).count().filter(F.col("count") * hot_share > total).select(*key_of)
    hot = stored(hot, "hot-lines")
    verdicts = (
        occurrences.join(F.broadcast(hot), key_of)
        .groupBy(*key_of, "doc").agg(F.lit(1).alias("one"))
        .groupBy(*key_of).agg(F.count("*").alias("docs"), F.max("doc").alias("keeper"))
    )
    verdicts = stored(verdicts.filter(F.col("docs") >= min_documents), "hot-verdicts")
    hot_drops = occurrences.join(F.broadcast(verdicts), key_of).filter(
        F.col("doc").isNull() | (F.col("doc") < F.col("keeper"))
    )

    # The rest: sorted runs of a range partition, first occurrence first.
    by_key = Window.partitionBy(*key_of).orderBy(F.col("doc").desc_nulls_last())
    whole = by_key.rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    run = (
        occurrences.join(F.broadcast(hot), key_of, "left_anti")
        .repartitionByRange(shuffle_width(spark), *key_of)
        .sortWithinPartitions(*key_of, F.col("doc").desc_nulls_last(), "pos")
    )
    drops = (
        run.withColumn("nth", F.dense_rank().over(by_key))
        .withColumn("docs", F.max("nth").over(whole))
        .filter((F.col("nth") > 1) & (F.col("docs") >= min_documents))
    )

    at = ["doc", "version"]
    bits = (
        drops.select(*at, "pos").unionAll(hot_drops.select(*at, "pos"))
        .repartition(shuffle_width(spark), *at)
        .groupBy(*at, F.shiftright("pos", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("bits"))
    )
    return bits.groupBy(*at).agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"))


def kept_lines(documents: DataFrame, drops: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``documents``: ``doc_id, lines`` (all) and ``kept`` (those that stay), as arrays."""
    named = drops.select(F.col("doc").alias("d"), F.col("version").alias("v"), "words")
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *_row_key(doc_id, text))
    joined = docs.join(named, F.col("doc").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v")), "left")

    def gap(word: Column, i: Column) -> Column:
        before = F.when(i == 0, -1).otherwise(F.get(F.col("words"), i - 1)["word"])
        return F.concat(F.array_repeat(F.lit(0).cast("long"), word["word"] - before - 1), F.array(word["bits"]))

    # One word per 64 lines again, so that each line's bit is found by its place.
    full = F.flatten(F.transform("words", gap))
    dense = joined.select("doc_id", _lines(F.col("text")).alias("lines"), full.alias("full"))
    stays = F.filter(
        "lines",
        lambda _, i: F.getbit(F.coalesce(F.get(F.col("full"), F.shiftright(i, 6)), F.lit(0).cast("long")),
                              i.bitwiseAND(F.lit(63))) == 0,
    )
    return dense.select("doc_id", "lines", F.when(F.col("full").isNull(), F.col("lines")).otherwise(stays).alias("kept"))
