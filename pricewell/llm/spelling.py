"""Spelling variants by a dictionary of trie-node pairs.

All words are held in two tries, one over the words and one over the reversed words, whose nodes are numbered.  A
prefix is then one integer, and so is a suffix.  Leaving out the letter at position i gives the pair (node of
what stands before, node of what stands behind), and the gap before position i gives the pair of its two sides.
Two words are one replaced letter apart if they share a pair of left-out letters, and one inserted letter apart if
a left-out letter of the longer meets a gap of the shorter; both are exact, so nothing is verified afterwards.

A pair of a left-out letter is held by at most one word per letter of the alphabet and a gap by one word, so the join
is a grouping on two integers whose groups are bounded by the alphabet; each group says how many neighbours its
words have there and which is best, and no word pairs are written.  Words are numbered by falling count (ties:
rising words), so the best is the least number.  In a run of one letter only its first place counts as left out
before a gap, or the same word would be met twice.

Numbering is a scan over sorted words in ranges of about ``RANGE_WORDS``.  A node that two ranges share is the prefix
of a cut between them, and is numbered by the first cut that has it; all others are numbered by their range.

Defined cases: null and empty texts have no words; a null id is the id ``null`` for ``alter``; repeated rows count
again; ties go to the word that is smaller in code points; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewell.llm.text import shuffle_width, stored
from pricewell.plans.session import ship_package

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Words per range of a trie, code points of a cut that are used, and words that a task counts before it hands them on.
RANGE_WORDS = 50_000
CUT_LENGTH = 64
FLUSH = 200_000
GAP, INSIDE_RUN, LEFT_OUT = range(3)

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def runs(text: str) -> Counter:
    """The letter runs of a text, A-Z lower-cased, with their counts."""
    return Counter(RUN.findall(text.encode().translate(_LOWER).decode()))


def word_counts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = 6,
                least_count: int = 5, alter: Callable | None = None) -> DataFrame:
    """``word, n`` of all words of ``least_length`` code points that occur ``least_count`` times.

    ``alter(doc_id)``, if given, returns a function from a run to the word that stands for it in that document.
    """
    ship_package(documents.sparkSession)

    def flushed(counts: Counter) -> pa.RecordBatch:
        long = {w: n for w, n in counts.items() if len(w) >= least_length}
        return pa.RecordBatch.from_arrays(
            [pa.array(long.keys(), pa.string()), pa.array(long.values(), pa.int64())], ["word", "n"])

    def count(batches):
        counts: Counter = Counter()
        for batch in batches:
            for key, value in zip(batch.column(0), batch.column(1)):
                found = runs(value.as_py() or "")
                if alter is None:
                    counts.update(found)
                else:
                    change = alter(key.as_py())
                    for word, n in found.items():
                        counts[change(word)] += n
                if len(counts) >= FLUSH:
                    yield flushed(counts)
                    counts = Counter()
        yield flushed(counts)

    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    counted = rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= least_count)


def common(a: str, b: str) -> int:
    return len(os.path.commonprefix((a, b)))


def numbered(words: list[str], part: int, cuts: list[str]) -> list[list[int]]:
    """For each of the sorted ``words`` of range ``part``: the nodes of its prefixes, from the empty one on.

    Own nodes are even numbers within the range's block of 2^40, shared ones odd numbers within that of their first cut.
    """
    below, above = (cuts[i] if 0 <= i < len(cuts) else "" for i in (part - 1, part))
    out, before, path, own = [], "", [1], 0
    for word in words:
        path = path[: common(before, word) + 1]
        shared = max(common(word, below), common(word, above))
        for depth in range(len(path), len(word) + 1):
            if depth <= shared:
                path.append(bisect_left(cuts, word[:depth]) << 40 | depth << 1 | 1)
            else:
                own += 1
                path.append(part << 40 | own << 1)
        out.append(path)
        before = word
        path = list(path)
    return out


def trie(vocabulary: DataFrame, reverse: bool = False) -> DataFrame:
    """``id, nodes``: the numbered trie nodes along each word (or reversed word) of ``id, word``."""
    spark = vocabulary.sparkSession
    ship_package(spark)
    keyed = vocabulary.select("id", (F.reverse("word") if reverse else F.col("word")).alias("key"))
    n = vocabulary.count()
    ranges = -(-n // RANGE_WORDS)
    cuts: list[str] = []
    if ranges > 1:
        # About 64 words per range are drawn by hash, cut to CUT_LENGTH: 20 million words take 2 MB.
        drawn = keyed.filter(F.pmod(F.xxhash64("key"), F.lit(max(1, n // (64 * ranges)))) == 0)
        sample = sorted(r[0] for r in drawn.select(F.substring("key", 1, CUT_LENGTH)).collect())
        cuts = sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)} if sample else [])

    def place(batches):
        for batch in batches:
            parts = [bisect_right(cuts, key) for key in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.int64())], ["id", "key", "part"])

    def scan(group: pa.Table) -> pa.Table:
        group = group.take(np.argsort(np.array(group["key"].to_pylist(), dtype=object), kind="stable"))
        nodes = numbered(group["key"].to_pylist(), group["part"][0].as_py(), cuts)
        return pa.table({"id": group["id"], "nodes": pa.array(nodes, pa.list_(pa.int64()))})

    placed = keyed.mapInArrow(place, "id long, key string, part long")
    return placed.groupBy("part").applyInArrow(scan, "id long, nodes array<long>")


def pair_dictionary(vocabulary: DataFrame) -> DataFrame:
    """``p, s, id, kind``: all (prefix node, suffix node) pairs of the words, with a letter left out or at a gap."""

    def pairs(batches):
        for batch in batches:
            columns: list[list[np.ndarray]] = [[], [], [], []]
            for key, word, ahead, back in zip(*batch.columns):
                f, r = np.array(ahead.as_py()), np.array(back.as_py())[::-1]
                letters = np.frombuffer(word.as_py().encode("utf-32-le"), dtype=np.uint32)
                first = np.r_[True, letters[1:] != letters[:-1]]
                columns[0] += [f, f[:-1]]
                columns[1] += [r, r[1:]]
                columns[2].append(np.full(2 * len(f) - 1, key.as_py()))
                columns[3] += [np.full(len(f), GAP), np.where(first, LEFT_OUT, INSIDE_RUN)]
            arrays = [np.concatenate(c) if c else np.empty(0, np.int64) for c in columns]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(a, pa.int64()) for a in arrays[:3]), pa.array(arrays[3], pa.int32())], ["p", "s", "id", "kind"])

    ahead, back = trie(vocabulary), trie(vocabulary, reverse=True).withColumnRenamed("nodes", "back")
    both = vocabulary.filter("word <> ''").join(ahead, "id").join(back, "id").select("id", "word", "nodes", "back")
    return both.mapInArrow(pairs, "p long, s long, id long, kind int")


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """``id, n_near, best``: how many words are one letter apart, and the least id among them."""
    # A list has one entry per letter of the alphabet and one gap at most.
    members = F.array_sort(F.collect_list(F.struct("id", "kind")))
    met = pair_dictionary(vocabulary).groupBy("p", "s").agg(members.alias("m")).filter(F.size("m") > 1)
    out = F.filter("m", lambda x: x["kind"] != GAP)
    starts = F.filter("m", lambda x: x["kind"] == LEFT_OUT)
    gaps = F.filter("m", lambda x: x["kind"] == GAP)
    met = met.select(out.alias("out"), starts.alias("starts"), F.get(gaps, F.lit(0))["id"].alias("gap"), F.explode("m").alias("w"))
    own, others = F.col("w.id"), F.size("out") - 1
    other = F.when(F.col("out")[0]["id"] != own, F.col("out")[0]["id"]).otherwise(F.get("out", F.lit(1))["id"])
    at_gap = F.col("gap").isNotNull() & (F.col("w.kind") == LEFT_OUT)
    found = met.select(
        own.alias("id"),
        F.when(F.col("w.kind") == GAP, F.size("starts")).otherwise(others + at_gap.cast("int")).alias("near"),
        F.when(F.col("w.kind") == GAP, F.get("starts", F.lit(0))["id"])
        .otherwise(F.least(other, F.when(at_gap, F.col("gap")))).alias("best"),
    ).filter("near > 0")
    return found.groupBy("id").agg(F.sum("near").cast("long").alias("n_near"), F.min("best").alias("best"))


def roots(up: DataFrame) -> DataFrame:
    """``id, root`` of the links ``id, to``, which have no cycles, by doubling: n steps take log2(n) rounds."""
    up = stored(up, "forms")
    while True:
        further = up.select(F.col("id").alias("to"), F.col("to").alias("next"))
        jumped = stored(up.join(further, "to", "left").select("id", F.coalesce("next", "to").alias("to"),
                                                              F.col("next").isNotNull().alias("moved")), "forms")
        up = jumped.select("id", "to")
        if not jumped.filter("moved").limit(1).count():
            return up.withColumnRenamed("to", "root")


def variants(counts: DataFrame, ratio: int = 5) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for ``word, n``; a form is near and at least ``ratio`` times as frequent."""
    spark = counts.sparkSession
    order = [F.col("n").desc(), F.col("word")]
    ranked = counts.select("word", "n").repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)
    vocabulary = stored(ranked.withColumn("id", F.monotonically_increasing_id()), "vocabulary")
    near = stored(neighbours(vocabulary), "neighbours")
    best = vocabulary.select(F.col("id").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    judged = vocabulary.join(near, "id", "left").join(best, "best", "left")
    is_form = F.col("form_n") >= ratio * F.col("n")
    judged = stored(judged.select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best")).alias("to"),
        F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n"),
    ), "judged")
    last = roots(judged.filter("to IS NOT NULL").select("id", "to"))
    named = last.join(vocabulary.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root")
    out = judged.join(named.select("id", "root_word"), "id", "left")
    return out.select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
