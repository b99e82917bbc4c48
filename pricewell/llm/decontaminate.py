"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters (normalised: letters and digits in lower case, all else one space) may differ
in ``errors = floor(rate * m)`` edits.  Cut into errors + 1 pieces, at least one piece of any such
occurrence is unharmed, so every occurrence has an exact piece hit.  Pieces of all items form one
Aho-Corasick automaton that reads each whole document once; around each hit, Myers' bit-parallel
algorithm finds the least edit distance of the item to any part of the document there.

The items are a stated set of test questions; they go to every task in blocks of at most
``block_chars`` characters, one pass over the documents per block, so what a task holds is bounded however
long the list.  Nothing is shuffled but the found rows.

A piece that is frequent in the corpus gives many hits; hits of one item with nearby places are one stretch,
and a stretch is only verified in full when enough of the item's trigrams lie in it (an occurrence with k edits
keeps all but 3 k of them), a test that loses nothing.

Defined cases: null or empty text matches nothing; items whose text is null or without letters or digits match
nothing; an item so short that its budget allows no error (under 13 characters at the usual rate) is sought exactly and
at word boundaries, and if it is a single word, only as a whole document, as words stand in clean documents; an item is a pair of id and normalised
text, so each text of an id is sought and reported, repeated pairs count once, and items without an id are reported
with a null id; ties take the earliest end; an empty table
gives an empty result; other columns are not read and stay in ``decontaminated``.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewell.llm.text import private, stored, with_place
from pricewell.plans.session import ship_package

RATE = 0.08
BLOCK_CHARS = 2_000_000
_WORDS = re.compile(r"[^\W_]+")


def normalised(text: str | None) -> str:
    """Words of letters and digits in lower case, one space between."""
    return " ".join(_WORDS.findall((text or "").lower()))


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces (offset, text) of nearly equal length that make up the item."""
    cuts = [i * len(item) // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


class Pattern:
    """An item ready for Myers' algorithm; Python integers hold columns of any height."""

    def __init__(self, item: str, rate: float):
        self.item, self.size = item, len(item)
        self.errors = int(rate * self.size)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(item):
            self.masks[c] = self.masks.get(c, 0) | 1 << i
        self.trigrams = {item[i : i + 3] for i in range(self.size - 2)}

    def may_hold(self, text: str) -> bool:
        """False only if no part of ``text`` can be within the budget (q-gram lemma)."""
        need = len(self.trigrams) - 3 * self.errors
        return need <= 0 or len(self.trigrams & {text[i : i + 3] for i in range(len(text) - 2)}) >= need

    def whole_end(self, text: str, begin: int, end: int) -> int:
        """Where the first exact occurrence between word boundaries in ``text[begin:end]`` ends, or 0.

        A single word has to be the whole text.
        """
        if " " not in self.item:
            return self.size if text == self.item else 0
        at = f" {text[max(0, begin - 1) : end + 1]} ".find(f" {self.item} ")
        return 0 if at < 0 else max(0, begin - 1) + at + self.size

    def best_end(self, text: str) -> tuple[int, int]:
        """(least distance of the item to a part of ``text``, where the first such part ends)."""
        full, top = (1 << self.size) - 1, 1 << self.size - 1
        plus, minus, score = full, 0, self.size
        best, end = score, 0
        get = self.masks.get
        for j, c in enumerate(text, 1):
            eq = get(c, 0)
            diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
            up = minus | (full & ~(diagonal | plus))
            down = plus & diagonal
            if up & top:
                score += 1
            elif down & top:
                score -= 1
            up = up << 1 & full
            down = down << 1 & full
            plus = down | (full & ~(diagonal | up))
            minus = up & diagonal
            if score < best:
                best, end = score, j
        return best, end


class Matcher:
    """All items of one block: automaton of pieces and patterns."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.patterns = {i: Pattern(text, rate) for i, text in items}
        where: dict[str, list[tuple[int, int]]] = {}
        for i, pattern in self.patterns.items():
            for offset, piece in pieces(pattern.item, pattern.errors):
                where.setdefault(piece, []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def stretches(self, text: str):
        """(item, from, to): parts of the text that may hold an item, near hits joined."""
        found: dict[int, list[list[int]]] = {}
        for last, (length, places) in self.automaton.iter(text):
            for item, offset in places:
                pattern = self.patterns[item]
                begin = max(0, last + 1 - length - offset - pattern.errors)
                end = min(len(text), begin + pattern.size + 2 * pattern.errors)
                runs = found.setdefault(item, [])
                if runs and begin <= runs[-1][1]:
                    runs[-1][0], runs[-1][1] = min(begin, runs[-1][0]), max(end, runs[-1][1])
                else:
                    runs.append([begin, end])
        for item, runs in found.items():
            for begin, end in runs:
                yield item, begin, end

    def matches(self, text: str):
        """(item, distance, place of the end in ``text``) for each item within its budget, best only."""
        best: dict[int, tuple[int, int]] = {}
        for item, begin, end in self.stretches(text):
            pattern, part = self.patterns[item], text[begin:end]
            if not pattern.errors:
                stop = pattern.whole_end(text, begin, end)
                if stop and item not in best:
                    best[item] = (0, stop)
            elif pattern.may_hold(part):
                distance, stop = pattern.best_end(part)
                if distance <= pattern.errors:
                    best[item] = min(best.get(item, (distance, begin + stop)), (distance, begin + stop))
        return [(item, *found) for item, found in best.items()]


def contaminations(
    documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", rate: float = RATE, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``doc_id, item_id, distance, end_char`` for each document and item, a pair of id and text, within the budget.

    ``end_char`` is where the best occurrence ends in the normalised document.
    """
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t"))
    return _leaks(docs, items, rate, block_chars)


def _leaks(docs: DataFrame, items: DataFrame, rate: float, block_chars: int) -> DataFrame:
    """``contaminations`` of ``docs`` (``doc_id``, of type long or string, and ``text``) by ``items`` (``i, t``)."""
    spark = docs.sparkSession
    ship_package(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind.replace('bigint', 'long')}, item_id long, distance int, end_char long"
    out = None
    for block in _blocks(items, block_chars):
        found = docs.mapInArrow(_search(spark.sparkContext.broadcast(block), rate), schema)
        out = found if out is None else out.unionAll(found)
    return out if out is not None else spark.createDataFrame([], schema)


def _blocks(items: DataFrame, block_chars: int):
    """Lists of distinct (id, normalised text) that hold ``block_chars`` characters each, or one long item."""
    def normal(batches):
        for batch in batches:
            texts = pa.array([normalised(t.as_py()) for t in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["i", "t"])

    distinct = items.select("i", "t").mapInArrow(normal, "i long, t string").filter("t <> ''").distinct()
    block, size = [], 0
    for row in distinct.orderBy("i", "t").toLocalIterator():
        if block and size + len(row["t"]) > block_chars:
            yield block
            block, size = [], 0
        block.append((row["i"], row["t"]))
        size += len(row["t"])
    if block:
        yield block


def _search(items, rate: float):
    def run(batches):
        # The matcher knows items by their place in the block: an id may be null or have several texts.
        ids = [i for i, _ in items.value]
        matcher = Matcher([(n, t) for n, (_, t) in enumerate(items.value)], rate)
        for batch in batches:
            rows = [
                (doc.as_py(), ids[n], *match)
                for doc, text in zip(batch.column(0), batch.column(1))
                for n, *match in matcher.matches(normalised(text.as_py()))
            ]
            columns = list(zip(*rows)) or [[], [], [], []]
            kinds = (batch.schema.field(0).type, pa.int64(), pa.int32(), pa.int64())
            names = ["doc_id", "item_id", "distance", "end_char"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return run


def decontaminated(
    documents: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``documents`` without the rows that hold a test item, with an id or without.

    Each row is judged by its own text: rows without an id, and several texts of one id, are rows of their own.
    """
    place = private("place")
    placed = with_place(documents, place, "tested-rows")
    items = benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").alias("t"))
    leaks = _leaks(placed.select(F.col(place).alias("doc_id"), "text"), items, rate, block_chars)
    found = stored(leaks.select(F.col("doc_id").alias(place)).distinct(), "contaminated")
    return placed.join(found, place, "left_anti").select(*documents.columns)
