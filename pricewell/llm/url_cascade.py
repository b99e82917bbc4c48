"""URL rules answered by a cascade of Bloom filters, exact over the corpus's own keys.

A URL asks for *keys*: every suffix of its host at a dot, joined with every prefix of its path that
has the length of some rule's path.  Level 1 holds the listed keys.  Level 2 holds the keys of the
corpus that level 1 takes wrongly, level 3 the listed keys that level 2 takes wrongly, and so on until
none is wrong.  A key's answer is the parity of the first level that lacks it.  As all keys of the
corpus took part in building, the answer is exact for each of them, and filtering needs no join:
the levels are constant word arrays in the plan.

Level 1's rate of false positives is ``listed * sqrt(0.5) / others``, later levels use one half; that
keeps the sum of all levels near its least (the sizing published for certificate revocation cascades).
The bits grow with the listed keys and the logarithm of the corpus; ``max_bits`` guards what is sent to
the executors, and a longer list raises an error instead of losing keys.

Defined cases: null url, or none with ``://``: host and path are empty and no rule fits; an empty path
fits no rule with a path; host letters A-Z are lower-cased; user, port and stray dots stay part of the
host; repeated rows give repeated rows; an empty table gives an empty result; columns of the input that are
named like a result column give way to it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewell.llm.text import ascii_lower, private, stored

MAX_LEVELS = 64


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (lower-cased) and path of a URL, both empty where there is no ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    no_tail = F.regexp_replace(rest, r"(?s)[?#].*$", "")
    slash = F.instr(no_tail, "/")
    host = F.when(slash > 0, F.substring(no_tail, F.lit(1), slash - 1)).otherwise(no_tail)
    path = F.when(slash > 0, F.substring(no_tail, slash, F.char_length(no_tail))).otherwise(F.lit(""))
    return ascii_lower(host), path


def candidate_keys(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """All keys that a rule fitting (host, path) could have, as an array of strings."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    lengths = F.filter(F.array(*[F.lit(n) for n in path_lengths]), lambda n: n <= F.char_length(path))
    prefixes = F.transform(lengths, lambda n: F.substring(path, F.lit(1), n))
    # Hosts hold no slash and rule paths start with one, so host + path is unambiguous.
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


@dataclass
class Level:
    """One Bloom filter: ``words`` is a constant column of 64-bit words, folded once per plan."""

    words: Column
    bits: int
    hashes: int
    salt: int


def _positions(key: Column, bits: int, hashes: int, salt: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(salt), F.lit(i), key), F.lit(bits).cast("long")) for i in range(hashes)]


def _level(keys: DataFrame, n: int, rate: float, salt: int, max_bits: int) -> Level:
    """A filter over ``keys`` (one column ``key``) with the wanted rate of false positives."""
    hashes = max(1, round(-math.log2(rate)))
    bits = 64 * math.ceil(max(64, 1.45 * n * -math.log2(rate)) / 64)
    if bits > max_bits:
        raise ValueError(f"a level needs {bits} bits; max_bits is {max_bits}")
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), bits, hashes, salt))).alias("bit"))
    words = at.groupBy(F.expr("bit div 64").cast("int").alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("v")
    )
    # No more words than the level has: its size was checked above.
    filled = dict(words.collect())
    words = F.from_json(F.lit(str([filled.get(i, 0) for i in range(bits // 64)])), "array<bigint>")
    return Level(words, bits, hashes, salt)


def _holds(level: Level, key: Column) -> Column:
    """Whether the filter takes ``key``."""
    out = F.lit(True)
    for p in _positions(key, level.bits, level.hashes, level.salt):
        word = F.get(level.words, F.floor(p / 64).cast("int"))
        out = out & (F.getbit(word, (p % 64).cast("int")) == 1)
    return out


def build_cascade(universe: DataFrame, listed: DataFrame, max_bits: int = 1 << 23) -> list[Level]:
    """Levels over ``universe`` (distinct ``key``); ``listed`` (``key``) may name keys outside it."""
    marked = stored(
        universe.join(listed.select("key").distinct().withColumn("_l", F.lit(True)), "key", "left")
        .select("key", F.col("_l").isNotNull().alias("is_listed")),
        "url-keys",
    )
    counts = dict(marked.groupBy("is_listed").count().collect())
    n, others = counts.get(True, 0), counts.get(False, 0)
    if n == 0:
        return []
    rate = min(0.5, n * math.sqrt(0.5) / max(others, 1))
    inside, outside = marked.filter("is_listed").select("key"), marked.filter("not is_listed").select("key")
    levels: list[Level] = []
    while n:
        if len(levels) == MAX_LEVELS:
            raise ValueError("the cascade does not end; two keys share a 128-bit hash")
        levels.append(_level(inside, n, rate, len(levels), max_bits))
        # What the new level takes wrongly is what the next one holds.
        inside, outside = outside.filter(_holds(levels[-1], F.col("key"))), inside
        n, rate = inside.count(), 0.5
    return levels


def is_listed(levels: list[Level], key: Column) -> Column:
    """Exact membership of a key of the universe: the first level that lacks it decides."""
    answer = F.lit(len(levels) % 2 == 1)
    for depth in reversed(range(len(levels))):
        answer = F.when(_holds(levels[depth], key), answer).otherwise(F.lit(depth % 2 == 1))
    return answer


def _hits(keys: Column, levels: list[Level], verdict: str) -> Column:
    """The listed ones of ``keys``, as structs that sort by length of key, then of host."""
    return F.transform(
        F.filter(keys, lambda k: is_listed(levels, k)),
        lambda k: F.struct(F.char_length(k).alias("size"), F.instr(k, "/").alias("host_size"),
                           k.alias("key"), F.lit(verdict).alias("verdict")),
    )


def judge_urls(
    pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", default: str = "allow",
) -> DataFrame:
    """``pages`` plus ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` are (verdict, host, path).  A rule fits its host and all subdomains where the page's path
    starts with the rule's; of those that fit, the longest key wins, then the longer host.
    One cascade per verdict says which of a page's keys are listed with it; keys with no rule have
    the ``default`` verdict.
    """
    spark = pages.sparkSession
    table = spark.createDataFrame([(h + p, v) for v, h, p in rules], "key string, verdict string").coalesce(1)
    lengths = sorted({len(p) for _, _, p in rules})
    host, path = host_and_path(F.col(url))
    asked = pages.select(host.alias("h"), path.alias("p")).distinct()
    universe = asked.select(F.explode(candidate_keys(F.col("h"), F.col("p"), lengths)).alias("key")).distinct()
    universe = stored(universe, "url-universe")
    verdicts = sorted({v for v, _, _ in rules})
    cascades = {v: build_cascade(universe, table.filter(F.col("verdict") == v)) for v in verdicts}

    own = {private(c): c for c in ("host", "path")}
    best_hit = private("best")
    split = pages.select("*", *[v.alias(c) for c, v in zip(own, (host, path))])
    split = split.drop("host", "path", "rule", "verdict").withColumnsRenamed(own)
    keys = candidate_keys(F.col("host"), F.col("path"), lengths)
    hits = [_hits(keys, cascades[v], v) for v in verdicts if cascades[v]]
    if not hits:
        return split.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    return (
        split.withColumn(best_hit, F.array_max(F.concat(*hits)))
        .select("*", F.col(best_hit)["key"].alias("rule"),
                F.coalesce(F.col(best_hit)["verdict"], F.lit(default)).alias("verdict"))
        .drop(best_hit)
    )
