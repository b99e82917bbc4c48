"""SimHash near-dedup over a Gray-order hierarchical index.

Fingerprints sorted by Gray rank (the place of a bit pattern in the reflected Gray code) differ little from
their neighbours, so a run of them shares many bits.  An index node keeps the bits that all
fingerprints below share and its parent does not: a mask and a pattern.  A search adds up the differing
bits of the masked patterns on its way down and gives up a whole group as soon as the sum passes
the limit.

The same index works at two scales.  Runs of the sorted fingerprints are the *groups*; the upper
nodes over them, a few numbers per group, go to every task and say which groups a fingerprint has to
visit.  Each group then builds the lower nodes over its own fingerprints and searches its visitors.  A pair
is met where its later group is, so a fingerprint only visits groups from its own onwards.

Copies never multiply: equal fingerprints are one entry, and a fingerprint has at most 2,080 others
within two bits.  Groups return one link per entry (to the least entry it reaches there), and
components of the links come from alternating star joins with checkpoints.

Defined cases: null or empty text has fingerprint zero, which links like any other; fewer words than the
shingle has make one shingle of all of them; repeated rows and ids share component and fingerprint; rows
without an id have a component (null if no row in it has an id); an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewell.llm.text import private, stored
from pricewell.plans.session import ship_package

SEED = 42
#: Entries per group aimed at, and the most groups (the upper nodes of all groups go to every task).
GROUP_ENTRIES = 16384
MAX_GROUPS = 16384
LEAF = 32
FAN = 8

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned 64-bit SimHash of a text."""
    words = (text or "").encode().translate(_LOWER).split()  # bytes.split() takes the six ASCII spaces
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(shingle, len(words))
    n = len(words) - width + 1
    digest = xxhash.xxh64_intdigest
    totals = np.zeros(64, dtype=np.int64)
    for low in range(0, n, 1 << 16):  # long texts in slices, to bound memory
        high = min(n, low + (1 << 16))
        spans = zip(starts[low:high].tolist(), ends[low + width - 1 : high + width - 1].tolist())
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype=">u8")
        totals += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = (2 * totals > n).astype(np.uint8)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def fingerprints(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3,
                 row: str | None = None) -> DataFrame:
    """``doc_id, fp`` per row, and the long column ``row``, if given; ``fp`` is the fingerprint as a signed long."""
    ship_package(documents.sparkSession)
    names, schema = (["doc_id", "fp"], "doc_id long, fp long") if row is None else (
        ["doc_id", "fp", "row"], "doc_id long, fp long, row long")

    def run(batches):
        for batch in batches:
            values = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            fp = np.array(values, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp), *batch.columns[2:]], names)

    kept = [] if row is None else [F.col(row).alias("row")]
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *kept)
    return rows.mapInArrow(run, schema)


def gray_rank(fp: Column) -> Column:
    """The Gray rank of a fingerprint, as a signed long in the order of the unsigned rank."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def _ranks(fp: np.ndarray) -> np.ndarray:
    out = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class GrayTree:
    """Index nodes over entries in Gray order, each a pair of bits all below agree on (ones, zeros).

    ``levels[0]`` is the root's level; a level's node i has nodes FAN i to FAN i + FAN - 1 below it.
    """

    def __init__(self, ones: np.ndarray, zeros: np.ndarray):
        levels = [(ones, zeros)]
        while len(levels[0][0]) > 1:
            at = np.arange(0, len(levels[0][0]), FAN)
            levels.insert(0, (np.bitwise_and.reduceat(levels[0][0], at), np.bitwise_and.reduceat(levels[0][1], at)))
        self.levels = []
        for depth, (one, zero) in enumerate(levels):
            mask = one | zero
            if depth:
                above = np.arange(len(one)) // FAN
                mask = mask & ~(levels[depth - 1][0] | levels[depth - 1][1])[above]  # what the parent has is counted
            self.levels.append((mask, one & mask))

    def reach(self, asked: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``asked``, lowest node) for all nodes whose shared bits differ in at most ``limit``."""
        who = np.arange(len(asked))
        node = np.zeros(len(asked), dtype=np.int64)
        spent = np.zeros(len(asked), dtype=np.uint8)
        for depth, (mask, pattern) in enumerate(self.levels):
            if depth:
                who, spent = np.repeat(who, FAN), np.repeat(spent, FAN)
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                there = node < len(mask)
                who, node, spent = who[there], node[there], spent[there]
            spent = spent + np.bitwise_count((asked[who] ^ pattern[node]) & mask[node])
            live = spent <= limit
            who, node, spent = who[live], node[live], spent[live]
        return who, node


def close_pairs(own: np.ndarray, visitors: np.ndarray, limit: int, block: int = 2048):
    """Yield (entry, other entry) arrays of all pairs within ``limit`` bits, each pair once.

    Pairs are among ``own`` or between a visitor and ``own``; both are arrays of distinct fingerprints.
    """
    own = own[np.argsort(_ranks(own), kind="stable")]
    starts = np.arange(0, len(own), LEAF)
    tree = GrayTree(np.bitwise_and.reduceat(own, starts), np.bitwise_and.reduceat(~own, starts))
    for asked, inside in ((own, True), (visitors, False)):
        for low in range(0, len(asked), block):
            part = asked[low : low + block]
            who, leaf = tree.reach(part, limit)
            other = (leaf[:, None] * LEAF + np.arange(LEAF)).ravel()
            who = np.repeat(who, LEAF)
            there = other < len(own)
            who, other = who[there], other[there]
            near = np.bitwise_count(part[who] ^ own[other]) <= limit
            if inside:
                near &= other > who + low
            yield part[who[near]], own[other[near]]


def least_reached(pairs, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over ``pairs``: (entry, least entry of its set) for entries that have a partner."""
    parent = np.arange(len(entries))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in pairs:
        for i, j in zip(np.searchsorted(entries, a).tolist(), np.searchsorted(entries, b).tolist()):
            x, y = root(i), root(j)
            if x != y:
                parent[max(x, y)] = min(x, y)
    roots = np.fromiter((root(i) for i in range(len(entries))), dtype=np.int64, count=len(entries))
    moved = np.flatnonzero(roots != np.arange(len(entries)))
    return entries[moved], entries[roots[moved]]


def links(entries: DataFrame, limit: int = 2) -> DataFrame:
    """``a, b``: links that join all distinct fingerprints (column ``fp``) within ``limit`` bits."""
    spark = entries.sparkSession
    ship_package(spark)
    ranked = entries.select("fp", gray_rank(F.col("fp")).alias("rank"))
    n = ranked.count()
    if n < 2:
        return spark.createDataFrame([], "a long, b long")
    groups = max(1, min(MAX_GROUPS, -(-n // GROUP_ENTRIES)))
    quantiles = [i / groups for i in range(1, groups)]
    cuts = ranked.agg(F.percentile_approx("rank", quantiles or [0.5], 10 * groups)).first()[0] if groups > 1 else []
    cuts = np.unique(np.array(cuts, dtype=np.int64))

    def group_of(rank: np.ndarray) -> np.ndarray:
        return np.searchsorted(cuts, rank, side="left")

    def place(batches):
        for batch in batches:
            fp, rank = (np.asarray(batch.column(i)) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(group_of(rank))], ["fp", "grp"])

    # Upper nodes: what each group's fingerprints share.  One row per group, MAX_GROUPS at most.
    shared = (
        ranked.mapInArrow(place, "fp long, grp long").groupBy("grp")
        .agg(F.bit_and("fp").alias("ones"), F.bit_and(F.bitwise_not("fp")).alias("zeros")).collect()
    )
    shared.sort(key=lambda r: r["grp"])
    names = np.array([r["grp"] for r in shared], dtype=np.int64)
    tree = GrayTree(*(np.array([r[c] for r in shared], dtype=np.int64).view(np.uint64) for c in ("ones", "zeros")))

    def route(batches):
        """Fingerprints for each group, packed: a row holds all that a part of a batch sends to one group."""
        for batch in batches:
            fp, rank = (np.asarray(batch.column(i)) for i in (0, 1))
            home = group_of(rank)
            for low in range(0, len(fp), 4096):
                part = np.ascontiguousarray(fp[low : low + 4096])
                who, node = tree.reach(part.view(np.uint64), limit)
                to, own = names[node], home[low : low + 4096][who]
                go = to >= own
                who, to, own = who[go], to[go], (to == own)[go]
                order = np.lexsort((own, to))
                who, to, own = who[order], to[order], own[order]
                cuts_ = np.flatnonzero(np.r_[True, (to[1:] != to[:-1]) | (own[1:] != own[:-1])]) if len(to) else []
                ends = pa.array(np.append(cuts_, len(to)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to[cuts_]), pa.array(own[cuts_]), pa.ListArray.from_arrays(ends, pa.array(part[who]))],
                    ["grp", "own", "fps"],
                )

    def search(group: pa.Table) -> pa.Table:
        def unpacked(own: bool) -> np.ndarray:
            lists = group.filter(pc.equal(group.column("own"), own)).column("fps")
            return pc.list_flatten(lists).to_numpy().view(np.uint64)

        own, visitors = unpacked(True), unpacked(False)
        entries = np.unique(np.concatenate([own, visitors]))
        a, b = least_reached(close_pairs(own, visitors, limit), entries)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    routed = ranked.mapInArrow(route, "grp long, own boolean, fps array<long>")
    return routed.groupBy("grp").applyInArrow(search, "a long, b long")


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """``node, root``: the least node of each component, for all nodes but the roots themselves.

    Alternating large-star and small-star steps (published for MapReduce); a star's centre only meets its
    neighbours in joins that Spark can split, never in a list.
    """
    def step(pairs: DataFrame, large: bool) -> DataFrame:
        around = pairs if not large else pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = around.join(least, "a")
        if large:
            return joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(
            least.select("a", F.col("m").alias("b"))
        )

    def tidy(pairs: DataFrame) -> DataFrame:
        return pairs.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()

    pairs = stored(tidy(edges), "links")
    seen = state(pairs)
    for _ in range(rounds):
        pairs = stored(tidy(step(tidy(step(pairs, True)), False)), "links")
        now = state(pairs)
        if now == seen:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now
    raise ValueError("components did not settle")


def _rooted(entries: DataFrame, limit: int) -> DataFrame:
    """``entries`` (``fp`` and others) plus ``root``, the fingerprint that stands for their component."""
    roots = components(links(entries, limit))
    return entries.join(roots, entries["fp"] == roots["node"], "left").select(
        *[entries[c] for c in entries.columns], F.coalesce("root", "fp").alias("root")
    )


def near_duplicates(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, limit: int = 2,
) -> DataFrame:
    """``doc_id, fp, component_id`` per row: the smallest id that links of ``limit`` bits reach."""
    prints = stored(fingerprints(documents, doc_id, text, shingle), "fingerprints")
    placed = _rooted(stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "entries"), limit)
    best = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(best, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def without_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text",
                       shingle: int = 3, limit: int = 2) -> DataFrame:
    """One row of each component: that with the smallest id, rows without an id last, of equal ids any one.

    Rows are told apart by a number of their own, so repeated rows leave one, and of an id with several texts
    each text is judged for itself.
    """
    row = private("row")
    numbered = stored(documents.withColumn(row, F.monotonically_increasing_id()), "rows")
    prints = stored(fingerprints(numbered, doc_id, text, shingle, row), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row"))
    placed = _rooted(stored(prints.groupBy("fp").agg(first.alias("least")), "entries"), limit)
    best = placed.groupBy("root").agg(F.min("least").alias("best"))
    named = placed.join(best, "root").select("fp", F.col("best.row").alias("kept"))
    gone = prints.join(named, "fp").filter("row <> kept").select(F.col("row").alias(row))
    return numbered.join(gone, row, "left_anti").select(*documents.columns)
