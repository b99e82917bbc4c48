"""Near duplicates by the chosen-path set similarity join.

A document is its set of word shingles, held as ``SIZE`` minwise values.  A tree branches the documents of a node by
chosen minwise positions: a position is chosen for the whole node with probability 1 / (threshold * SIZE), and
documents with one value there go on together.  A pair at the threshold is expected to stay together once per
level, a less similar one dies out.  Small nodes are compared exhaustively, large ones branch on, and
``trees`` independent trees bring the chance of finding a pair at the threshold to ``recall``.

Equal sets are one class, so copies cost nothing.  Before it branches, every document of a large node is compared
with the node's centres (the least by some hashes); groups of thousands of near copies become components
there.  Only documents of different components are compared, and a node that one component fills is closed: components
are what is asked for, so pairs inside them are never written.  Nodes branch as long as any is large; there is no
cap on levels, candidates or partners.  All trees advance together, one level at a time; a node is a number in a
table, never a list on the driver, and only nodes of at most ``SMALL`` documents are gathered.

A candidate has equal minwise values (one byte of each is kept as the sketch) in a share that a pair at the threshold
misses by four standard deviations at most.  Candidates are confirmed on the full shingle sets, made anew for the
documents that need it.  A small node gives one row per document that has a candidate, meets again with their full sets,
and returns the links that join its components, fewer than its documents.  All small nodes are gone through, few at
first: what these join needs no full sets in the many that follow.

Defined cases: fewer words than the shingle has are one shingle of all of them; null or empty text has an empty set,
which links with nothing; repeated rows and ids share the least id reached; rows without an id are linked too
(their component is null if no row in it has an id); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewell.llm.simhash_gray import components
from pricewell.llm.text import stored
from pricewell.plans.session import ship_package

#: Minwise values per set, one byte each; documents of a node that is compared exhaustively.
SIZE = 128
SMALL = 2000
#: Centres of a large node, and the ends of the passes over the small nodes, dealt by hash: a sixteenth, three, twelve.
CENTRES = 3
PASSES = (1, 4, 16)
#: Levels that the number of trees is reckoned for.
DEPTH = 3
#: Row keys up to this number are broadcast to the scan that makes full sets (16 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 2_000_000

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_RANDOM = np.random.default_rng(20240229)
_FACTORS = _RANDOM.integers(1, 1 << 63, SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 1 << 63, SIZE, dtype=np.uint64)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """The distinct 64-bit shingle hashes of a text, sorted."""
    words = (text or "").encode().translate(_LOWER).split()  # bytes.split() takes the six ASCII spaces
    if not words:
        return np.empty(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter(map(digest, words), dtype=np.uint64, count=len(words))
    width = min(shingle, len(words))
    n = len(words) - width + 1
    total = np.full(n, np.uint64(width))
    for k in range(width):
        total = _mixed(total + h[k : k + n])
    return np.unique(total)


def minwise(values: np.ndarray) -> np.ndarray:
    """``SIZE`` minwise values of a set, 32 bits each."""
    out = np.full(SIZE, np.iinfo(np.uint64).max, dtype=np.uint64)
    for low in range(0, len(values), 1 << 12):  # long texts in slices, to bound memory
        part = values[None, low : low + (1 << 12)]
        out = np.minimum(out, (part * _FACTORS[:, None] + _SHIFTS[:, None]).min(axis=1))
    return (out >> np.uint64(32)).astype(np.uint32)


def similar(a: int, b: int, both: int, threshold: int) -> bool:
    """Whether sets of ``a`` and ``b`` members with ``both`` in common reach ``threshold`` percent."""
    return 100 * both >= threshold * (a + b - both)


def trees_for(recall: float, threshold: int, depth: int = DEPTH) -> int:
    """Trees that find a pair at the threshold with probability ``recall`` where leaves are ``depth`` levels deep."""
    stay = 1.0
    for _ in range(depth):  # of a Poisson number of common branches, one on average, one has to stay to the end
        stay = 1 - math.exp(-stay)
    return math.ceil(math.log(1 - recall) / math.log(1 - stay))


def _row_key() -> list[Column]:
    return [F.col("doc_id"), F.xxhash64("text").alias("text_hash")]


def sketched(documents: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """``doc_id, text_hash, n, digest, minwise`` per row; ``digest`` tells sets apart, null ones are empty."""
    ship_package(documents.sparkSession)

    def run(batches):
        for batch in batches:
            n, digests, values = [], [], []
            for value in batch.column(2):
                found = shingle_set(value.as_py(), shingle)
                n.append(len(found))
                digests.append(xxhash.xxh128_digest(found.tobytes()) if len(found) else None)
                values.append(minwise(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(values, pa.binary())], ["doc_id", "text_hash", "n", "digest", "minwise"])

    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.select(*_row_key(), "text")
    return rows.mapInArrow(run, "doc_id long, text_hash long, n long, digest binary, minwise binary")


def branched(members: DataFrame, trees: int, threshold: int) -> DataFrame:
    """``node, cls`` of the next level, for ``node, cls, minwise``; without ``node``, of the first level of all trees."""
    share = np.uint64(int(2.0**64 / (threshold / 100 * SIZE)))
    places = np.arange(1, SIZE + 1, dtype=np.uint64)
    # Tree roots are 1, 2, ...; the positions that a root chooses are the same for all documents.
    root_nodes = np.arange(1, trees + 1, dtype=np.uint64)

    def chosen(node: np.ndarray) -> np.ndarray:
        """Row by row, the positions that a node chooses."""
        return _mixed(_mixed(node)[:, None] + places) < share

    from_roots = "node" not in members.columns

    def branch(batches):
        at_roots = np.nonzero(chosen(root_nodes))
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                part = batch.slice(low, 4096)
                cls = np.asarray(part.column("cls"))
                values = np.frombuffer(b"".join(part.column("minwise").to_pylist()), dtype=np.uint32).reshape(-1, SIZE)
                if from_roots:
                    tree, place = (np.tile(a, len(cls)) for a in at_roots)
                    row, node = np.repeat(np.arange(len(cls)), len(at_roots[0])), root_nodes[tree]
                else:
                    own = np.asarray(part.column("node")).view(np.uint64)
                    row, place = np.nonzero(chosen(own))
                    node = own[row]
                to = _mixed(_mixed(_mixed(node) + places[place]) + values[row, place])
                yield pa.RecordBatch.from_arrays([pa.array(to.view(np.int64)), pa.array(cls[row])], ["node", "cls"])

    return members.mapInArrow(branch, "node long, cls long")


def least_agreement(threshold: int) -> int:
    """Equal sketch bytes that a pair at the threshold has, less four standard deviations."""
    same = threshold / 100 + (1 - threshold / 100) / 256
    return math.floor(SIZE * same - 4 * math.sqrt(SIZE * same * (1 - same)))


def _sketch(values: np.ndarray) -> np.ndarray:
    return (values & np.uint32(0xFF)).astype(np.uint8)


def promising(pairs: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """Of the pairs ``a < b`` of classes, those whose sizes and sketches allow the threshold."""
    least = least_agreement(threshold)

    def agree(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, SIZE) for c in ("sa", "sb"))
            good = (a == b).sum(axis=1) >= least
            yield batch.select(["a", "b"]).filter(pa.array(good))

    def side(name: str) -> DataFrame:
        return classes.select(F.col("cls").alias(name), F.col("n").alias(f"n{name}"), F.col("sketch").alias(f"s{name}"))

    sized = pairs.join(side("a"), "a").join(side("b"), "b").filter(
        100 * F.least("na", "nb") >= threshold * F.greatest("na", "nb"))
    return sized.select("a", "b", "sa", "sb").mapInArrow(agree, "a long, b long")


def full_sets(wanted: DataFrame, classes: DataFrame, documents: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """``cls, members``: the full shingle sets of the classes ``cls``, written."""
    keys = wanted.join(classes, "cls").select("cls", F.col("rep.doc_id").alias("id"), F.col("rep.text_hash").alias("hash"))
    keys = stored(keys, "wanted")
    if keys.count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)

    def full(batches):
        for batch in batches:
            sets = [shingle_set(t, shingle).view(np.int64) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0] + [len(s) for s in sets])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets or [np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["cls", "members"])

    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).select(*_row_key(), "text")
    texts = rows.join(keys, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")))
    sets = stored(texts.select("cls", "text").mapInArrow(full, "cls long, members array<long>"), "sets")
    return sets.groupBy("cls").agg(F.first("members").alias("members"))  # repeated rows make one set several times


def confirmed(pairs: DataFrame, threshold: int, *source) -> DataFrame:
    """The pairs ``a, b`` whose full sets reach the threshold, written."""
    pairs = stored(pairs, "candidates")
    sets = full_sets(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), *source)

    def check(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column("ma"), batch.column("mb")):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(similar(len(x), len(y), both, threshold))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    def side(name: str) -> DataFrame:
        return sets.select(F.col("cls").alias(name), F.col("members").alias(f"m{name}"))

    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ma", "mb")
    return stored(met.mapInArrow(check, "a long, b long"), "confirmed")


def _by_node(batches):
    """The rows of sorted batches, node by node, as columns."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    for _, group in groupby(rows, key=lambda row: row[0]):
        yield tuple(zip(*group))


def with_candidates(leaves: DataFrame, threshold: int) -> DataFrame:
    """The rows ``node, cls`` of small nodes (``node, cls, comp, n, sketch``) that look similar to another component's."""
    least = least_agreement(threshold)

    def search(batches):
        out: list[tuple[int, int]] = []
        for node, cls, comp, n, sketch in _by_node(batches):
            comp, n, hot = np.array(comp), np.array(n), np.zeros(len(cls), dtype=bool)
            values = np.frombuffer(b"".join(sketch), dtype=np.uint8).reshape(-1, SIZE)
            for i in range(len(cls) - 1):
                other = np.flatnonzero((comp[i + 1 :] != comp[i]) & (
                    100 * np.minimum(n[i + 1 :], n[i]) >= threshold * np.maximum(n[i + 1 :], n[i]))) + i + 1
                near = other[(values[other] == values[i]).sum(axis=1) >= least] if len(other) else other
                hot[near] = True
                hot[i] |= len(near) > 0
            out.extend((node[0], cls[i]) for i in np.flatnonzero(hot))
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["node", "cls"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["node", "cls"])

    dealt = leaves.select("node", "cls", "comp", "n", "sketch").repartition("node").sortWithinPartitions("node")
    return dealt.mapInArrow(search, "node long, cls long")


def joined_exactly(hot: DataFrame, threshold: int) -> DataFrame:
    """Links ``a, b`` that join the components of small nodes (``node, cls, comp, members``), by their full sets."""

    def join(batches):
        out: list[tuple[int, int]] = []
        for _, cls, comp, members in _by_node(batches):
            names, comp = np.unique(np.array(comp), return_inverse=True)
            sizes = np.array([len(m) for m in members])
            universe, place = np.unique(np.concatenate(members), return_inverse=True)
            starts = np.cumsum(sizes) - sizes
            for i in range(len(cls) - 1):
                if (comp[i + 1 :] == comp[i]).all():
                    continue
                held = np.zeros(len(universe), dtype=np.int64)
                held[place[starts[i] : starts[i] + sizes[i]]] = 1
                both = np.add.reduceat(held[place[starts[i + 1] :]], starts[i + 1 :] - starts[i + 1])
                for j in np.flatnonzero(100 * both >= threshold * (sizes[i] + sizes[i + 1 :] - both)) + i + 1:
                    if comp[i] != comp[j]:
                        out.append((min(cls[i], cls[j]), max(cls[i], cls[j])))
                        comp[comp == comp[j]] = comp[i]
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])

    dealt = hot.select("node", "cls", "comp", "members").repartition("node").sortWithinPartitions("node")
    return dealt.mapInArrow(join, "a long, b long")


def _nodes(members: DataFrame) -> DataFrame:
    """``node, size`` of the nodes that hold more than one class, counted before the shuffle."""
    return members.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1")


def _stars(rows: DataFrame) -> DataFrame:
    """Pairs ``a < b`` of the rows ``node, cls, comp`` with their nodes' centres in other components."""
    def least(k: int) -> Column:
        return F.min(F.struct(F.xxhash64(F.lit(k), "node", "cls").alias("h"), "cls", "comp"))

    centres = rows.groupBy("node").agg(F.array(*(least(k) for k in range(CENTRES))).alias("c"))
    met = rows.join(centres.select("node", F.explode("c").alias("c")), "node").filter(F.col("comp") != F.col("c.comp"))
    return met.select(F.least("cls", "c.cls").alias("a"), F.greatest("cls", "c.cls").alias("b")).distinct()


def _open(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``node, cls, size, comp`` of the nodes that hold more than one component."""
    if labels is None:
        return rows.withColumn("comp", F.col("cls"))
    named = rows.select("node", "cls", "size").join(labels, F.col("cls") == F.col("labelled"), "left")
    named = stored(named.select("node", "cls", "size", F.coalesce("root", "cls").alias("comp")), "labelled")
    mixed = named.groupBy("node").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    return named.join(mixed.filter("low <> high").select("node"), "node")


def links(classes: DataFrame, documents: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5,
          threshold: int = 85, recall: float = 0.999) -> DataFrame:
    """``a, b``: confirmed links that join all classes within the threshold (at ``recall`` for each pair)."""
    source = (classes, documents, doc_id, text, shingle)
    trees = trees_for(recall, threshold)
    level = branched(classes.select("cls", "minwise"), trees, threshold)
    found, labels, leaves = None, None, []
    while True:
        level = stored(level, "level")
        level = stored(level.join(_nodes(level), "node"), "members")
        rows = _open(level, labels)
        leaves.append(rows.filter(F.col("size") <= SMALL).select("node", "cls", "size"))
        large = stored(rows.filter(F.col("size") > SMALL), "large")
        if not large.limit(1).count():
            break
        near = confirmed(promising(_stars(large), classes, threshold), threshold, *source)
        found = near if found is None else found.unionAll(near)
        labels = stored(components(found).withColumnRenamed("node", "labelled"), "labels")
        still = _open(large, labels).select("node", "cls")
        level = branched(still.join(classes.select("cls", "minwise"), "cls"), trees, threshold)
    at_leaves = leaves[0]
    for more in leaves[1:]:
        at_leaves = at_leaves.unionAll(more)
    at_leaves = stored(at_leaves, "leaves")
    turn = F.pmod(F.xxhash64("node"), F.lit(PASSES[-1]))
    for low, high in zip((0, *PASSES), PASSES):
        rows = stored(_open(at_leaves.filter((turn >= low) & (turn < high)), labels), "open")
        sketched_rows = rows.join(classes.select("cls", "n", "sketch"), "cls")
        hot = stored(with_candidates(sketched_rows, threshold), "hot")
        sets = full_sets(hot.select("cls").distinct(), *source)
        hot = hot.join(rows.select("node", "cls", "comp"), ["node", "cls"]).join(sets, "cls")
        joined = stored(joined_exactly(hot, threshold), "joined")
        found = joined if found is None else found.unionAll(joined)
        if high < PASSES[-1]:
            labels = stored(components(found).withColumnRenamed("node", "labelled"), "labels")
    return found


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5,
                    threshold: int = 85, recall: float = 0.999) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row; ``component_id`` is the least id that links reach."""
    rows = stored(sketched(documents, doc_id, text, shingle), "sketched")
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("rep")
    grouped = rows.filter("digest IS NOT NULL").groupBy("digest").agg(
        F.first("n").alias("n"), F.first("minwise").alias("minwise"), rep)

    def sketch(batches):
        for batch in batches:
            values = [_sketch(np.frombuffer(v, dtype=np.uint32)).tobytes() for v in batch.column("minwise").to_pylist()]
            yield batch.append_column("sketch", pa.array(values, pa.binary()))

    schema = ("cls long, digest binary, n long, minwise binary, "
              "rep struct<last:boolean,doc_id:bigint,text_hash:bigint>, sketch binary")
    numbered = grouped.select(F.monotonically_increasing_id().alias("cls"), "digest", "n", "minwise", "rep")
    classes = stored(numbered.mapInArrow(sketch, schema), "classes")
    linked = components(links(classes, documents, doc_id, text, shingle, threshold, recall))
    placed = classes.select("cls", "digest", F.col("rep.doc_id").alias("least")).join(
        linked, F.col("cls") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cls"))
    placed = stored(placed.select("digest", "root", "least"), "placed")
    best = placed.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("best"))
    named = placed.join(best, F.col("root") == F.col("r")).select("digest", "best")
    plain = rows.select("doc_id", "n", "digest")
    return plain.join(named, "digest", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("best")).alias("component_id"),
    )
