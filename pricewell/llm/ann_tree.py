"""Nearest neighbours by cosine over a hierarchical k-means tree.

The tree splits a bounded sample (``SAMPLE_BYTES`` of vectors at most) again and again into ``FAN`` clusters until
a leaf's share of the sample stands for about ``leaf_rows`` rows.  Every vector is indexed under the leaf it
falls to.  A search takes leaves best bin first: a priority queue holds the branches not yet taken, nearest
centre first.  How many leaves a search visits is calibrated: for a bounded set of calibration vectors
the true neighbours are found among all rows, and visits are widened until the leaves visited hold
``recall`` of them.

Equal vectors are indexed once with their smallest ids, as many as any answer can need; so however often a
vector repeats, its leaf holds it once.  Leaves lie one behind the other in bins of at most ``BIN_ROWS`` rows; a
large leaf spans several.  A search goes once to each bin that holds some of its leaves, with their list, so
rows sent and found grow with searches and bins, not with leaves visited.  A task scores one bin against
one block of searches.  Only the tree, one count per leaf and the calibration's few neighbours go to the driver.

Scores are cosines of the original vectors in double precision; within a block, products find the
candidates and each one near the k-th best is scored again in a fixed order of operations, so that
equal vectors have equal scores everywhere.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, and neither
do lengths other than the most frequent one (the smaller of two as frequent); rows without an id take no
part; ties go to the smaller id; rows that repeat an id and vector count once; an id never meets itself; fewer
than k candidates give fewer rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricewell.llm.text import stored
from pricewell.plans.session import ship_package

SAMPLE_BYTES = 16_000_000
MAX_LEAVES = 4096
CALIBRATION = 200
FAN = 8
#: Rows per bin at most, and bins at least, so that a small index is searched by several tasks too.
BIN_ROWS = 20_000
LEAST_BINS = 16
BLOCK_SEARCHES = 2_000
AT_ONCE = 256  # searches scored together in a task


def matrix(column) -> np.ndarray:
    """An Arrow list column of equal lengths as a float64 matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def scaled(rows: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest component below 1, so that squares stay in range.

    Such factors are exact: angles and, for components of usual size, all bits of the scores stay.
    """
    _, power = np.frexp(np.abs(rows).max(axis=1))
    return np.ldexp(rows, -power[:, None])


def unit(rows: np.ndarray) -> np.ndarray:
    rows = scaled(rows)
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def clusters(points: np.ndarray, fan: int, rounds: int = 12) -> np.ndarray:
    """Centres of spherical k-means, seeded by farthest points from a first one."""
    centres = [points[0]]
    best = points @ points[0]
    for _ in range(fan - 1):
        centres.append(points[int(np.argmin(best))])
        best = np.maximum(best, points @ centres[-1])
    centres = np.array(centres)
    for _ in range(rounds):
        own = np.argmax(points @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        sizes = np.linalg.norm(sums, axis=1)
        good = sizes > 0
        centres[good] = sums[good] / sizes[good][:, None]
    return centres


class Tree:
    """Centres of all nodes, their children, and leaf numbers."""

    def __init__(self, sample: np.ndarray, leaf_share: float):
        """``sample``: unit vectors; a node with at most ``leaf_share`` of them is a leaf."""
        self.centres: list[np.ndarray] = [np.zeros(sample.shape[1])]
        self.children: list[list[int]] = [[]]
        self.leaf: list[int] = [-1]
        self.leaves = 0
        self._grow(0, sample, max(FAN, leaf_share * len(sample)))
        self.centres = np.array(self.centres)

    def _grow(self, node: int, points: np.ndarray, least: float) -> None:
        parts = []
        if len(points) > least:
            centres = clusters(points, FAN)
            own = np.argmax(points @ centres.T, axis=1)
            parts = [(centres[i], points[own == i]) for i in range(FAN) if np.any(own == i)]
        if len(parts) < 2:  # small, or all points alike
            self.leaf[node] = self.leaves
            self.leaves += 1
            return
        for centre, part in parts:
            child = len(self.children)
            self.centres.append(centre)
            self.children.append([])
            self.leaf.append(-1)
            self.children[node].append(child)
            self._grow(child, part, least)

    def place(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each unit vector: nearest child at each level."""
        out = np.empty(len(rows), dtype=np.int32)
        waiting = [(0, np.arange(len(rows)))]
        while waiting:
            node, own = waiting.pop()
            if not self.children[node]:
                out[own] = self.leaf[node]
                continue
            kids = np.array(self.children[node])
            best = np.argmax(rows[own] @ self.centres[kids].T, axis=1)
            waiting += [(int(k), own[best == i]) for i, k in enumerate(kids) if np.any(best == i)]
        return out

    def visit(self, row: np.ndarray, most: int | None = None) -> list[int]:
        """Leaves in best-bin-first order, ``most`` at most."""
        near = -(self.centres @ row)
        queue, order = [(0.0, 0)], []
        while queue and (most is None or len(order) < most):
            _, node = heapq.heappop(queue)
            while self.children[node]:  # down to a leaf by the nearest child; the others wait
                kids = sorted(self.children[node], key=near.__getitem__)
                for kid in kids[1:]:
                    heapq.heappush(queue, (near[kid], kid))
                node = kids[0]
            order.append(self.leaf[node])
        return order


@dataclass
class Index:
    """``rows``: ``leaf, v, ids`` of each distinct vector; ``visits``: leaves per search."""

    tree: Tree
    rows: DataFrame
    visits: int
    k: int


def _usable(df: DataFrame, id_: str, vector: str) -> DataFrame:
    """``id, v`` of the rows that take part."""
    rows = df.select(F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(
        F.col("id").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0)
    )
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.filter(F.size("v") == (lengths[0]["n"] if lengths else 0))


def build_index(
    df: DataFrame, id_: str = "vec_id", vector: str = "embedding", k: int = 5, leaf_rows: int = 256,
    recall: float = 0.95,
) -> Index | None:
    """An index for answers of up to ``k`` neighbours; None if no vector takes part."""
    spark = df.sparkSession
    ship_package(spark)
    rows = _usable(df, id_, vector)
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    if not size["n"]:
        return None
    most = max(1000, SAMPLE_BYTES // (8 * size["dim"]))
    share = min(1.0, most / size["n"])
    drawn = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    sample = unit(np.unique(matrix(drawn.select("v").limit(2 * most).toArrow().column(0)), axis=0))
    leaves = min(MAX_LEAVES, max(1, size["n"] // leaf_rows))
    tree = Tree(np.random.default_rng(0).permutation(sample), 1 / leaves)
    shared = spark.sparkContext.broadcast(tree)

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                leaf = shared.value.place(unit(matrix(batch.column(0))))
                yield pa.RecordBatch.from_arrays([pa.array(leaf), *batch.columns], ["leaf", "v", "ids"])

    # The smallest k + 1 ids of each vector: whichever of them asks, k are left.
    least = Window.partitionBy("v").orderBy("id")
    distinct = (
        rows.withColumn("nth", F.dense_rank().over(least)).filter(F.col("nth") <= k + 1)
        .groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    )
    indexed = stored(distinct.mapInArrow(place, "leaf int, v array<double>, ids array<long>"), "ann-index")
    index = Index(tree, indexed, tree.leaves, k)
    index.visits = _calibrated(index, recall)
    return index


def _calibrated(index: Index, recall: float) -> int:
    """Leaves to visit so that calibration vectors meet ``recall`` of their true neighbours."""
    spark, k = index.rows.sparkSession, index.k
    n = index.rows.count()
    share = min(1_000_000, CALIBRATION * 1_500_000 // n + 1)
    drawn = index.rows.filter(F.pmod(F.xxhash64(F.lit(1), "v"), F.lit(1_000_000)) < share).limit(CALIBRATION)
    asked = unit(matrix(drawn.select("v").toArrow().column(0))) if n > 1 else np.empty((0, 1))
    if not len(asked):
        return index.tree.leaves

    def best(batches):
        """This task's nearest k other vectors of each calibration vector, with their leaves."""
        scores, leaves = np.full((len(asked), k), -2.0), np.zeros((len(asked), k), dtype=np.int32)
        for batch in batches:
            if not batch.num_rows:
                continue
            near = asked @ unit(matrix(batch.column(1))).T
            near[near > 1 - 1e-12] = -2.0  # itself
            near = np.concatenate([scores, near], axis=1)
            leaf = np.concatenate([leaves, np.repeat(batch.column(0).to_numpy()[None, :], len(asked), 0)], axis=1)
            top = np.argsort(-near, axis=1, kind="stable")[:, :k]
            scores, leaves = np.take_along_axis(near, top, 1), np.take_along_axis(leaf, top, 1)
        q, j = np.nonzero(scores > -2)
        yield pa.RecordBatch.from_arrays(
            [pa.array(q, pa.int32()), pa.array(scores[q, j]), pa.array(leaves[q, j])], ["q", "score", "leaf"]
        )

    found = index.rows.select("leaf", "v").mapInArrow(best, "q int, score double, leaf int")
    nearest = Window.partitionBy("q").orderBy(F.desc("score"))
    true = found.withColumn("nth", F.row_number().over(nearest)).filter(F.col("nth") <= k).collect()
    needed = []
    for q in {r["q"] for r in true}:
        turn = {leaf: i for i, leaf in enumerate(index.tree.visit(asked[q]), 1)}
        needed += [turn[r["leaf"]] for r in true if r["q"] == q]
    visits, needed = 1, np.array(needed)
    while visits < index.tree.leaves and np.mean(needed <= visits) < recall:
        visits += 1
    return visits


def _scored(rows: pa.Table, searches: pa.Table, k: int) -> pa.Table:
    """The best k + 1 ids in this bin for each search of this block, in the leaves that it visits."""
    rows = rows.sort_by("leaf")
    v, asked = scaled(matrix(rows.column("v"))), scaled(matrix(searches.column("v")))
    ids, names = rows.column("ids").to_pylist(), searches.column("search").to_pylist()
    leaves, first = np.unique(rows.column("leaf").to_numpy(), return_index=True)
    bounds = [*zip(first.tolist(), [*first[1:].tolist(), len(v)])]
    visits = searches.column("leaves").to_pylist()
    norm_v, norm_q = np.sqrt((v * v).sum(axis=1)), np.sqrt((asked * asked).sum(axis=1))
    unit_v, unit_q = v / norm_v[:, None], asked / norm_q[:, None]
    out: list[tuple] = []
    for low in range(0, len(asked), AT_ONCE):
        part = unit_q[low : low + AT_ONCE]
        visited = np.array([np.isin(leaves, x) for x in visits[low : low + AT_ONCE]])
        near = np.full((len(part), len(v)), -2.0)
        for (begin, end), there in zip(bounds, visited.T):
            near[there, begin:end] = part[there] @ unit_v[begin:end].T
        for q, line in enumerate(near, low):
            keep = min(k + 1, len(v))
            least = max(np.partition(line, len(v) - keep)[len(v) - keep] - 1e-9, -1.5)
            own = np.flatnonzero(line >= least)
            exact = (v[own] * asked[q]).sum(axis=1) / (norm_v[own] * norm_q[q])
            pairs = sorted((-s, i) for s, at in zip(exact.tolist(), own.tolist()) for i in ids[at])[: k + 1]
            out += [(names[q], -s, i) for s, i in pairs]
    columns = list(zip(*out)) or [[], [], []]
    return pa.table({"search": pa.array(columns[0], pa.int64()), "score": pa.array(columns[1], pa.float64()),
                     "id": pa.array(columns[2], pa.int64())})


def nearest(
    index: Index, queries: DataFrame, id_: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` nearest rows but itself, nearest first."""
    spark, k, tree, visits = index.rows.sparkSession, index.k, index.tree, index.visits
    dim = tree.centres.shape[1]
    asking = stored(_usable(queries, id_, vector).filter(F.size("v") == dim).withColumn(
        "search", F.xxhash64("v", F.reverse("v"))), "ann-queries")
    # One search for all queries with the same vector.
    searches = asking.dropDuplicates(["search"]).select("search", "v")
    # Places of the leaves in one row of all vectors, which is cut into bins of ``width``.
    sizes = np.zeros(tree.leaves, dtype=np.int64)
    for row in index.rows.groupBy("leaf").count().collect():
        sizes[row["leaf"]] = row["count"]
    starts = np.cumsum(sizes) - sizes
    n = int(sizes.sum())
    width = -(-n // max(-(-n // BIN_ROWS), LEAST_BINS))
    shared = spark.sparkContext.broadcast((tree, starts // width, (starts + sizes - 1) // width, sizes > 0))

    def route(batches):
        """One row per search and bin: the leaves to visit there."""
        tree_, first, last, filled = shared.value
        for batch in batches:
            rows = unit(matrix(batch.column(1))) if batch.num_rows else []
            for at, row in enumerate(rows):
                leaf = np.array(tree_.visit(row, visits))
                leaf = leaf[filled[leaf]]
                spans = last[leaf] - first[leaf] + 1
                of = np.repeat(leaf, spans)
                bins = np.repeat(first[leaf] - np.cumsum(spans) + spans, spans) + np.arange(len(of))
                order = np.argsort(bins, kind="stable")
                met, begin = np.unique(bins[order], return_index=True)
                ends = pa.array(np.append(begin, len(of)), pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.array(of[order], pa.int32()))
                taken = batch.take(pa.array(np.full(len(met), at)))
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array(met, pa.int64()), lists], ["search", "v", "bin", "leaves"]
                )

    routed = stored(searches.mapInArrow(route, "search long, v array<double>, bin long, leaves array<int>"), "ann-searches")
    blocks = routed.groupBy("bin").agg(F.ceil(F.count("*") / BLOCK_SEARCHES).cast("int").alias("blocks"))
    # A row per leaf, as many as the tree has, which goes to every task anyway.
    places = F.broadcast(spark.createDataFrame(
        [(i, int(a), int(c)) for i, (a, c) in enumerate(zip(starts, sizes)) if c], "leaf int, start long, size long"))
    place = F.col("start") + F.pmod(F.xxhash64("v"), F.col("size"))
    binned = index.rows.join(places, "leaf").select("leaf", "v", "ids", F.floor(place / width).cast("long").alias("bin"))
    left = binned.join(blocks, "bin").withColumn("s", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = routed.join(blocks, "bin").withColumn("s", F.pmod(F.xxhash64("search"), F.col("blocks")).cast("int"))
    left, right = left.drop("blocks").groupBy("bin", "s"), right.drop("blocks").groupBy("bin", "s")

    def score(rows: pa.Table, searches: pa.Table) -> pa.Table:
        if not rows.num_rows or not searches.num_rows:
            return pa.table({"search": pa.array([], pa.int64()), "score": pa.array([], pa.float64()),
                             "id": pa.array([], pa.int64())})
        return _scored(rows, searches, k)

    found = left.cogroup(right).applyInArrow(score, "search long, score double, id long")
    best = Window.partitionBy("search").orderBy(F.desc("score"), "id")
    top = (
        found.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k + 1)
        .groupBy("search").agg(F.sort_array(F.collect_list(F.struct("nth", "id", "score"))).alias("found"))
    )
    answers = asking.select("search", F.col("id").alias("query_id")).distinct().join(top, "search")
    others = F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k)
    return answers.select("query_id", F.posexplode(others).alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), F.col("hit.score").alias("score")
    )
