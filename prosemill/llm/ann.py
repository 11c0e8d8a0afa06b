"""Nearest neighbours by cosine with a hierarchical k-means tree.

The tree is fitted in two steps. A bounded sample of distinct unit vectors
gives its upper part; every vector is dealt to a leaf of it, and each leaf is
split further by k-means on its own vectors, a bounded number of them, where
they are. So leaves stay small as the table grows, up to MOST_NUMBERS numbers
in all centres, which bounds what is broadcast.

A query walks the tree best bin first: one priority queue holds all branches
not taken, by the best score that a branch of that mean, spread and number of
vectors may be expected to hold, and leaves come off it until those visited
hold as many vectors as the calibration found necessary. The calibration
compares a bounded set of queries with an exact search over all vectors, and
widens the visits until the wanted recall is reached.

Neighbouring leaves make a cell of a bounded number of vectors. Queries meet
cells in blocks of bounded size and are compared with the leaves they asked
for only. Equal vectors are searched once: of each only the k + 1 smallest ids
can be in an answer.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, spread_join, stage, unit

#: Vectors that the upper tree and the split of a leaf are fitted on, branches of a node, vectors of a leaf, calibration queries, wanted recall.
SAMPLE, SPLIT, BRANCH, LEAF, CALIBRATE, RECALL = 20_000, 8192, 16, 8, 128, 0.95
#: Vectors of the sample in a leaf of the upper tree, if it is split further: enough for a mean and a spread.
UPPER = 64
#: Numbers in the centres of all leaves: 32 MB as floats.
MOST_NUMBERS = 1 << 23
#: Vectors of a cell and queries that meet it at a time.
CELL = 2048


def proper(vec: str = "embedding") -> Column:
    """Whether a vector takes part: not null or empty, all components finite, not zero."""
    v = F.col(vec)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0)


class Node:
    """A node's centres, and the means and spreads of the vectors below them; a child is a Node or the number of a leaf."""

    def __init__(self, centre: np.ndarray, mean: np.ndarray, children: list):
        self.centre, self.mean, self.children = centre, mean, children
        self.spread = np.sqrt(np.maximum(0, 1 - (mean * mean).sum(axis=1)) / mean.shape[1])
        self.reach = self.spread


def _grow(x: np.ndarray, rows: np.ndarray, branch: int, leaf: float, rng, depth: int = 0):
    """A Node over the rows of x, or None for a leaf."""
    if len(rows) <= leaf or len(rows) < 2 or depth > 12:
        return None
    centre, label = _kmeans(x[rows], int(min(branch, max(2, len(rows) // leaf))), rng)
    used = np.unique(label)
    if len(used) < 2:
        return None
    parts = [rows[label == u] for u in used]
    mean = np.stack([x[p].mean(axis=0) for p in parts])
    return Node(centre[used].astype(np.float32), mean.astype(np.float32), [_grow(x, p, branch, leaf, rng, depth + 1) for p in parts])


class Tree:
    """Numbered leaves in the order of the tree, so that neighbours in number are neighbours in space."""

    def __init__(self, x: np.ndarray, branch: int = BRANCH, leaf: float = LEAF, seed: int = 5):
        self.root = _grow(x, np.arange(len(x)), branch, leaf, np.random.default_rng(seed))
        self.number()

    def number(self) -> None:
        self.leaves = 0

        def walk(node):
            if not isinstance(node, Node):
                self.leaves += 1
                return self.leaves - 1
            node.children = [walk(c) for c in node.children]
            return node

        self.root = walk(self.root)

    def split(self, parts: dict[int, Node]) -> None:
        """Put a node in the place of some leaves."""

        def walk(node):
            if not isinstance(node, Node):
                return parts.get(node, node)
            node.children = [walk(c) for c in node.children]
            return node

        self.root = walk(self.root)
        self.number()

    def fill(self, filled: np.ndarray) -> None:
        """Take in how many vectors each leaf holds."""
        self.filled = filled

        def walk(node) -> int:
            if not isinstance(node, Node):
                return int(filled[node])
            below = np.array([walk(c) for c in node.children])
            # The largest of so many draws is about this many deviations above their mean.
            node.reach = np.where(below > 0, node.spread * np.sqrt(2 * np.log(np.maximum(below, 2))), -np.inf)
            return int(below.sum())

        walk(self.root)

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each unit vector: down the nearest centres."""
        out = np.empty(len(x), dtype=np.int32)

        def down(node, rows):
            if not isinstance(node, Node):
                out[rows] = node
            elif len(rows):
                best = (x[rows] @ node.centre.T).argmax(axis=1)
                for i, child in enumerate(node.children):
                    down(child, rows[best == i])

        down(self.root, np.arange(len(x)))
        return out

    def visits(self, q: np.ndarray, budget: float) -> list[int]:
        """Leaves in best-bin-first order until those visited hold `budget` vectors."""
        heap, out, got, tie = [(-np.inf, 0, self.root)], [], 0, 0
        while heap and got < budget:
            key, _, node = heapq.heappop(heap)
            if not isinstance(node, Node):
                if self.filled[node]:
                    out.append(node)
                    got += int(self.filled[node])
                continue
            for score, child in zip((node.mean @ q + node.reach).tolist(), node.children, strict=True):
                if score > -np.inf:
                    tie += 1
                    heapq.heappush(heap, (-score, tie, child))
        return out


def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: (centres, label of each row)."""
    centre = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        label = (x @ centre.T).argmax(axis=1)
        sums = np.zeros_like(centre)
        np.add.at(sums, label, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centre = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centre)
    return centre, (x @ centre.T).argmax(axis=1)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _units(x: np.ndarray) -> np.ndarray:
    if not len(x):
        return x
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """(queries, vectors) in double precision on the original vectors."""
    qs, xs = np.abs(q).max(axis=1), np.abs(x).max(axis=1)
    q, x = q / qs[:, None], x / xs[:, None]
    return np.clip((q @ x.T) / (np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((x * x).sum(axis=1))[None, :]), -1, 1)


def _tree(table: DataFrame, n: int, dim: int) -> Tree:
    """The tree over the n distinct vectors of table (h, u, v)."""
    spark = table.sparkSession
    part = table.select("h", "v") if n <= SAMPLE else table.where(unit("h") < 1.2 * SAMPLE / n).orderBy(F.xxhash64("h")).limit(SAMPLE).select("h", "v")
    tree = Tree(_units(_matrix(part.orderBy("h").toArrow()["v"], dim)), leaf=LEAF if n <= SAMPLE else UPPER)
    if n <= SAMPLE:
        return tree
    size = max(float(LEAF), n * dim / MOST_NUMBERS)
    shared = spark.sparkContext.broadcast(tree)

    def place(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shared.value.place(_units(_matrix(b.column(1), dim))), pa.int32())], names=["h", "v", "leaf"])

    dealt = stage(table.select("h", "v").mapInArrow(place, "h string, v array<double>, leaf int"))
    count = dealt.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * size)

    def divide(key, rows):
        held = int(rows["n"][0].as_py())
        x = _units(_matrix(rows.sort_by("h")["v"], dim))
        node = _grow(x, np.arange(len(x)), BRANCH, size * len(x) / held, np.random.default_rng(5))
        return pa.table({"leaf": pa.array([key[0].as_py()], pa.int32()), "node": pa.array([pickle.dumps(node)], pa.binary())})

    # So many of each leaf's vectors as SPLIT on average, by hash; their sum is bounded as the leaves' number is.
    some = dealt.join(F.broadcast(count), "leaf").where(unit("h", F.lit(1)) < SPLIT / F.col("n")).select("leaf", "n", "h", "v")
    tree.split({r["leaf"]: pickle.loads(r["node"]) for r in some.groupBy("leaf").applyInArrow(divide, "leaf int, node binary").toLocalIterator()})
    return tree


def search(vectors: DataFrame, is_query: Column, k: int = 5, vid: str = "vec_id", vec: str = "embedding", recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score, visited): the k nearest other rows of each query row, ties to the smaller id.

    visited is the share of all distinct vectors that the query was compared
    with. Rows whose vector is null, empty or zero, or holds a null or a number
    that isn't finite, take no part, and neither do rows without an id, or of
    another length than most. Repeated rows count once. Fewer than k other rows
    give fewer answers; an empty table none. Other columns aren't read, so none
    of them can clash.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.where(F.col(vid).isNotNull() & proper(vec)).select(F.col(vid).cast("long").alias("vec_id"), F.col(vec).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    top = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if top is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, visited double")
    dim = top["dim"]
    rows = rows.where(F.size("v") == dim).withColumn("h", F.sha2(F.array_join("v", ","), 256))
    # The k + 1 smallest ids of each distinct vector; the limit is applied before rows are shuffled, too.
    ids = stage(rows.select("h", "vec_id", "is_query").distinct())
    least = stage(ids.withColumn("i", F.row_number().over(Window.partitionBy("h").orderBy("vec_id"))).where(F.col("i") <= k + 1).select("h", "vec_id", "i"))
    asked = stage(ids.where("is_query").select("h", F.col("vec_id").alias("query_id")))
    # One row for each distinct vector, numbered as its table is written.
    distinct = rows.join(least.where("i = 1").select("h", "vec_id"), ["h", "vec_id"], "left_semi").dropDuplicates(["h", "vec_id"]).select("h", "v")
    asked_h = asked.select("h").distinct().withColumn("asked", F.lit(True))
    table = stage(distinct.join(asked_h, "h", "left").select("h", "v", F.coalesce("asked", F.lit(False)).alias("asked")).withColumn("u", F.monotonically_increasing_id()))

    n = table.count()
    tree = _tree(table, n, dim)
    shared = spark.sparkContext.broadcast(tree)

    def place(batches):
        for b in batches:
            leaf = shared.value.place(_units(_matrix(b.column(1), dim)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(leaf, pa.int32())], names=["u", "v", "asked", "leaf"])

    placed = stage(table.select("u", "v", "asked").mapInArrow(place, "u long, v array<double>, asked boolean, leaf int"))
    filled = np.zeros(tree.leaves, dtype=np.int64)
    for r in placed.groupBy("leaf").count().collect():
        filled[r["leaf"]] = r["count"]
    tree.fill(filled)
    budget = _calibrated(placed, tree, k + 1, recall, dim)
    # Cells are runs of leaves; a leaf of more vectors than a cell's is dealt into blocks.
    cell = ((np.cumsum(filled) - filled // 2) // CELL).astype(np.int32)
    blocks = np.maximum(1, -(-np.bincount(cell, filled).astype(np.int64) // (2 * CELL)))
    known = spark.sparkContext.broadcast((tree, budget, cell, blocks))

    def visit(batches):
        tree, budget, cell, blocks = known.value
        for b in batches:
            take, cells, block, leaves, share = [], [], [], [], []
            x = _units(_matrix(b.column(1), dim))
            for i, q in enumerate(x):
                seen = np.array(tree.visits(q, budget), dtype=np.int32)
                part = tree.filled[seen].sum() / tree.filled.sum()
                order = np.sort(seen)
                at = np.flatnonzero(np.diff(cell[order], prepend=-1))
                for s, e in zip(at, [*at[1:], len(order)], strict=True):
                    c = int(cell[order[s]])
                    for j in range(int(blocks[c])):
                        take.append(i)
                        cells.append(c)
                        block.append(j)
                        leaves.append(order[s:e])
                        share.append(part)
            i = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(i), b.column(1).take(i), pa.array(cells, pa.int32()), pa.array(block, pa.int32()), pa.array(leaves, pa.list_(pa.int32())), pa.array(share, pa.float64())],
                names=["q", "v", "cell", "block", "leaves", "visited"],
            )

    visits = stage(placed.where("asked").select("u", "v").mapInArrow(visit, "q long, v array<double>, cell int, block int, leaves array<int>, visited double"))
    # Of many queries in a cell, CELL at a time: so many copies of its vectors as the queries need.
    turns = visits.groupBy("cell", "block").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("turns"))
    turns = F.broadcast(turns)  # a row for each block of a cell
    asking = visits.join(turns, ["cell", "block"]).withColumn("turn", F.pmod(F.xxhash64("q"), F.col("turns")).cast("int"))
    by_leaf = F.broadcast(spark.createDataFrame([(i, int(c), int(blocks[c])) for i, c in enumerate(cell)], "leaf int, cell int, blocks int"))  # bounded as the leaves are
    members = placed.join(by_leaf, "leaf").withColumn("block", F.pmod(F.xxhash64("u"), F.col("blocks")).cast("int")).join(turns, ["cell", "block"])
    members = members.withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).select("u", "v", "leaf", "cell", "block", "turn")

    def meet(left, right):
        if not len(left) or not len(right):
            return pa.table({"q": pa.array([], pa.int64()), "u": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        q, x = _matrix(left["v"], dim), _matrix(right["v"], dim)
        want = left["leaves"].combine_chunks()
        who = np.repeat(np.arange(len(q)), np.diff(want.offsets.to_numpy()))
        asks = want.flatten().to_numpy()
        by = np.argsort(asks, kind="stable")
        who, asks = who[by], asks[by]
        leaf = right["leaf"].to_numpy()
        order = np.argsort(leaf, kind="stable")
        held = leaf[order]
        out = []
        for at in np.unique(leaf):
            a, b = np.searchsorted(held, (at, at + 1))
            s, e = np.searchsorted(asks, (at, at + 1))
            if s < e:
                score = cosine(q[who[s:e]], x[order[a:b]])
                out.append((np.repeat(who[s:e], b - a), np.tile(order[a:b], e - s), score.ravel()))
        i, j, score = (np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        # Ties at the edge all stay: which of them has the smaller id is settled later.
        by = np.lexsort((-score, i))
        i, j, score = i[by], j[by], score[by]
        first = np.searchsorted(i, i)
        edge = score[np.minimum(first + k, np.searchsorted(i, i, "right") - 1)]
        on = score >= edge
        return pa.table({"q": left["q"].to_numpy()[i[on]], "u": right["u"].to_numpy()[j[on]], "score": score[on]})

    keys = ("cell", "block", "turn")
    near = stage(asking.select("q", "v", "leaves", *keys).groupBy(*keys).cogroup(members.groupBy(*keys)).applyInArrow(meet, "q long, u long, score double"))
    ids_of = table.select("u", "h").join(least, "h").select("u", "vec_id", "i")
    cand = spread_join(near, ids_of, ["u"]).select("q", "score", "vec_id")
    best = cand.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1).select("q", "score", "vec_id")
    share = visits.groupBy("q").agg(F.max("visited").alias("visited"))
    best = best.groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("d"), "vec_id"))).alias("near")).join(share, "q")
    best = stage(best.join(table.where("asked").select(F.col("u").alias("q"), "h"), "q").select("h", "near", "visited"))
    answers = spread_join(asked, best, ["h"]).select("query_id", "visited", F.expr(f"slice(filter(near, x -> x.vec_id <> query_id), 1, {k})").alias("near"))
    return answers.select("query_id", "visited", F.posexplode("near").alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), "x.vec_id", (-F.col("x.d")).alias("score"), "visited")


def _calibrated(placed: DataFrame, tree: Tree, k: int, recall: float, dim: int) -> float:
    """How many vectors the visited leaves must hold for the wanted recall, with a tenth to spare."""
    spark = placed.sparkSession
    asked = placed.where("asked").orderBy(F.xxhash64("v")).limit(CALIBRATE).select("v").toArrow()
    if not asked.num_rows:
        return 1.0
    q = _matrix(asked["v"], dim)
    shared = spark.sparkContext.broadcast(q)

    def exact(batches):
        for b in batches:
            if not b.num_rows:
                continue
            s = cosine(shared.value, _matrix(b.column(0), dim))
            most = min(k, s.shape[1])
            top = np.argpartition(-s, most - 1, axis=1)[:, :most]
            i = np.repeat(np.arange(len(s)), most)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(np.take_along_axis(s, top, 1).ravel()), b.column(1).take(pa.array(top.ravel()))], names=["q", "score", "leaf"])

    found = placed.select("v", "leaf").mapInArrow(exact, "q long, score double, leaf int")
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "leaf"))).where(F.col("r") <= k).select("q", "r", "leaf").toPandas()
    # A query finds itself; what it must reach are the others.
    need: list[int] = []
    for i, group in best[best["r"] > 1].groupby("q"):
        order = tree.visits(_units(q[i : i + 1])[0], float("inf"))
        before = dict(zip(order, np.cumsum(tree.filled[order]) - tree.filled[order], strict=True))
        need += [before[x] + 1 for x in group["leaf"]]
    return min(float(tree.filled.sum()), 1.1 * float(np.quantile(need, recall, method="higher"))) if need else 1.0
