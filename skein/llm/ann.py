"""Approximate nearest neighbours by cosine: a hierarchical k-means tree, searched best bin first.

The top of the tree is fitted on at most about ``sample`` vectors; every vector is put into one of its cells. A cell of more than
``piece`` vectors gets a subtree of its own, fitted by one task on at most about ``sample`` vectors of the cell, so that the number
of leaves grows with the input; a subtree stays with its cell and never comes to the driver. A cell without one is a leaf.

A query goes down to the nearest child, keeping the siblings in a priority queue, and takes leaves in the order in which the
queue yields them; leaves of subtrees of all visited cells are put into one order by their distance. How many cells and leaves
are visited is calibrated: for about ``probes`` of the queries the true neighbours are found among all vectors, and visits
widen to the least numbers that hold ``recall`` of them.

Leaves are cut into pieces of about ``piece`` vectors, and the queries of a leaf into groups of about ``piece``, so a leaf with a
third of all vectors is many tasks; each piece gives its best ``k``, which are merged. Scores are cosines in double precision,
computed row by row from the original vectors, so equal vectors tie exactly; ties go to the smaller vec_id.

Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without vec_id or of
another length than most vectors. Rows that repeat a vec_id are candidates each, and one query (the least vector).
Leaves are visited until they hold ``k`` candidates at least, so a query gets all there are if they are fewer.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.session import checkpoint

from . import _bytes as B


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Labels; centres start at distinct rows, empty ones are left out."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        label = (x @ centres.T - (centres * centres).sum(1) / 2).argmax(1)
        used, label = np.unique(label, return_inverse=True)
        sums = np.zeros((len(used), x.shape[1]), np.float64)
        np.add.at(sums, label, x)
        centres = (sums / np.bincount(label)[:, None]).astype(np.float32)
    return (x @ centres.T - (centres * centres).sum(1) / 2).argmax(1)


class Tree:
    """children[node] are node numbers; a node without children is a leaf, numbered by leaf[node]."""

    def __init__(self, x: np.ndarray, branch: int, leaf_rows: int, most_leaves: int) -> None:
        self.centre: list[np.ndarray] = [x.mean(0) if len(x) else np.zeros(0, np.float32)]
        self.children: list[list[int]] = [[]]
        todo = [(-len(x), 0, np.arange(len(x)))]
        leaves = 1
        while todo and leaves + branch <= most_leaves:  # the largest part first
            n, node, own = heapq.heappop(todo)
            if -n <= leaf_rows:
                break
            label = _kmeans(x[own], branch, node)
            parts = [own[label == c] for c in np.unique(label)]
            if len(parts) < 2:  # equal vectors
                continue
            for p in parts:
                self.children[node].append(len(self.centre))
                heapq.heappush(todo, (-len(p), len(self.centre), p))
                self.centre.append(x[p].mean(0))
                self.children.append([])
            leaves += len(parts) - 1
        self.centres = np.array(self.centre, np.float32)
        self._number()

    def _number(self) -> None:
        self.half = (self.centres * self.centres).sum(1) / 2
        self.leaf = np.full(len(self.children), -1)
        self.ends = np.array([i for i, c in enumerate(self.children) if not c])
        self.leaf[self.ends] = np.arange(len(self.ends))
        self.leaves = len(self.ends)

    def packed(self) -> bytes:
        return pickle.dumps((self.centres, self.children))

    @classmethod
    def unpacked(cls, data: bytes) -> Tree:
        tree = cls.__new__(cls)
        tree.centres, tree.children = pickle.loads(data)
        tree._number()
        return tree

    def far(self, q: np.ndarray, leaves: list[int]) -> np.ndarray:
        """Distances of leaves from a query, but for what is the same for all of them."""
        at = self.ends[leaves]
        return (self.half[at] - self.centres[at] @ q).astype(np.float64)

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        node = np.zeros(len(x), np.int64)
        open_ = np.arange(len(x))
        while len(open_):
            for n in np.unique(node[open_]):
                own = open_[node[open_] == n]
                if kids := self.children[n]:
                    node[own] = np.array(kids)[(x[own] @ self.centres[kids].T - self.half[kids]).argmax(1)]
            open_ = open_[[bool(self.children[n]) for n in node[open_]]]
        return self.leaf[node]

    def order(self, q: np.ndarray, most: int, held: np.ndarray | None = None, need: int = 0) -> list[int]:
        """The first ``most`` leaves, best bin first, and more until they hold ``need`` vectors."""
        out: list[int] = []
        queue = [(0.0, 0)]
        have = 0
        while queue and (len(out) < most or have < need):
            _, node = heapq.heappop(queue)
            while kids := self.children[node]:
                far = self.half[kids] - self.centres[kids] @ q
                best = int(far.argmin())
                for i, c in enumerate(kids):
                    if i != best:
                        heapq.heappush(queue, (float(far[i]), c))
                node = kids[best]
            out.append(int(self.leaf[node]))
            have += int(held[out[-1]]) if held is not None else 0
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their greatest component near one: cosines stay, squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True, initial=0))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)


def best(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, vec id, score) of the ``k`` nearest rows of each query, not counting its own id.

    A matrix product finds what may be among them; those within a rounding error of the k-th are scored exactly.
    """
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    queries, rows = _scaled(queries), _scaled(rows)
    unit, length = rows / np.sqrt((rows * rows).sum(1, keepdims=True)), np.sqrt((rows * rows).sum(1))
    for a in range(0, len(queries), 256):
        q, ids = queries[a : a + 256], query_ids[a : a + 256]
        near = (q / np.sqrt((q * q).sum(1, keepdims=True))) @ unit.T
        near[ids[:, None] == row_ids[None, :]] = -np.inf
        n = min(k, near.shape[1])
        edge = np.partition(near, near.shape[1] - n, axis=1)[:, near.shape[1] - n]
        for i in range(len(q)):
            own = np.flatnonzero((near[i] >= edge[i] - 1e-9) & np.isfinite(near[i]))
            score = (rows[own] * q[i]).sum(1) / (length[own] * np.sqrt((q[i] * q[i]).sum()))
            order = np.lexsort((row_ids[own], -score))[:k]
            out.append((np.full(len(order), ids[i]), row_ids[own][order], score[order]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


HIT = "query_id long, vec_id long, score double"
#: A leaf's number is that of its cell times this, and its place in the cell's subtree.
LEAVES = 1 << 16
#: Sampled vectors of a subtree's leaf, at least.
LEAST_LEAF = 8
#: Vectors or queries of a split cell that one task takes through its subtree.
CHUNK = 16_384
#: Leaves of several pieces whose table is broadcast (counted first); more are joined by a merge.
BROADCAST_LEAVES = 200_000


def _assign(tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = tree.value.place(_unit(_matrix(batch.column("v")))) if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], names=[*batch.schema.names, "cell"])

    return run


def _visits(tree, most: int, held: np.ndarray, need: int):
    """Cells of a query and their distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit(_matrix(batch.column("v"))) if len(batch) else []
            cells = [tree.value.order(q, most, held, need) for q in x]
            far = [tree.value.far(q, c) for q, c in zip(x, cells, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32())), pa.array(far, pa.list_(pa.float64()))], names=[*batch.schema.names, "cells", "fars"])

    return run


def _fit(branch: int, target: int, most_leaves: int):
    """A cell's subtree from a sample of its vectors, with leaves of about ``target`` of all its vectors."""

    def run(table: pa.Table) -> pa.Table:
        x = _unit(_matrix(table.column("v")))
        rows = table.column("rows")[0].as_py()
        tree = Tree(x, branch, max(LEAST_LEAF, len(x) * target // rows), most_leaves)
        return pa.table({"cell": table.column("cell")[:1].cast(pa.int32()), "model": pa.array([tree.packed()], pa.binary())})

    return run


def _place(left: pa.Table, right: pa.Table) -> pa.Table:
    """Vectors of a split cell with the leaf of its subtree."""
    if not len(left):
        return pa.table({"vec_id": pa.array([], pa.int64()), "no": pa.array([], pa.int64()), "v": pa.array([], pa.list_(pa.float64())), "leaf": pa.array([], pa.int64())})
    own = Tree.unpacked(right.column("model")[0].as_py()).place(_unit(_matrix(left.column("v"))))
    leaf = left.column("cell")[0].as_py() * LEAVES + own.astype(np.int64)
    return pa.table({"vec_id": left.column("vec_id"), "no": left.column("no"), "v": left.column("v"), "leaf": pa.array(leaf, pa.int64())})


def _within(most: int | None):
    """The first ``most`` leaves (None: all) that hold vectors, of a split cell's subtree for each query."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, leaves, fars = [], [], []
        if len(left) and len(right):
            tree = Tree.unpacked(right.column("model")[0].as_py())
            cell = right.column("cell")[0].as_py()
            held = np.zeros(tree.leaves, np.int64)
            held[[x % LEAVES for x in right.column("used")[0].as_py()]] = 1
            for i, q in zip(left.column("query_id").to_pylist(), _unit(_matrix(left.column("v"))), strict=True):
                # one vector a leaf is counted: that many leaves with vectors are seen
                own = [x for x in tree.order(q, 0, held, int(held.sum()) if most is None else min(most, int(held.sum()))) if held[x]]
                ids.append(np.full(len(own), i, np.int64))
                leaves.append(cell * LEAVES + np.array(own, np.int64))
                fars.append(tree.far(q, own))
        ids, leaves, fars = (np.concatenate(x) if x else np.zeros(0) for x in (ids, leaves, fars))
        return pa.table({"query_id": pa.array(ids.astype(np.int64)), "leaf": pa.array(leaves.astype(np.int64)), "far": pa.array(fars.astype(np.float64))})

    return run


def _brute(probes, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = probes.value
        for batch in batches:
            if len(batch):
                a, b, s = best(q, ids, _matrix(batch.column("v")), batch.column("vec_id").to_numpy(), k)
                leaf = dict(zip(batch.column("vec_id").to_pylist(), batch.column("leaf").to_pylist(), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s), pa.array([leaf[x] for x in b.tolist()], pa.int64())], names=["query_id", "vec_id", "score", "leaf"])

    return run


def _piece(k: int):
    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        a, b, s = best(np.stack(left["v"]).astype(np.float64), left["query_id"].to_numpy(), np.stack(right["v"]).astype(np.float64), right["vec_id"].to_numpy(), k)
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": s})

    return run


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, v (array of double) of the rows that take part."""
    v = F.col(embedding).cast("array<double>")
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    own = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False)))
    size = own.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return own.where(F.size("v") == (size["n"] if size else 0))


def _enough(turns: list[int], share: float, most: int) -> int:
    """The least number of visits, at most ``most``, that reaches ``share`` of the turns (from 0)."""
    at = np.sort(turns)
    return min(most, int(at[min(len(at) - 1, int(np.ceil(share * len(at))))]) + 1) if len(at) else most


def _sizes(split: dict[int, int], spark, sample: int) -> DataFrame:
    """cell, rows, step, chunks of the split cells: no more rows than the top has cells."""
    rows = [(c, n, -(-n // sample), -(-n // CHUNK)) for c, n in split.items()]
    return F.broadcast(spark.createDataFrame(rows, "cell int, rows long, step long, chunks int"))


def _split(placed: DataFrame, split: dict[int, int], sample: int, branch: int, target: int, most_leaves: int) -> tuple[DataFrame, DataFrame]:
    """(vec_id, no, v, leaf) of all vectors, and (cell, model, used leaves) of the split cells."""
    spark = placed.sparkSession
    sizes = _sizes(split, spark, sample)
    inside = placed.join(sizes, "cell")
    models = inside.where(F.pmod(F.xxhash64("no"), "step") == 0).select("cell", "rows", "v").groupBy("cell").applyInArrow(_fit(branch, target, most_leaves), "cell int, model binary")
    models = checkpoint(models)
    left = inside.withColumn("chunk", F.pmod(F.xxhash64(F.lit(1), "no"), "chunks").cast("int")).select("cell", "chunk", "vec_id", "no", "v")
    right = models.join(sizes, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "model")
    schema = "vec_id long, no long, v array<double>, leaf long"
    deep = left.groupBy("cell", "chunk").cogroup(right.groupBy("cell", "chunk")).applyInArrow(_place, schema)
    flat = placed.join(sizes, "cell", "left_anti").select("vec_id", "no", "v", (F.col("cell").cast("long") * LEAVES).alias("leaf"))
    placed = checkpoint(deep.unionAll(flat))
    used = placed.select("leaf").distinct().groupBy((F.col("leaf") / LEAVES).cast("int").alias("cell")).agg(F.collect_list("leaf").alias("used"))
    return placed, checkpoint(models.join(used.hint("merge"), "cell"))


def _leaves(cells: DataFrame, models: DataFrame, split: dict[int, int], most: int | None) -> DataFrame:
    """query_id, leaf, far: the cells of queries that are leaves, and the first ``most`` leaves of those that have a subtree."""
    spark = cells.sparkSession
    sizes = _sizes(split, spark, 1)
    inside = cells.join(sizes, "cell")
    want = {r["cell"]: r["count"] for r in inside.groupBy("cell").count().collect()}
    groups = F.broadcast(spark.createDataFrame([(c, -(-n // CHUNK)) for c, n in want.items()], "cell int, groups int"))
    left = cells.join(groups, "cell").withColumn("g", F.pmod(F.xxhash64("query_id"), "groups").cast("int")).select("cell", "g", "query_id", "v")
    right = models.join(groups, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"), "model", "used")
    deep = left.groupBy("cell", "g").cogroup(right.groupBy("cell", "g")).applyInArrow(_within(most), "query_id long, leaf long, far double")
    return cells.join(sizes, "cell", "left_anti").select("query_id", (F.col("cell").cast("long") * LEAVES).alias("leaf"), "far").unionAll(deep)


def search(vectors: DataFrame, every: int = 50, k: int = 5, recall: float = 0.97, sample: int = 20_000, branch: int = 8, leaf_rows: int = 64, most_leaves: int = 4096, probes: int = 256, piece: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row whose vec_id is divisible by ``every``."""
    B.small_batches(vectors)
    spark = vectors.sparkSession
    sc = spark.sparkContext
    own = usable(vectors)
    rows = own.count()
    step = max(1, -(-rows // sample))
    # by the number of a row: one vec_id may be on any number of rows
    numbered = own.withColumn("no", F.monotonically_increasing_id())
    some = _matrix(numbered.where(F.pmod(F.xxhash64("no"), F.lit(step)) == 0).select("v").toArrow().column("v"))
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not len(some):
        some = _matrix(own.select("v").limit(1).toArrow().column("v"))
        if not len(some):
            return empty
    tree = B.Shared(vectors, Tree(_unit(some), branch, leaf_rows, most_leaves))
    placed = checkpoint(numbered.mapInArrow(B.tidy(_assign(tree)), "vec_id long, v array<double>, no long, cell int"))
    # sizes of cells: at most most_leaves rows
    have = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}
    held = np.array([have.get(n, 0) for n in range(tree.value.leaves)])
    split = {c: n for c, n in have.items() if n > piece}
    models = None
    if split:
        placed, models = _split(placed, split, sample, branch, piece // 4, most_leaves)
    else:
        placed = placed.select("vec_id", "no", "v", (F.col("cell").cast("long") * LEAVES).alias("leaf"))

    queries = own.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    asked = queries.count()
    if not asked:
        return empty
    chosen = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(max(1, asked // probes))) == 0).orderBy(F.xxhash64("query_id")).limit(2 * probes).toArrow()
    chosen = chosen if len(chosen) else queries.limit(1).toArrow()
    q, ids = _matrix(chosen.column("v")), chosen.column("query_id").to_numpy()
    true = placed.mapInArrow(B.tidy(_brute(sc.broadcast((ids, q)), k)), HIT + ", leaf long")
    true = true.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id", "leaf"))), 1, k).alias("top")).collect()
    true = [(r["query_id"], t["leaf"]) for r in true for t in r["top"]]
    turn = {int(i): {cell: n for n, cell in enumerate(tree.value.order(x, tree.value.leaves))} for i, x in zip(ids, _unit(q), strict=True)}
    # each of two steps may lose half of what may be lost
    visits = _enough([turn[i][leaf // LEAVES] for i, leaf in true], recall if models is None else recall**0.5, tree.value.leaves)

    def cells(of: DataFrame) -> DataFrame:
        both = of.mapInArrow(B.tidy(_visits(tree, visits, held, k + 1)), "query_id long, v array<double>, cells array<int>, fars array<double>")
        return both.select("query_id", "v", F.explode(F.arrays_zip("cells", "fars")).alias("c")).select("query_id", "v", F.col("c.cells").alias("cell"), F.col("c.fars").alias("far"))

    if models is None:
        asking = cells(queries).select("query_id", "v", (F.col("cell").cast("long") * LEAVES).alias("leaf"))
    else:
        probing = spark.createDataFrame(chosen.select(["query_id", "v"]))
        every_leaf = _leaves(cells(probing), models, split, None)
        order = every_leaf.withColumn("turn", F.row_number().over(Window.partitionBy("query_id").orderBy("far", "leaf")) - 1)
        wanted = F.broadcast(spark.createDataFrame(sorted(set(true)), "query_id long, leaf long"))  # at most 2 * probes * k rows
        found = {(r["query_id"], r["leaf"]): r["turn"] for r in order.join(wanted, ["query_id", "leaf"]).collect()}
        most = max(k + 1, _enough([found.get(t, LEAVES * tree.value.leaves) for t in true], recall, max(found.values(), default=0) + 1))
        ranked = _leaves(cells(queries), models, split, most).groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("far", "leaf"))), 1, most).alias("top"))
        asking = ranked.select("query_id", F.explode("top.leaf").alias("leaf")).join(queries.hint("merge"), "query_id")

    size = lambda df, name: df.groupBy("leaf").agg(F.ceil(F.count("*") / piece).cast("int").alias(name))
    cuts = checkpoint(size(placed, "pieces").join(size(asking, "groups").hint("merge"), "leaf").where("pieces > 1 or groups > 1"))
    cuts = F.broadcast(cuts) if cuts.count() <= BROADCAST_LEAVES else cuts.hint("merge")
    cut = lambda df: df.join(cuts, "leaf", "left").withColumns({n: F.coalesce(n, F.lit(1)) for n in ("pieces", "groups")})
    left = cut(asking).withColumn("g", F.pmod(F.xxhash64("query_id"), "groups").cast("int")).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select("leaf", "g", "p", "query_id", "v")
    right = cut(placed).withColumn("p", F.pmod(F.xxhash64("no"), "pieces").cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).select("leaf", "g", "p", "vec_id", "v")
    keys = ("leaf", "g", "p")
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_piece(k), HIT)
    # each piece's best are few; they are summed up before the final order
    top = hits.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))), 1, k).alias("top"))
    return top.select("query_id", F.posexplode("top").alias("p", "t")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("t.vec_id").alias("vec_id"), (-F.col("t.far")).alias("score"))
