"""Connected components by alternating large-star and small-star steps, or by hooking in one task where edges are few."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import checkpoint


#: Edges of a written partition: rounds on few edges shouldn't write a file for each partition of a shuffle.
PARTITION_ROWS = 500_000
#: So many edges between whole numbers (counted first; some 100 bytes each) are one task's work instead of rounds of joins.
FEW = 1_000_000


def _hook(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    both = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if len(b)]
    if not both:
        return
    ends = np.concatenate([x for x, _ in both] + [y for _, y in both])
    nodes, at = np.unique(ends, return_inverse=True)
    a, b, root = *np.split(at, 2), np.arange(len(nodes))
    while (root[a] != root[b]).any():
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "root"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 50, few: int = FEW) -> DataFrame:
    """node, root for every node of ``edges`` (a written table); the root is the least node of its component.

    A step sums over the neighbours of a node before it joins the sum back, so a node with very many neighbours is one key
    of a join that Spark can split, never one task's list.
    """
    n = edges.count()
    if n <= few and dict(edges.dtypes)[a] == dict(edges.dtypes)[b] == "bigint":
        return checkpoint(edges.select(a, b).where(F.col(a) != F.col(b)).coalesce(1).mapInArrow(_hook, "node long, root long"))
    parts = max(1, -(-n // PARTITION_ROWS))  # the number of edges never grows
    e = checkpoint(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u != v").distinct().coalesce(parts))
    state = None
    for _ in range(most_rounds):
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: all edges point to the smaller node now
        low = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = low.groupBy("u").agg(F.min("v").alias("m"))
        small = low.join(least.hint("merge"), "u").select(F.col("v").alias("u"), "m").unionAll(least.select("u", "m"))
        e = checkpoint(small.where("u != m").select(F.col("m").alias("u"), F.col("u").alias("v")).distinct().coalesce(parts))
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == now:
            break
        state = now
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    stars = e.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return stars.unionAll(e.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
