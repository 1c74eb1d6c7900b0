"""Graphs as edge tables: (src, dst), or with labels (src_label, src, edge_label, dst_label, dst)."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Direction(Enum):
    OUT = "out"
    IN = "in"
    BOTH = "both"


def neighbors(edges: DataFrame, starts: DataFrame, vertex: str = "id") -> DataFrame:
    """The rows of ``starts``, once for each out-neighbour, as ``neighbor``; unknown vertices have none."""
    return starts.join(edges.select(F.col("src").alias(vertex), F.col("dst").alias("neighbor")), vertex)


def count_neighbors(edges: DataFrame) -> DataFrame:
    """src, degree of vertices with out-edges."""
    return edges.groupBy("src").agg(F.count("*").alias("degree"))


def vertices(edges: DataFrame) -> DataFrame:
    """id of every vertex, pure targets included."""
    return edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()


def totals(edges: DataFrame) -> DataFrame:
    """One row: total_vertices, total_edges."""
    return vertices(edges).agg(F.count("*").alias("total_vertices")).crossJoin(edges.agg(F.count("*").alias("total_edges")))


def sample_vertices(edges: DataFrame, size: int, ratio: float, seed: int = 0) -> DataFrame:
    """At most ``size`` vertices, each taken with probability ``ratio``: by a hash, so the same ones however rows are dealt."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")))
    taken = F.conv(F.substring(h, 1, 8), 16, 10).cast("long") < ratio * 2**32
    return vertices(edges).where(taken).orderBy(h).limit(size)


def k_hop(edges: DataFrame, starts: DataFrame, k: int, vertex: str = "id") -> DataFrame:
    """A row for each walk of ``k`` edges: the columns of ``starts`` and its end as ``neighbor``; k = 0 gives none."""
    if k < 1:
        return neighbors(edges, starts.limit(0), vertex)
    step = edges.select(F.col("src").alias("_at"), F.col("dst").alias("_to"))
    out = neighbors(edges, starts, vertex)
    for _ in range(k - 1):
        out = out.withColumnRenamed("neighbor", "_at").join(step, "_at").drop("_at").withColumnRenamed("_to", "neighbor")
    return out


def k_hop_counts(edges: DataFrame, starts: DataFrame, k: int, vertex: str = "id", keep_zero: bool = True) -> DataFrame:
    """vertex, walks: the number of walks of ``k`` edges from each start, counted without making them.

    Walks are counted from their ends: w_k(v) is the sum of w_{k-1} over v's out-edges, so each hop is one sum over vertices
    whatever the number of walks. Starts that repeat share a row; ``keep_zero`` keeps starts without walks.
    """
    walks = None
    for _ in range(k):
        if walks is None:
            walks = edges.groupBy("src").agg(F.count("*").alias("walks"))
        else:
            walks = edges.join(walks.select(F.col("src").alias("dst"), "walks"), "dst").groupBy("src").agg(F.sum("walks").alias("walks"))
    own = starts.select(vertex).distinct()
    if walks is None:
        return own.select(vertex, F.lit(0).cast("long").alias("walks")).where(F.lit(keep_zero))
    out = own.join(walks.select(F.col("src").alias(vertex), "walks"), vertex, "left" if keep_zero else "inner")
    return out.select(vertex, F.coalesce("walks", F.lit(0)).cast("long").alias("walks"))


def labeled(edges: DataFrame, src_label: str, edge_label: str, dst_label: str, both: bool = False) -> DataFrame:
    """A labelled topology from (src, dst); with ``both`` the edges have no direction and count either way."""
    out = edges.select(F.lit(src_label).alias("src_label"), "src", F.lit(edge_label).alias("edge_label"), F.lit(dst_label).alias("dst_label"), "dst")
    return out.unionAll(out.select(F.col("dst_label").alias("src_label"), F.col("dst").alias("src"), "edge_label", F.col("src_label").alias("dst_label"), F.col("src").alias("dst"))) if both else out


def labeled_neighbors(topology: DataFrame, starts: DataFrame, direction: Direction = Direction.OUT, edge_label: str | None = None) -> DataFrame:
    """The rows of ``starts`` (label, id) once for each neighbour (neighbor_label, neighbor, edge_label), true labels both ways."""
    own = topology if edge_label is None else topology.where(F.col("edge_label") == edge_label)
    out = own.select(F.col("src_label").alias("label"), F.col("src").alias("id"), "edge_label", F.col("dst_label").alias("neighbor_label"), F.col("dst").alias("neighbor"))
    back = own.select(F.col("dst_label").alias("label"), F.col("dst").alias("id"), "edge_label", F.col("src_label").alias("neighbor_label"), F.col("src").alias("neighbor"))
    ways = {Direction.OUT: out, Direction.IN: back}.get(direction)
    return starts.join(out.unionAll(back) if ways is None else ways, ["label", "id"])


def count_all_edges(topology: DataFrame, starts: DataFrame, direction: Direction = Direction.BOTH) -> DataFrame:
    """label, id, degree of each start; 0 without edges or for an unknown label."""
    n = labeled_neighbors(topology, starts.select("label", "id").distinct(), direction).groupBy("label", "id").agg(F.count("*").alias("n"))
    return starts.join(n, ["label", "id"], "left").select("label", "id", F.coalesce("n", F.lit(0)).alias("degree"))


def vertices_by_ids(table: DataFrame, ids: DataFrame) -> DataFrame:
    """Property rows of the vertices (id) asked for."""
    return table.join(ids.select("id").distinct(), "id", "left_semi")


def filter_vertex(table: DataFrame, ids: DataFrame, condition: Column | str) -> DataFrame:
    """Those of the vertices asked for whose properties meet a condition."""
    return vertices_by_ids(table, ids).where(F.expr(condition) if isinstance(condition, str) else condition)


def ordered(table: DataFrame, *order: tuple[str, bool]) -> DataFrame:
    """Vertices by (property, ascending) keys."""
    return table.orderBy(*(F.col(p).asc() if up else F.col(p).desc() for p, up in order))
