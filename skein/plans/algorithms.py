"""Programs made of flows and loops: word count, PageRank, logistic regression, breadth-first search."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.flow import Flow
from skein.session import checkpoint


def word_count(lines: Flow, text: str = "line") -> Flow:
    """word, count over words separated by single blanks; empty words are left out."""
    return lines.flat_map(F.split(text, " "), "word").filter("word != ''").key_by(word="word").reduce_by_key(count=F.count("*"))


def pagerank(edges: DataFrame, rounds: int = 10, damping: float = 0.85, least_delta: float | None = 0.001, vertex_count: int | None = None, every: int = 3) -> tuple[DataFrame, list[float]]:
    """(id, rank) and the total change of each round.

    A vertex gives its rank in equal parts to its out-neighbours; without any it gives nothing. The new rank of a vertex that
    was given something is damping * sum + (1 - damping) / N, others keep theirs. Ends after ``rounds``, or when the change
    is at most ``least_delta`` (None: not tested, ranks are written every ``every`` rounds only, to keep the plan short).
    """
    ids = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    n = vertex_count or ids.count()
    links = edges.join(edges.groupBy("src").agg(F.count("*").alias("out")), "src").groupBy("src", "dst", "out").agg(F.count("*").alias("times")).select("src", "dst", (F.col("times") / F.col("out")).alias("share"))
    links = checkpoint(links)
    ranks = checkpoint(ids.withColumn("rank", F.lit(1.0) / n))
    deltas = []
    for k in range(1, rounds + 1):
        given = links.join(ranks, links["src"] == ranks["id"]).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("sum"))
        new = ranks.join(given, ranks["id"] == given["dst"], "left").select("id", F.coalesce(damping * F.col("sum") + (1 - damping) / n, "rank").alias("rank"), F.col("rank").alias("old"))
        if least_delta is None:
            ranks = new.select("id", "rank")
            if k % every == 0 and k < rounds:
                ranks = checkpoint(ranks)
            continue
        new = checkpoint(new)
        ranks = new.select("id", "rank")
        deltas.append(new.agg(F.coalesce(F.sum(F.abs(F.col("rank") - F.col("old"))), F.lit(0.0))).first()[0])
        if deltas[-1] <= least_delta:
            break
    return ranks, deltas


def gradient(samples: DataFrame, features: Iterable[str], label: str, weights: list[Column]) -> DataFrame:
    """One row: the summed logistic gradient, g0 for the constant."""
    xs = [F.lit(1.0), *(F.col(f) for f in features)]
    score = sum((w * x for w, x in zip(weights[1:], xs[1:], strict=True)), weights[0])
    error = 1 / (1 + F.exp(-score)) - F.col(label)
    return samples.agg(*(F.coalesce(F.sum(error * x), F.lit(0.0)).alias(f"g{i}") for i, x in enumerate(xs)))


def logistic_regression(samples: DataFrame, features: Iterable[str], label: str, rounds: int = 100, rate: float = 0.1) -> tuple[list[float], list[float]]:
    """Weights (of the constant first; all start at 1) and the last summed gradient.

    Each round is one pass with partial sums; only the gradient, one number a feature, comes to the driver.
    """
    features = list(features)
    own = samples.select(*features, label).persist()
    weights, last = [1.0] * (len(features) + 1), [0.0] * (len(features) + 1)
    for _ in range(rounds):
        weights = [w - rate * g for w, g in zip(weights, last, strict=True)]
        last = list(gradient(own, features, label, [F.lit(w) for w in weights]).first())
    own.unpersist()
    return weights, last


def bfs(edges: DataFrame, start: DataFrame, hops: int, expand: Column | str | None = None) -> DataFrame:
    """id, dist of the vertices within ``hops`` of the starts (id); a vertex is visited once, at its least distance.

    ``expand``: only vertices that meet it (over id) are gone on from.
    """
    step = edges.select(F.col("src").alias("id"), F.col("dst").alias("_to")).distinct()
    seen = checkpoint(start.select("id").distinct().withColumn("dist", F.lit(0)))
    frontier = seen
    for k in range(1, hops + 1):
        own = frontier if expand is None else frontier.where(expand)
        new = own.join(step, "id").select(F.col("_to").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("dist", F.lit(k))
        frontier = checkpoint(new)
        if frontier.isEmpty():
            break
        seen = seen.unionAll(frontier)
    return seen


def friends_by_name(edges: DataFrame, people: DataFrame, start: int, first_name: str, hops: int = 3, limit: int = 20) -> DataFrame:
    """People within ``hops`` of a person who have a first name: nearest first, then by last name and id."""
    found = bfs(edges, edges.sparkSession.createDataFrame([(start,)], "id long"), hops).where("dist > 0")
    return found.join(people.where(F.col("first_name") == first_name), "id").orderBy("dist", "last_name", "id").limit(limit)
