"""Mixing sources to target weights by iterative proportional fitting.

Token weights of cells (source, language, topic) are raked until the marginals meet their targets; a cell's raked tokens by
its own tokens is the probability with which its documents are kept. Where a probability would exceed one, the cell is held
at all its tokens and the rest is raked on. Raking ends when a round moves at most ``TOLERANCE`` of the tokens, or after
``ROUNDS`` rounds (targets that contradict each other have no limit). A topic is what the caller gives (a column or an
expression); by default it is the form of the text.

Without given targets, the target share of a value is its share of tokens to the power ``flatten`` of its dimension
(normalised): smaller values gain. A null value is a value of its own. Tokens are runs of characters other than white space.
Documents are kept by a hash of doc_id and text below the probability, so rows that repeat whole are kept or dropped
together; a text without tokens has no weight and is dropped. An empty table gives none. Other columns may have any names;
if ``docs`` has a ``probability``, ``sample`` adds ``mix_probability`` instead.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.session import checkpoint

DIMENSIONS = ("source", "lang", "topic")
#: Exponents of the default targets.
FLATTEN = {"source": 0.7, "lang": 0.5, "topic": 0.8}
#: Cells that the driver rakes itself (a few MB); more are raked in Spark, by the same steps.
DRIVER_CELLS = 200_000
ROUNDS, TOLERANCE = 200, 1e-7


def tokens_of(text: Column) -> Column:
    """Number of runs of characters other than white space."""
    spaced = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(spaced == "", 0).otherwise(F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit(""))) + 1).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic by form: table, markup, list, long prose, short prose; ``none`` for null and empty."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(F.length(t) == 0, "none").when(t.contains(" | "), "table").when(t.rlike(r"[%*#$&]{3}"), "markup").when(t.rlike(r"(?m)^\s*(?:[-*•]|\d+[.)])\s"), "list").when(F.length(t) >= 4000, "long").otherwise("short")
    )


def default_targets(cells: DataFrame, budget: float) -> DataFrame:
    """dim, value, target: tokens that the value should have when ``budget`` of all tokens are kept."""
    each = reduce(DataFrame.unionAll, (cells.groupBy(F.col(d).alias("value")).agg(F.sum("tokens").cast("double").alias("n")).where("n > 0").select(F.lit(d).alias("dim"), "value", F.pow("n", F.lit(FLATTEN[d])).alias("m")) for d in DIMENSIONS))
    whole = each.groupBy("dim").agg(F.sum("m").alias("all"))  # a row for each dimension
    total = float(cells.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0])
    return each.join(F.broadcast(whole), "dim").select("dim", "value", (F.col("m") / F.col("all") * total * budget).alias("target"))


def rake_local(cells, targets, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Raked tokens of each cell (pandas frames in, an array out)."""
    own = cells["tokens"].to_numpy(np.float64)
    w = own.copy()
    codes, wanted = [], []
    for d in DIMENSIONS:
        values = {v: i for i, v in enumerate(dict.fromkeys(cells[d]))}
        codes.append(np.array([values[v] for v in cells[d]], np.int64))
        goal = np.zeros(len(values))
        for v, t in targets.loc[targets["dim"] == d, ["value", "target"]].itertuples(index=False):
            if v in values:
                goal[values[v]] = t
        wanted.append(goal)
    for _ in range(rounds):
        before = w
        for c, goal in zip(codes, wanted, strict=True):
            full = w >= own
            held = np.bincount(c, np.where(full, 0, w), len(goal))
            fixed = np.bincount(c, np.where(full, w, 0), len(goal))
            have = held + fixed
            # cells that are held at all they have only give way where the target is below them
            down = goal < have
            f = np.where(down, goal / np.where(have > 0, have, 1), np.where(held > 0, (goal - fixed) / np.where(held > 0, held, 1), 1))
            w = np.minimum(np.where(full & ~down[c], w, w * f[c]), own)
        if np.abs(w - before).sum() <= tolerance * own.sum():
            break
    return w


def rake_spark(cells: DataFrame, targets: DataFrame, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` with ``raked``, by joins and sums."""
    w = cells.withColumns({"raked": F.col("tokens").cast("double"), "before": F.col("tokens").cast("double")})
    for k in range(rounds):
        w = w.withColumn("before", F.col("raked"))
        for d in DIMENSIONS:
            full = F.col("raked") >= F.col("tokens")
            sums = w.groupBy(d).agg(F.sum(F.when(full, 0.0).otherwise(F.col("raked"))).alias("held"), F.sum(F.when(full, F.col("raked")).otherwise(0.0)).alias("fixed"))
            goal = targets.where(F.col("dim") == d).select(F.col("value").alias("v"), "target")
            sums = sums.join(goal, F.col(d).eqNullSafe(F.col("v")), "left").select(F.col(d).alias("v"), F.coalesce("target", F.lit(0.0)).alias("goal"), "held", "fixed")
            have = F.col("held") + F.col("fixed")
            down = F.col("goal") < have
            f = F.when(down, F.col("goal") / have).when(F.col("held") > 0, (F.col("goal") - F.col("fixed")) / F.col("held")).otherwise(1.0)
            raked = F.when(full & ~down, F.col("raked")).otherwise(F.least(F.col("raked") * f, F.col("tokens").cast("double")))
            w = w.join(sums, F.col(d).eqNullSafe(F.col("v"))).select(*DIMENSIONS, "tokens", raked.alias("raked"), "before")
        if k % 3 == 2:
            w = checkpoint(w)
            moved = w.agg(F.sum(F.abs(F.col("raked") - F.col("before"))).alias("m"), F.sum("tokens").alias("n")).first()
            if (moved["m"] or 0) <= tolerance * (moved["n"] or 0):
                break
    return w.drop("before")


def probabilities(measured: DataFrame, targets: DataFrame | None = None, budget: float = 0.5, rounds: int = ROUNDS, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """source, lang, topic, probability of each cell of ``measured`` (with n_tokens)."""
    cells = checkpoint(measured.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0"))
    targets = default_targets(cells, budget) if targets is None else targets
    if cells.count() <= driver_cells:
        local = cells.toPandas().astype({d: object for d in DIMENSIONS})
        wanted = targets.where(F.col("target") > 0).toPandas().astype({"value": object})
        for frame, cols in ((local, DIMENSIONS), (wanted, ("value",))):
            for c in cols:
                frame[c] = [None if x is None or x != x else x for x in frame[c]]
        rows = [(*x, float(p)) for x, p in zip(local[list(DIMENSIONS)].itertuples(index=False), rake_local(local, wanted, rounds) / np.maximum(local["tokens"].to_numpy(np.float64), 1), strict=True)]
        # the number of rows has been looked at: safe to broadcast, so that documents needn't be shuffled
        return F.broadcast(measured.sparkSession.createDataFrame(rows, "source string, lang string, topic string, probability double"))
    return rake_spark(cells, checkpoint(targets), rounds).select(*DIMENSIONS, (F.col("raked") / F.col("tokens")).alias("probability"))


def _topic(topic: Column | str | None, text: Column) -> Column:
    return topic_of(text) if topic is None else (F.col(topic) if isinstance(topic, str) else topic).cast("string")


def measured(docs: DataFrame, text: str = "text", topic: Column | str | None = None) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens and a draw from 0 to 1 of each row."""
    t = F.col(text)
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(10), F.col("doc_id").cast("string"), t), 11) * 2.0**-53
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), _topic(topic, t).alias("topic"), tokens_of(t).alias("n_tokens"), draw.alias("draw"))


def _matched(rows: DataFrame, cells: DataFrame, names: dict[str, str]) -> DataFrame:
    """``rows`` with the probability of their cell; nulls match. The table of cells is small next to the rows."""
    same = reduce(lambda a, b: a & b, (F.col(f"r.{names[d]}").eqNullSafe(F.col(f"c.{d}")) for d in DIMENSIONS))
    return rows.alias("r").join(cells.alias("c"), same, "left").select("r.*", F.coalesce("c.probability", F.lit(0.0)).alias("__probability"))


def report(docs: DataFrame, topic: Column | str | None = None, **options) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability, kept of each row."""
    rows = measured(docs, topic=topic)
    cells = probabilities(rows, **options)
    out = _matched(rows, cells, {d: d for d in DIMENSIONS})
    return out.select("doc_id", *DIMENSIONS, "n_tokens", F.col("__probability").alias("probability"), ((F.col("draw") < F.col("__probability")) & (F.col("n_tokens") > 0)).alias("kept"))


def sample(docs: DataFrame, topic: Column | str | None = None, **options) -> DataFrame:
    """The kept rows of ``docs`` with all their columns, and ``probability`` (``mix_probability`` if there is one)."""
    cells = probabilities(measured(docs, topic=topic), **options)
    t = F.col("text")
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(10), F.col("doc_id").cast("string"), t), 11) * 2.0**-53
    rows = docs.withColumns({"__source": F.col("source").cast("string"), "__lang": F.col("lang").cast("string"), "__topic": _topic(topic, t), "__draw": F.when(t.rlike(r"\S"), draw)})
    name = "probability" if "probability" not in docs.columns else "mix_probability"
    out = _matched(rows, cells, {d: f"__{d}" for d in DIMENSIONS})
    return out.where(F.col("__draw") < F.col("__probability")).select(*docs.columns, F.col("__probability").alias(name))
