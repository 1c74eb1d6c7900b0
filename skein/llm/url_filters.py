"""URL filters: path rules, and trust and distrust propagated over links between hosts.

DataFrame functions only. Trust is a personalised PageRank from hosts with pages that a rule allows; distrust is one over
reversed links from hosts with pages that a rule blocks. A seed's mass is its number of such pages. A page that no rule
fits is blocked if its host's distrust exceeds ``threshold`` times its trust, else allowed; a host without either is allowed.

Each row is judged, also if rows repeat; a null url has an empty host and path, no rule, and is allowed; null html has no
links; an empty table gives none; other columns of ``pages`` aren't read, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.session import checkpoint

#: (verdict, rule): a host and a path, written host/path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Targets of links with a host, in quotes or bare.
LINK = r"""(?i)href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^\s"'<>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; without it (or null) empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null; between rules of one length the first listed."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda x: len(x[1])):  # the longest is tested first
        h, _, p = rule.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(f"/{p}"))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame, host: str = "host", html: str = "html") -> DataFrame:
    """src, dst, n: links between different hosts; repeated links of a host are summed before the shuffle."""
    target = F.explode(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(LINK), F.lit(1)))
    links = pages.select(F.col(host).alias("src"), target.alias("link")).select("src", host_of(F.when(F.startswith("link", F.lit("//")), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))).alias("dst"))
    return links.where((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = 200, damping: float = 0.85, tolerance: float = 1e-3, every: int = 5) -> DataFrame:
    """host, trust, distrust; ``seeds`` has host, trust, distrust (masses, each kind is scaled to one).

    Both ranks are rows of one table (node, way), so a round is one join and one sum. Every few rounds the table is written;
    it is done when no further node is reached and a round changes all ranks together by at most ``tolerance``, or after
    ``rounds``. What a node without links of a way would pass on goes back to nobody.
    """
    ways = edges.select(F.lit("trust").alias("way"), F.col("src").alias("a"), F.col("dst").alias("b"), "n").unionAll(edges.select(F.lit("distrust"), "dst", "src", "n"))
    out = ways.groupBy("way", "a").agg(F.sum("n").alias("all"))
    links = checkpoint(ways.join(out, ["way", "a"]).select("way", "a", "b", (F.col("n") / F.col("all")).alias("share")))
    total = seeds.agg(*(F.greatest(F.coalesce(F.sum(w), F.lit(0)), F.lit(1)).alias(w) for w in ("trust", "distrust"))).first()
    start = seeds.select(F.col("host").alias("a"), F.explode(F.map_from_arrays(F.array(F.lit("trust"), F.lit("distrust")), F.array(F.col("trust") / float(total["trust"]), F.col("distrust") / float(total["distrust"])))).alias("way", "seed")).where("seed > 0")
    start = checkpoint(start)
    rank = start.select("way", "a", F.col("seed").alias("rank"))
    if not links.isEmpty():  # without links every round gives the seeds again
        for k in range(1, rounds + 1):
            before = rank
            passed = rank.join(links, ["way", "a"]).select("way", F.col("b").alias("a"), (F.col("rank") * F.col("share") * damping).alias("rank"))
            rank = passed.unionAll(start.select("way", "a", F.col("seed") * (1 - damping))).groupBy("way", "a").agg(F.sum("rank").alias("rank"))
            if k % every == 0:
                moved = F.abs(F.col("rank") - F.coalesce("old", F.lit(0.0)))
                rank = checkpoint(rank.join(before.withColumnRenamed("rank", "old"), ["way", "a"], "left").select("way", "a", "rank", moved.alias("moved"), F.col("old").isNull().alias("new")))
                change = rank.agg(F.sum("moved").alias("moved"), F.max("new").alias("new")).first()
                rank = rank.select("way", "a", "rank")
                if not change["new"] and change["moved"] <= tolerance:
                    break
    each = reduce(lambda cols, w: [*cols, F.coalesce(F.sum(F.when(F.col("way") == w, F.col("rank"))), F.lit(0.0)).alias(w)], ("trust", "distrust"), [])
    return rank.groupBy(F.col("a").alias("host")).agg(*each)


#: A host with more than this share of the pages joins without a shuffle; there are at most as many as its inverse.
HOT_SHARE = 0.001


def judge(pages: DataFrame, rules=RULES, threshold: float = 1.0, **options) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's trust and distrust, for every row of ``pages`` (url, html)."""
    url = F.col("url")
    ruled = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), "html").withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    counts = ruled.groupBy("host").agg(F.sum((F.col("fit.verdict") == "allow").cast("long")).alias("trust"), F.sum((F.col("fit.verdict") == "block").cast("long")).alias("distrust"), F.count("*").alias("pages"))
    counts = checkpoint(counts)
    seeds = counts.select("host", *(F.coalesce(w, F.lit(0)).alias(w) for w in ("trust", "distrust"))).where("host != '' and trust + distrust > 0")
    scores = checkpoint(propagate(host_edges(ruled), seeds, **options))
    every = counts.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    hot = F.broadcast(counts.where(F.col("pages") > HOT_SHARE * every).select("host").join(scores, "host", "left"))
    rows = ruled.drop("html")
    scored = rows.join(hot, "host").unionByName(rows.join(hot, "host", "left_anti").join(scores, "host", "left"))
    verdict = F.when(F.coalesce("distrust", F.lit(0.0)) > threshold * F.coalesce("trust", F.lit(0.0)), "block").otherwise("allow")
    return scored.select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", verdict).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")
    )
