"""Secret scans: fixed rules, and character Markov models of random strings against ordinary identifiers.

DataFrame functions only. Spans count code points, the end is exclusive. Null text is empty; each row is judged by itself, so
rows that repeat give equal results, and an empty table gives none. The work follows the length of a text and its matches
(blocks of matches are summed first). A text is one value: Spark holds it and its pieces in memory.
"""

from __future__ import annotations

from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._matches import blanked, places

# Fixed rules: (kind, pattern, group that is measured, least length of it). The lower bounds of the last two are in the
# pattern, which there finds the same maximal runs as the open pattern followed by a test of their length.
RULES = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: What the models judge: maximal runs of 16 characters or more, in the text without what the fixed rules found.
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
#: What counts as an ordinary identifier in training: a run of letters, digits and joints with a vowel and at most two digits.
IDENTIFIER = r"[A-Za-z0-9_-]{4,}"
#: Distinct characters of a random string, at least (a ruler of one sign is none).
DISTINCT = 6
SYMBOLS = 128
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: The share of all characters alike in a second character's probability, and the pseudo-count of a first character's pairs.
ALIKE, LEAN = 0.001, 20.0


def _spans(text: Column, kind: str, rank: int, pattern: str, group: int, least: int) -> Column:
    """array<struct<start, rank, kind, end, value>> of the leftmost non-overlapping matches."""
    long = F.filter(places(text, pattern, group), lambda x: F.length(x["v"]) >= least)
    return F.transform(long, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end"), x["v"].alias("value")))


def _pairs(df: DataFrame, token: str, label: str) -> DataFrame:
    """Counts of adjacent characters in the tokens of ``df``."""
    codes = F.transform(F.split(F.col(token), ""), lambda c: F.ascii(c))
    both = F.zip_with(F.slice(codes, 1, F.length(token) - 1), F.slice(codes, 2, F.length(token) - 1), lambda a, b: a * SYMBOLS + b)
    return df.where(F.length(token) >= 2).select(F.explode(both).alias("pair")).groupBy("pair").agg(F.count("*").alias("n")).select(F.lit(label).alias("label"), "pair", "n")


def labelled(docs: DataFrame, text: str = "text", sample_docs: int = 2000, generated: int = 4000) -> DataFrame:
    """Labelled training strings: (token, random).

    Random: digests of a counter in hexadecimal, base64 and upper-case letters, and the values that the fixed rules find.
    Ordinary: identifiers of the text outside them. Text comes from at most about ``sample_docs`` rows, chosen by hash.
    """
    spark = docs.sparkSession
    rows = max(1, docs.count())
    some = docs.select(F.col(text).alias("t")).where(F.pmod(F.xxhash64("t"), F.lit(max(1, rows // sample_docs))) == 0)
    seed = F.sha2(F.col("id").cast("string"), 256)
    made = spark.range(generated).select(
        F.explode(F.array(F.substring(seed, 1, 40), F.rtrim(F.translate(F.base64(F.unhex(seed)), "=", "")), F.upper(F.translate(F.substring(F.base64(F.unhex(seed)), 1, 24), "+/=", "XYZ")))).alias("token"), F.lit(True).alias("random")
    )
    values = reduce(lambda a, b: F.concat(a, b), (_spans(F.col("t"), k, i, p, g, n) for i, (k, p, g, n) in enumerate(RULES)))
    found = some.select(F.explode(F.transform(values, lambda s: s["value"])).alias("token")).where(F.col("token").rlike("^[ -~]+$")).select("token", F.lit(True).alias("random"))
    plain = reduce(lambda t, r: F.regexp_replace(t, r[1], " "), RULES, F.col("t"))
    ordinary = some.select(F.explode(F.regexp_extract_all(plain, F.lit(IDENTIFIER), F.lit(0))).alias("token")).where(F.col("token").rlike("(?i)[aeiouy]") & (F.length(F.regexp_replace("token", "[^0-9]", "")) <= 2))
    return made.unionByName(found).unionByName(ordinary.select("token", F.lit(False).alias("random")))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of random against ordinary for each pair of characters, smoothed.

    The table has SYMBOLS**2 entries whatever the size of the input; only it comes to the driver.
    """
    counts = _pairs(samples.where("random"), "token", "random").unionByName(_pairs(samples.where("not random"), "token", "plain"))
    table = {"random": {}, "plain": {}}
    for r in counts.collect():
        table[r["label"]][r["pair"]] = r["n"]
    used = sorted({c for t in table.values() for p in t for c in divmod(p, SYMBOLS)} | set(map(ord, ALPHABET)))
    # a pair's probability leans on that of its second character alone, and so much the more the rarer the first one is
    logs = {}
    for kind, t in table.items():
        first = {a: sum(t.get(a * SYMBOLS + b, 0) for b in used) for a in used}
        every = max(1, sum(first.values()))
        second = {b: (1 - ALIKE) * sum(t.get(a * SYMBOLS + b, 0) for a in used) / every + ALIKE / len(used) for b in used}
        logs[kind] = {a * SYMBOLS + b: log((t.get(a * SYMBOLS + b, 0) + LEAN * second[b]) / (first[a] + LEAN)) for a in used for b in used}
    out = [0.0] * (SYMBOLS * SYMBOLS)
    for p, x in logs["random"].items():
        out[p] = x - logs["plain"][p]
    return out


def score(token: Column, model: list[float]) -> Column:
    """The sum over the token's adjacent characters."""
    codes = F.transform(F.split(token, ""), lambda c: F.ascii(c))
    table = F.array(*map(F.lit, model)) if len(model) < 64 else F.lit(model)
    both = F.zip_with(F.slice(codes, 1, F.length(token) - 1), F.slice(codes, 2, F.length(token) - 1), lambda a, b: F.element_at(table, a * SYMBOLS + b + 1))
    return F.aggregate(both, F.lit(0.0), lambda x, y: x + y)


def scan(docs: DataFrame, model: list[float], text: str = "text", out: str = "found", least_score: float = 13.8) -> DataFrame:
    """Adds ``out``: array of (start, rank, kind, end, value) by start, then kind as listed; null text has no spans.

    A run that is left when the spans of the fixed rules are blanked out is added as kind ``markov`` where the models'
    log-likelihood ratio is at least ``least_score`` (odds of a million to one) and it has ``DISTINCT`` different characters. Rows and columns stay as they are.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    base = reduce(lambda a, b: F.concat(a, b), (_spans(t, k, i, p, g, n) for i, (k, p, g, n) in enumerate(RULES)))
    base_name, rest_name = f"__{out}_base", f"__{out}_rest"
    # few texts have a run that is long enough; only those are rewritten
    df = docs.withColumns({base_name: base, rest_name: F.when(t.rlike(CANDIDATE), t).otherwise("")})
    for _, pattern, group, least in RULES:
        df = df.withColumn(rest_name, blanked(F.col(rest_name), pattern, group, least))
    judged = F.filter(_spans(F.col(rest_name), "markov", len(RULES), CANDIDATE, 0, 16), lambda s: (F.size(F.array_distinct(F.split(s["value"], ""))) >= DISTINCT) & (score(s["value"], model) >= least_score))
    return df.withColumn(out, F.array_sort(F.concat(F.col(base_name), judged))).drop(base_name, rest_name)


def digest(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_report(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: doc_id, counts by kind, base_sha256, spans; models trained on ``docs``."""
    df = scan(docs.select("doc_id", F.col(text).alias("text")), train(labelled(docs, text)))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return df.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k, *_ in RULES),
        count("markov").alias("n_markov"),
        F.sha2(digest(F.filter("found", lambda s: s["kind"] != "markov")), 256).alias("base_sha256"),
        digest(F.col("found")).alias("spans"),
    )
