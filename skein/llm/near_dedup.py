"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles, banded, verified.

A shingle is five consecutive words (runs of ``[0-9a-z]`` and characters beyond ASCII, A-Z lower-cased; a text of fewer
words, but not none, is one shingle). Its weight is its number in the text times (1 + the mean of its words' scaled IDF) / 2.
The IDF of a word is ln(N / df) over all documents, at most -ln(``DF_FLOOR``) and scaled to 0..1 by that. Only words with
df of at least ``DF_FLOOR`` * N need to be known, so the table has at most (distinct words of a document) / ``DF_FLOOR``
entries whatever the number of documents. (The IDF of the shingle itself would set shared shingles of a large group of
copies back against those that differ, and need a count of all shingles.)

Identical texts are one node, with a number. Nodes that share a band of ``ROWS`` of the samples are candidates: all pairs of a
bucket of up to ``SMALL`` nodes; in a larger one each node with a leader, another one for each band. Larger buckets that are
still in several parts are dealt into blocks of about ``SMALL`` nodes, within which all are compared, ``DEALS`` times. Of
buckets that are in several parts even then, every pair of nodes from two parts that can be a link is compared: two texts with a similarity of
``LEAST`` have so much weight in common that, with the shingles of each in one order (rare ones first), they meet in a
shingle near the start of both. So ``SMALL`` says where a pair is found, never whether. A pair is a link if the weighted
Jaccard similarity of the whole texts is at least ``LEAST``; classes are the connected components of the links.

Texts without words (null, empty, signs only) are each alone. Rows that repeat whole (doc_id and text) are one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import checkpoint

from . import _bytes as B
from . import _records as R
from .components import connected_components

WORDS, LEAST = 5, 0.8
BANDS, ROWS, SMALL, DEALS = 8, 3, 8, 2
DF_FLOOR = 0.002
#: Columns of the bands' keys.
KEYS = tuple(f"k{i}" for i in range(BANDS))
#: For sums of rounded weights.
SLACK = 1 - 1e-6
#: Bytes of a shingle in a packed vector, and the type of its weight.
WIDTH, WEIGHT = 8, np.float32
BLOCK = 1 << 20


def _tokens(buf: np.ndarray, at: np.ndarray, powers: B.Powers) -> tuple[np.ndarray, np.ndarray]:
    low = B.LOWER[buf]
    s, e, row = B.words(low, at, B.WORD_BYTE)
    return B.Spans(low, powers).hash(s, e), row


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and the number of this task's documents that have them."""
    powers = B.Powers()
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        w, n = (np.concatenate(x) for x in zip(*held, strict=True))
        words, back = np.unique(w, return_inverse=True)
        return words, np.bincount(back, n).astype(np.int64)

    for batch in batches:
        buf, at = B.column_bytes(batch.column("text"))
        for i, j in B.blocks(at, BLOCK):
            w, row = _tokens(buf[at[i] : at[j]], at[i : j + 1] - at[i], powers)
            # one of each word and row: rows in the high bits that the hash gives up
            bits = np.uint64(max(1, int(j - i).bit_length()))
            own = np.unique(row.astype(np.uint64) << (np.uint64(64) - bits) | w >> bits)
            held.append(np.unique(own << bits, return_counts=True))
            if sum(len(x) for x, _ in held) > 2_000_000:
                held = [merged()]
                if len(held[0][0]) > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1])], names=["word", "n"])
                    held = []
    if held:
        w, n = merged()
        yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n)], names=["word", "n"])


class Idf:
    """Scaled IDF by word hash; 44 bits of the hash tell words apart."""

    BITS = np.uint64(20)

    def __init__(self, words: np.ndarray, df: np.ndarray, docs: int) -> None:
        order = np.argsort(words)
        self.words = words[order]
        self.value = np.clip(np.log(max(docs, 1) / np.maximum(df[order], 1)) / -np.log(DF_FLOOR), 0, 1).astype(np.float32)

    def __call__(self, words: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.ones(len(words), np.float32)
        key = words >> self.BITS
        at = np.minimum(np.searchsorted(self.words, key), len(self.words) - 1)
        return np.where(self.words[at] == key, self.value[at], np.float32(1))


def word_idf(texts: DataFrame) -> Idf:
    """From all of ``texts`` (text); only the words beyond the floor come to the driver."""
    docs = texts.count()
    least = max(2, int(np.ceil(DF_FLOOR * docs)))
    counts = texts.select("text").mapInArrow(B.tidy(_word_counts), "word long, n long").groupBy(F.shiftrightunsigned("word", int(Idf.BITS)).alias("word")).agg(F.sum("n").alias("n")).where(F.col("n") >= least).toArrow()
    return Idf(counts.column("word").to_numpy().astype(np.uint64), counts.column("n").to_numpy(), docs)


def shingles(buf: np.ndarray, at: np.ndarray, idf: Idf, powers: B.Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, id (44 bits) and weight of each distinct shingle of each row, by row and id. At most 2**19 rows."""
    w, row = _tokens(buf, at, powers)
    n = np.bincount(row, minlength=len(at) - 1)
    first = np.concatenate([[0], np.cumsum(n)])
    up, down = powers.upto(len(w) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * up[: len(w)])])
    value = np.concatenate([[0.0], np.cumsum(idf(w), dtype=np.float64)])
    size = np.minimum(n, WORDS)
    start = np.flatnonzero(np.arange(len(w)) - first[row] <= (n - size)[row]) if len(w) else np.zeros(0, np.int64)
    own, k = row[start], size[row[start]]
    h = B.mix((sums[start + k] - sums[start]) * down[start] + k.astype(np.uint64))
    weight = (1 + (value[start + k] - value[start]) / np.maximum(k, 1)) / 2
    key = own.astype(np.uint64) << np.uint64(44) | h >> np.uint64(20)
    order = np.argsort(key)
    key, weight = key[order], weight[order]
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    cuts = np.flatnonzero(new)
    total = np.add.reduceat(weight, cuts) if len(cuts) else weight
    key = key[cuts]
    return (key >> np.uint64(44)).astype(np.int64), key & np.uint64((1 << 44) - 1), total.astype(np.float32)


def _gamma_table() -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of 2**16 equal steps, by bisection of 1 - (1 + x) exp(-x)."""
    p = (np.arange(1 << 16) + 0.5) / (1 << 16)
    lo, hi = np.zeros_like(p), np.full_like(p, 40.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        less = 1 - (1 + mid) * np.exp(-mid) < p
        lo, hi = np.where(less, mid, lo), np.where(less, hi, mid)
    return ((lo + hi) / 2).astype(np.float32)


def samples(row: np.ndarray, ids: np.ndarray, weight: np.ndarray, n: int, gamma: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with shingles, and ``n`` consistent weighted samples of each (hashes of shingle and level)."""
    log_gamma = np.log(gamma)
    cuts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    out = np.zeros((len(cuts), n), np.uint64)
    if not len(cuts):
        return cuts, out
    segment = np.repeat(np.arange(len(cuts)), np.diff(np.concatenate([cuts, [len(row)]])))
    log_w = np.log(weight)
    low = np.uint64(0xFFFF)
    for k in range(n):
        x = B.mix(ids + np.uint64((k + 1) * 0x632BE59BD9B4E019 % (1 << 64)))
        r, log_c = gamma[(x & low).astype(np.int64)], log_gamma[(x >> np.uint64(16) & low).astype(np.int64)]
        beta = (x >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
        t = np.floor(log_w / r + beta)
        a = log_c - r * (t - beta + 1)
        least = np.flatnonzero(a == np.minimum.reduceat(a, cuts)[segment])
        least = least[np.concatenate([[True], segment[least][1:] != segment[least][:-1]])]
        out[:, k] = B.mix(ids[least] ^ (t[least].astype(np.int64).view(np.uint64) << np.uint64(48)))
    return row[cuts], out


def _sign(idf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, gamma = B.Powers(), _gamma_table()
        for batch in batches:
            buf, at = B.column_bytes(batch.column("text"))
            bands = np.zeros((len(batch), BANDS), np.uint64)
            some = np.zeros(len(batch), bool)
            for i, j in B.blocks(at, BLOCK):
                rows, s = samples(*shingles(buf[at[i] : at[j]], at[i : j + 1] - at[i], idf.value, powers), BANDS * ROWS, gamma)
                some[i + rows] = True
                key = s.reshape(-1, BANDS, ROWS)
                x = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None, :], len(rows), 0)
                for c in range(ROWS):
                    x = B.mix(x ^ key[:, :, c])
                bands[i + rows] = x
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "did", "th", "a", "b")), pa.array(some), *(pa.array(bands[:, k].view(np.int64)) for k in range(BANDS))], names=["doc_id", "did", "th", "a", "b", "some", *KEYS])

    return run


def _vectors(idf, bits):
    """Packed shingles of the documents whose slot is set: sorted 32-bit ids, then 32-bit weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = B.Powers()
        for batch in batches:
            batch = batch.filter(pa.array(R.has(bits.value, batch.column("slot").to_numpy())))
            buf, at = B.column_bytes(batch.column("text"))
            out: list[bytes] = []
            for i, j in B.blocks(at, BLOCK):
                row, ids, weight = shingles(buf[at[i] : at[j]], at[i : j + 1] - at[i], idf.value, powers)
                edge = np.searchsorted(row, np.arange(j - i + 1))
                short = (ids >> np.uint64(12)).astype(np.uint32)  # the high bits, so that the order stays
                out += [short[p:q].tobytes() + weight[p:q].tobytes() for p, q in zip(edge[:-1], edge[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("did"), batch.column("th"), pa.array(out, pa.binary())], names=["did", "th", "vector"])

    return run


def weighted_jaccard(x: bytes, y: bytes) -> float:
    """Sum of lesser weights by sum of greater weights."""
    n, m = len(x) // 8, len(y) // 8
    a, b = np.frombuffer(x, np.uint32, n), np.frombuffer(y, np.uint32, m)
    u, v = np.frombuffer(x, np.float32, n, 4 * n).astype(np.float64), np.frombuffer(y, np.float32, m, 4 * m).astype(np.float64)
    at = np.minimum(np.searchsorted(b, a), max(m - 1, 0))
    same = b[at] == a if m else np.zeros(n, bool)
    both = np.minimum(u[same], v[at[same]]).sum()
    total = u.sum() + v.sum() - both
    return float(both / total) if total > 0 else 0.0


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        s = [weighted_jaccard(x.as_py(), y.as_py()) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(s, pa.float64())], names=["u", "v", "similarity"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """u, v: links between different roots within short lists of (node, root, vector); what a link has joined isn't compared again."""
    for batch in batches:
        out = []
        for own in batch.column("all"):
            own = own.as_py()
            part = {x["root"]: x["root"] for x in own}
            for i, x in enumerate(own):
                for y in own[:i]:
                    p, q = part[x["root"]], part[y["root"]]
                    if p != q and weighted_jaccard(x["vector"], y["vector"]) >= LEAST:
                        out.append((min(x["node"], y["node"]), max(x["node"], y["node"])))
                        part = {r: p if t == q else t for r, t in part.items()}
        u, v = zip(*out, strict=True) if out else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _shingle(ids: np.ndarray) -> np.ndarray:
    """Slot of a shingle in the table of counts, whose size is fixed."""
    return (ids >> np.uint32(12)).astype(np.int64)


def _shingle_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros(1 << 20, np.int64)
    for batch in batches:
        for x in batch.column("vector"):
            raw = x.as_py()
            np.add.at(n, _shingle(np.frombuffer(raw, np.uint32, len(raw) // WIDTH)), 1)
    some = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["slot", "n"])


def _prefixes(counts):
    """The shingles by which a text meets each other one it may be linked with: key, short, rest, weight, node, root.

    Texts x and y of a link have at least LEAST / (1 + LEAST) of their summed weights in common. From the first common shingle
    on, in any one order, both have at least that weight (``rest``). A partner weighs at least LEAST as much, which bounds
    the shingles that count; those that also do for a partner of at least this text's weight are marked ``short``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rests, weights, size = [], [], np.zeros(len(batch)), np.zeros(len(batch), np.int64)
            for i, x in enumerate(batch.column("vector")):
                raw = x.as_py()
                n = len(raw) // WIDTH
                ids, w = np.frombuffer(raw, np.uint32, n), np.frombuffer(raw, WEIGHT, n, 4 * n).astype(np.float64)
                order = np.lexsort((ids, counts.value[_shingle(ids)]))
                rest = np.cumsum(w[order][::-1])[::-1]
                weights[i], size[i] = w.sum(), np.searchsorted(-rest, -LEAST * w.sum() * SLACK, "right")
                keys.append(ids[order[: size[i]]].astype(np.int64))
                rests.append(rest[: size[i]])
            at = np.repeat(np.arange(len(batch)), size)
            rest, weight = np.concatenate(rests) if rests else np.zeros(0), weights[at]
            short = rest >= 2 * LEAST / (1 + LEAST) * weight * SLACK
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)), pa.array(short), pa.array(rest), pa.array(weight), *(batch.column(c).take(pa.array(at)) for c in ("node", "root"))], names=["key", "short", "rest", "weight", "node", "root"])

    return run


def _pairs_apart(split: DataFrame) -> DataFrame:
    """u, v: of nodes (node, root, vector), every pair of different roots that can be a link."""
    table = split.select("vector").mapInArrow(B.tidy(_shingle_counts), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << 20, np.int64)
    counts[table.column("slot").to_numpy()] = table.column("n").to_numpy()
    keyed = checkpoint(split.mapInArrow(B.tidy(_prefixes(split.sparkSession.sparkContext.broadcast(counts))), "key long, short boolean, rest double, weight double, node long, root long"))
    several = keyed.groupBy("key").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.max("short").alias("s")).where("s and r1 != r2").select("key")
    keyed = keyed.join(several.hint("merge"), "key")
    meet = "x.key = y.key and x.root != y.root and (x.weight < y.weight or (x.weight = y.weight and x.node < y.node))"
    enough = f"x.weight >= {LEAST * SLACK!r}D * y.weight and least(x.rest, y.rest) >= {LEAST / (1 + LEAST) * SLACK!r}D * (x.weight + y.weight)"
    pairs = keyed.where("short").alias("x").join(keyed.alias("y").hint("merge"), F.expr(f"{meet} and {enough}"))
    return pairs.select(F.least("x.node", "y.node").alias("u"), F.greatest("x.node", "y.node").alias("v"))


def classes(docs: DataFrame, text: str = "text") -> DataFrame:
    """did, th, doc_id, class_id, class_size, kept and copies of each document (rows that repeat whole are one).

    ``class_id`` is the least doc_id of the class (null first); ``kept`` marks its first document by (doc_id, text hash);
    ``copies`` is how many rows repeat this one whole, itself included; ``class_size`` counts rows.
    """
    # joins of tables that grow with the input are merges throughout: nothing of them passes through the driver
    spark = docs.sparkSession
    own = R.documents(docs, text).withColumns({"a": F.xxhash64("text"), "b": F.xxhash64(F.lit(1), "text")})
    idf = B.Shared(docs, word_idf(own))
    signed = checkpoint(own.select("doc_id", "did", "th", "a", "b", "text").mapInArrow(B.tidy(_sign(idf)), "doc_id long, did long, th long, a long, b long, some boolean, " + ", ".join(f"{k} long" for k in KEYS)))
    # a number for each text, fixed by the checkpoint
    nodes = signed.where("some").groupBy("a", "b").agg(F.min("did").alias("did"), F.min_by("th", "did").alias("th"), F.count("*").alias("rows"), *(F.any_value(k).alias(k) for k in KEYS))
    nodes = checkpoint(nodes.withColumn("node", F.monotonically_increasing_id()))
    # a bucket or class may have a third of all nodes: sums go by salts first, and come back to the salts
    members = R.salted(nodes.select("node", F.explode(F.array(*KEYS)).alias("key")), "node")
    # a leader for each bucket, chosen by a hash that differs between bands
    h = F.xxhash64("node", "key")
    some = members.groupBy("key", "salt").agg(F.count("*").alias("n"), F.min_by("node", h).alias("lead"), F.min(h).alias("h"))
    buckets = some.groupBy("key").agg(F.sum("n").alias("n"), F.min_by("lead", "h").alias("lead")).where("n > 1")
    buckets = some.select("key", "salt").join(buckets.hint("merge"), "key")
    shared = checkpoint(members.join(buckets.hint("merge"), ["key", "salt"]))
    few = shared.where(F.col("n") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("all"))
    few = few.select(F.explode(F.flatten(F.transform("all", lambda x, i: F.transform(F.slice("all", i + 2, SMALL), lambda y: F.struct(x.alias("u"), y.alias("v")))))).alias("p")).select("p.u", "p.v")
    star = shared.where((F.col("n") > SMALL) & (F.col("node") != F.col("lead"))).select(F.least("node", "lead").alias("u"), F.greatest("node", "lead").alias("v"))

    wanted = shared.select("node").distinct().join(nodes.select("node", "did", "th").hint("merge"), "node")
    bits = spark.sparkContext.broadcast(R.bitmap(wanted))
    vectors = own.select("did", "th", "slot", "text").mapInArrow(B.tidy(_vectors(idf, bits)), "did long, th long, vector binary")
    vectors = checkpoint(wanted.join(vectors.hint("merge"), ["did", "th"]).groupBy("node").agg(F.first("vector").alias("vector")))

    def links(pairs: DataFrame) -> DataFrame:
        both = pairs.distinct().join(vectors.toDF("u", "x").hint("merge"), "u").join(vectors.toDF("v", "y").hint("merge"), "v").select("u", "v", "x", "y")
        return checkpoint(both.mapInArrow(B.tidy(_verify), "u long, v long, similarity double").where(F.col("similarity") >= LEAST).select("u", "v"))

    found = links(few.unionAll(star))
    roots = connected_components(found, "u", "v")

    def apart() -> DataFrame:
        """key, n, node, root of large buckets that are in several parts."""
        rest = shared.where(F.col("n") > SMALL).select("key", "salt", "n", "node").join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
        some = rest.groupBy("key", "salt").agg(F.min("root").alias("r1"), F.max("root").alias("r2"))
        parts = some.groupBy("key").agg(F.min("r1").alias("r1"), F.max("r2").alias("r2")).where("r1 != r2").select("key")
        return rest.join(some.select("key", "salt").join(parts.hint("merge"), "key").hint("merge"), ["key", "salt"])

    for turn in range(DEALS):
        block = F.pmod(F.xxhash64("node", "key", F.lit(turn)), F.ceil(F.col("n") / SMALL))
        dealt = apart().withColumn("block", block).select("key", "block", "node", "root").join(vectors.hint("merge"), "node")
        dealt = dealt.groupBy("key", "block").agg(F.collect_list(F.struct("node", "root", "vector")).alias("all")).where(F.size("all") > 1)
        more = checkpoint(dealt.select("all").mapInArrow(B.tidy(_compare), "u long, v long").distinct())
        if more.isEmpty():
            break
        found = found.unionAll(more)
        roots = connected_components(found, "u", "v")
    # what is in several parts even now: all pairs that can be links
    split = checkpoint(apart().select("node", "root").distinct().join(vectors.hint("merge"), "node"))
    if not split.isEmpty():
        more = links(_pairs_apart(split))
        if not more.isEmpty():
            roots = connected_components(found.unionAll(more), "u", "v")

    placed = nodes.select("a", "b", "node", "did", "th", "rows").join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = R.salted(placed, "node")
    some = placed.groupBy("root", "salt").agg(F.min(F.struct("did", "th")).alias("head"), F.sum("rows").alias("class_size"))
    heads = some.groupBy("root").agg(F.min("head").alias("head"), F.sum("class_size").alias("class_size"))
    heads = some.select("root", "salt").join(heads.hint("merge"), "root")
    placed = placed.join(heads.hint("merge"), ["root", "salt"]).select("a", "b", "head", "class_size")
    each = signed.groupBy("did", "th").agg(*(F.any_value(c).alias(c) for c in ("doc_id", "some", "a", "b")), F.count("*").alias("copies"))
    first = (F.col("head.did") == F.col("did")) & (F.col("head.th") == F.col("th"))
    classed = R.join_spread(each.where("some"), placed, ["a", "b"], ["did", "th"]).select("did", "th", "doc_id", F.when(F.col("head.did") != R.LEAST, F.col("head.did")).alias("class_id"), "class_size", first.alias("kept"), "copies")
    alone = each.where("not some").select("did", "th", "doc_id", F.col("doc_id").alias("class_id"), F.col("copies").alias("class_size"), F.lit(True).alias("kept"), "copies")
    return classed.unionAll(alone)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, class_size, kept for each row; of rows that repeat whole, one can be kept."""
    found = classes(docs).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return found.select("doc_id", "class_id", "class_size", (F.col("kept") & (F.col("k") == 1)).alias("kept"))


def keep_first(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row of each class, with the columns of ``docs``; rows of other classes aren't shuffled."""
    spark = docs.sparkSession
    verdict = classes(docs, text)
    touched = checkpoint(verdict.where(~F.col("kept") | (F.col("copies") > 1)).select("did", "th", "kept"))
    bits = spark.sparkContext.broadcast(R.bitmap(touched).tobytes())
    t = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.withColumns({"__did": F.coalesce(F.col("doc_id").cast("long"), F.lit(R.LEAST)), "__th": F.xxhash64(t, F.col("doc_id").isNull())}).withColumn("__slot", R.slot(F.col("__did"), F.col("__th")))

    @F.pandas_udf("boolean")
    def marked(slots):
        import pandas as pd

        return pd.Series(R.has(np.frombuffer(bits.value, np.uint8), slots.to_numpy()))

    keyed = keyed.withColumn("__marked", marked("__slot"))
    some = keyed.where("__marked").join(touched.toDF("__did", "__th", "__kept"), ["__did", "__th"], "left").where(F.coalesce("__kept", F.lit(True)))
    plain = some.where(F.col("__kept").isNull()).select(*docs.columns)
    single = some.where(F.col("__kept").isNotNull()).dropDuplicates(["__did", "__th"]).select(*docs.columns)
    return keyed.where(~F.col("__marked")).select(*docs.columns).unionAll(plain).unionAll(single)
