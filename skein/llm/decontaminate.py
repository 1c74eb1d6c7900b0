"""Benchmark decontamination: suffix arrays of the documents, searched for every suffix of the benchmark items.

Words are runs of ``[0-9a-z]`` and characters beyond ASCII, after A-Z are lower-cased. A window is ``window`` consecutive
words of an item, or the whole item if it is shorter; a document word inside any occurrence of a window is hit.

Each block of documents (a shard) is encoded by the words of the items, every other word being a separator that nothing
matches. Suffixes too short for any window are left out, the rest are sorted by prefix doubling, and each suffix of each
item is looked up by binary search: the range that starts with its window gives all occurrences, its neighbours in the
order give the longest verbatim match. Occurrences are handled as ranges of the order, never one by one for each item
suffix, so the work follows the words of a shard and of the items, not the product of a very repetitive pair.

The items are read in blocks of bounded size (``item_bytes``); each is broadcast and the documents are searched once for
each. Null and empty texts have no words; rows that repeat each get their own result; a null item_id counts as ``""``.
A shard is a block of rows or one very long row, which is held whole (some 100 bytes of memory a word).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.session import checkpoint

from . import _bytes as B

MATCH = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("item_word", T.IntegerType()), T.StructField("doc_word", T.LongType()), T.StructField("n_words", T.IntegerType())])
FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hits", T.BinaryType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("longest", T.ArrayType(MATCH))])


class Items:
    """The suffixes of some items, ready to be looked up."""

    def __init__(self, ids: list[str], texts: list[str], window: int) -> None:
        buf, at = B.column_bytes(pa.array(texts, pa.large_string()))
        buf = B.LOWER[buf] if len(buf) else buf
        s, e, row = B.words(buf, at, B.WORD_BYTE)
        h = B.Spans(buf, B.Powers()).hash(s, e)
        self.ids, self.window = ids, window
        self.vocabulary = np.unique(h)
        words = np.searchsorted(self.vocabulary, h).astype(np.int32) + 1
        n = np.bincount(row, minlength=len(ids))
        self.longest = int(n.max(initial=0))
        first = np.concatenate([[0], np.cumsum(n)])
        place = np.arange(len(words)) - first[row]
        left = n[row] - place
        size = np.minimum(window, n[row])
        self.least = int(size.min(initial=window))
        # suffixes that start a window; shorter tails of an item can't hold one
        own = np.flatnonzero(left >= size)
        self.row, self.place, self.size, self.left = row[own], place[own], size[own].astype(np.int64), left[own].astype(np.int64)
        self.start, self.words = own, np.concatenate([words, np.zeros(self.longest + 1, np.int32)])


def suffix_array(text: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """``starts`` in the order of the first ``depth`` words of their suffixes (prefix doubling; ties by place)."""
    n = len(text)
    rank, k = text.astype(np.int64), 1
    while k < min(depth, n):
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:] + 1
        key = rank * (int(after.max(initial=0)) + 1) + after
        _, rank = np.unique(key, return_inverse=True)
        k *= 2
    return starts[np.argsort(rank[starts], kind="stable")]


def search(text: np.ndarray, order: np.ndarray, items: Items, size: np.ndarray, right: bool, chunk: int = 4096) -> np.ndarray:
    """For each item suffix, where its first ``size`` words would stand in ``order``: before equals, or after them."""
    out = np.empty(len(items.start), np.int64)
    for a in range(0, len(out), chunk):
        q, width = items.start[a : a + chunk], size[a : a + chunk]
        steps = np.arange(int(width.max(initial=1)))
        want = items.words[np.minimum(q[:, None] + steps, len(items.words) - 1)]
        inside = steps < width[:, None]
        lo, hi = np.zeros(len(q), np.int64), np.full(len(q), len(order), np.int64)
        while (live := np.flatnonzero(lo < hi)).size:
            mid = (lo[live] + hi[live]) // 2
            have = text[np.minimum(order[mid][:, None] + steps, len(text) - 1)]
            differs = (have != want[live]) & inside[live]
            at = differs.argmax(1)
            some = differs[np.arange(len(live)), at]
            less = have[np.arange(len(live)), at] < want[live, at]
            go = np.where(some, less, right)
            lo[live] = np.where(go, mid + 1, lo[live])
            hi[live] = np.where(go, hi[live], mid)
        out[a : a + chunk] = lo
    return out


class Longest:
    """Longest common prefixes of item suffixes and document suffixes, by hashes of any number of words."""

    def __init__(self, text: np.ndarray, items: Items, powers: B.Powers) -> None:
        self.text, self.items = text, items
        up, self.down = powers.upto(max(len(text), len(items.words)) + 1)
        self.sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(B.mix(x.astype(np.uint64) + np.uint64(1)) * up[: len(x)])]) for x in (items.words, text)]

    def common(self, which: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Words that item suffixes have in common with the text from ``place`` on, by bisection."""
        q, (a, b) = self.items.start[which], self.sums
        lo, hi = np.zeros(len(q), np.int64), np.minimum(self.items.left[which], len(self.text) - place)
        while (live := np.flatnonzero(lo < hi)).size:
            mid, x, y = (lo[live] + hi[live] + 1) // 2, q[live], place[live]
            same = (a[x + mid] - a[x]) * self.down[x] == (b[y + mid] - b[y]) * self.down[y]
            lo[live], hi[live] = np.where(same, mid, lo[live]), np.where(same, hi[live], mid - 1)
        return lo

    def find(self, which: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and length of a longest match of each item suffix: beside where it would stand in the order."""
        lo, hi = np.zeros(len(which), np.int64), np.full(len(which), len(order), np.int64)
        while (live := np.flatnonzero(lo < hi)).size:
            mid = (lo[live] + hi[live]) // 2
            place, own = order[mid], which[live]
            n = self.common(own, place)
            x = self.items.words[np.minimum(self.items.start[own] + n, len(self.items.words) - 1)]
            y = self.text[np.minimum(place + n, len(self.text) - 1)]
            less = (n < self.items.left[own]) & (y < x)
            lo[live], hi[live] = np.where(less, mid + 1, lo[live]), np.where(less, hi[live], mid)
        near = [order[np.clip(lo + k, 0, len(order) - 1)] for k in (-1, 0)]
        same = [self.common(which, p) for p in near]
        return np.where(same[0] >= same[1], near[0], near[1]), np.maximum(*same)


def search_shard(buf: np.ndarray, at: np.ndarray, items: Items, powers: B.Powers) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, set[int], list[tuple]]]]:
    """Words of each row, and for rows with occurrences: hit words, items, longest matches."""
    buf = B.LOWER[buf]
    s, e, row = B.words(buf, at, B.WORD_BYTE)
    n_words = np.bincount(row, minlength=len(at) - 1)
    found: dict[int, tuple[np.ndarray, set[int], list[tuple]]] = {}
    if not len(items.start) or not len(s):
        return n_words, found
    h = B.Spans(buf, powers).hash(s, e)
    code = np.minimum(np.searchsorted(items.vocabulary, h), len(items.vocabulary) - 1)
    known = items.vocabulary[code] == h
    first = np.concatenate([[0], np.cumsum(n_words)])
    # how many known words of the same row follow from each word on
    stop = np.flatnonzero(~known | (np.arange(len(s)) == first[row]))
    bounds = np.concatenate([stop, [len(s)]])
    ends = bounds[np.searchsorted(bounds, np.arange(len(s)), "right").clip(max=len(bounds) - 1)]
    left = np.where(known, ends - np.arange(len(s)), 0)
    # words of runs long enough for a window, closed up; a separator after each run
    opens = np.concatenate([[True], (left[1:] != left[:-1] - 1) | (row[1:] != row[:-1])])
    run = np.cumsum(opens & known) - 1
    runs = np.flatnonzero(opens & known)
    if not len(runs):
        return n_words, found
    keep = np.flatnonzero(known & (left[runs][run] >= items.least))
    if not len(keep):
        return n_words, found
    slot = np.arange(len(keep)) + np.concatenate([[0], np.cumsum(run[keep][1:] != run[keep][:-1])])
    text = np.zeros(slot[-1] + 2, np.int32)
    text[slot] = code[keep] + 1
    back = np.zeros(len(text), np.int64)
    back[slot] = keep
    starts = slot[left[keep] >= items.least]
    order = suffix_array(text, starts, items.longest)
    lo, hi = search(text, order, items, items.size, False), search(text, order, items, items.size, True)
    some = np.flatnonzero(hi > lo)
    if not len(some):
        return n_words, found
    # the widest window that starts at each place of the order: a difference array for each width, the widest last
    width = np.zeros(len(order), np.int64)
    for d in np.unique(items.size[some]):
        own = some[items.size[some] == d]
        step = np.bincount(lo[own], minlength=len(order) + 1) - np.bincount(hi[own], minlength=len(order) + 1)
        width[np.cumsum(step[:-1]) > 0] = d
    open_ = np.flatnonzero(width)
    place = back[order[open_]]
    edge = np.bincount(place, minlength=len(s) + 1) - np.bincount(place + width[open_], minlength=len(s) + 1)
    hit = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    own = row[hit]
    cuts = np.flatnonzero(np.diff(own, prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(own)], strict=True):
        found[int(own[a])] = (hit[a:b] - first[own[a]], set(), [])
    # items of each distinct range; ranges nest only by width
    ranges = np.unique(np.stack([lo[some], hi[some], items.row[some]], 1), axis=0)
    cuts = np.flatnonzero(np.concatenate([[True], (ranges[1:, :2] != ranges[:-1, :2]).any(1)]))
    for a, b in zip(cuts, [*cuts[1:], len(ranges)], strict=True):
        for r in np.unique(row[back[order[ranges[a, 0] : ranges[a, 1]]]]):
            found[int(r)][1].update(ranges[a:b, 2].tolist())
    place, same = Longest(text, items, powers).find(some, order)
    place = back[place]
    for q, p, n in zip(some.tolist(), place.tolist(), same.tolist(), strict=True):
        found[int(row[p])][2].append((items.ids[items.row[q]], int(items.place[q]), int(p - first[row[p]]), n))
    return n_words, found


def _finder(items, keep: list[str], text: str, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready, powers = items.value, B.Powers()
        for batch in batches:
            buf, at = B.column_bytes(batch.column(text))
            for i, j in B.blocks(at, shard_bytes):
                n_words, found = search_shard(buf[at[i] : at[j]], at[i : j + 1] - at[i], ready, powers)
                rows = [found.get(r) for r in range(j - i)]
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in keep),
                        pa.array(n_words, pa.int64()),
                        pa.array([x[0].astype(np.int64).tobytes() if x else b"" for x in rows], pa.binary()),
                        pa.array([len(x[0]) if x else 0 for x in rows], pa.int64()),
                        pa.array([sorted({ready.ids[k] for k in x[1]}) if x else [] for x in rows], pa.list_(pa.string())),
                        pa.array([[dict(zip(MATCH.names, m, strict=True)) for m in x[2]] if x else [] for x in rows], pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int32()), ("doc_word", pa.int64()), ("n_words", pa.int32())]))),
                    ],
                    names=[*keep, *(f.name if f.name not in keep else f"found_{f.name}" for f in FOUND)],
                )

    return run


def find(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", window: int = 10, item_bytes: int = 16 << 20, shard_bytes: int = 1 << 20) -> DataFrame:
    """Columns ``keep`` of each row, with n_words, hits (64-bit word numbers), n_hit, items (sorted ids) and longest matches.

    ``longest`` has, for each item suffix of which this shard holds a window, the longest verbatim match in the shard, at
    the row that has it. A name that ``keep`` has already is prefixed ``found_``.
    """
    B.small_batches(docs)
    spark = docs.sparkSession
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.coalesce("text", F.lit("")).alias("t"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("t") + 16), F.lit(0))).first()[0]
    parts = max(1, -(-size // item_bytes))
    names = [f.name if f.name not in keep else f"found_{f.name}" for f in FOUND]
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(n, f.dataType) for n, f in zip(names, FOUND, strict=True))])
    block = lambda k: rows if parts == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k)

    def search_all(df: DataFrame, cols: list[str], out: T.StructType, k: int) -> DataFrame:
        own = block(k).collect()
        items = B.Shared(docs, Items([r["i"] for r in own], [r["t"] for r in own], window))
        return df.select(*dict.fromkeys([*cols, text])).mapInArrow(B.tidy(_finder(items, cols, text, shard_bytes)), out)

    if parts == 1:
        return search_all(docs, keep, schema, 0)
    # more items than one block: number the rows, search them for each block, and put each row's findings together
    numbered = checkpoint(docs.select(*dict.fromkeys([*keep, text])).withColumn("__row", F.monotonically_increasing_id()))
    wide = T.StructType([T.StructField("__row", T.LongType()), *FOUND.fields])
    found = reduce(DataFrame.unionAll, (search_all(numbered, ["__row"], wide, k) for k in range(parts)))
    merged = found.groupBy("__row").agg(F.max("n_words").alias("n_words"), F.collect_list("hits").alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("longest")).alias("longest"))

    @F.pandas_udf("binary")
    def union(x):
        return x.map(lambda parts: np.unique(np.frombuffer(b"".join(parts), np.int64)).tobytes())

    merged = merged.withColumn("hits", union("hits")).withColumn("n_hit", (F.octet_length("hits") / 8).cast("long"))
    merged = merged.select("__row", *(F.col(f.name).alias(n) for n, f in zip(names, FOUND, strict=True)))
    return numbered.select("__row", *keep).join(merged, "__row").select(*schema.names)


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each document."""
    found = find(docs, benchmark, ["doc_id"], **options)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def remove(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any hit word, with their columns as they are."""
    found = find(docs, benchmark, docs.columns, **options)
    hit = "n_hit" if "n_hit" not in docs.columns else "found_n_hit"
    return found.where(F.col(hit) == 0).select(*docs.columns)
