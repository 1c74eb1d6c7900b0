"""Columns of records packed into binary rows, dealt out by key, and told apart by place."""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bytes import small_batches

#: Bits of the table of documents; its size is fixed, so it can be sent to every task.
SLOTS = 1 << 23
LEAST = -(1 << 63)
#: Tasks that may share the rows of one key in a join.
SALTS = 64


class Records:
    """Columns of the same length that can be packed, sorted and cut."""

    def __init__(self, *columns: np.ndarray) -> None:
        self.c = columns

    def __len__(self) -> int:
        return len(self.c[0])

    def __getitem__(self, which) -> Records:
        return Records(*(x[which] for x in self.c))

    @staticmethod
    def join(parts: list[Records]) -> Records:
        return Records(*(np.concatenate(x) for x in zip(*(p.c for p in parts), strict=True)))

    def pack(self) -> bytes:
        head = [len(self), *(ord(x.dtype.char) for x in self.c)]
        return zstandard.ZstdCompressor(level=1).compress(np.array([len(head), *head], np.int64).tobytes() + b"".join(x.tobytes() for x in self.c))

    @staticmethod
    def unpack(data: bytes) -> Records:
        raw = zstandard.ZstdDecompressor().decompress(data)
        k = int(np.frombuffer(raw, np.int64, 1)[0])
        n, *kinds = np.frombuffer(raw, np.int64, k, 8).tolist()
        out, p = [], 8 * (k + 1)
        for x in map(chr, kinds):
            out.append(np.frombuffer(raw, x, n, p))
            p += n * out[-1].itemsize
        return Records(*out)


def by_part(kind: int, parts: int, r: Records, narrow: bool = False) -> list[tuple]:
    """(kind, part, 0, 0, packed records) for each part; the first column says which (by its high bits).

    ``narrow`` packs only the low 32 bits of that column; with those that chose the part they still tell keys apart.
    """
    if not len(r):
        return []
    part = ((r.c[0].astype(np.uint64) >> np.uint64(32)) % np.uint64(parts)).astype(np.uint32)
    order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
    part, r = part[order], r[order]
    if narrow:
        r = Records(r.c[0].astype(np.uint32), *r.c[1:])
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    return [(kind, int(part[a]), 0, 0, r[a:b].pack()) for a, b in zip(cuts, [*cuts[1:], len(part)], strict=True)]


def first_of_equals(keys: tuple[np.ndarray, ...], did: np.ndarray, th: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which records are the first of their key, and which are later ones at another place than the first."""
    head = keys[0]
    s = np.sort(head)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    first, later = np.ones(len(head), bool), np.zeros(len(head), bool)
    some = np.flatnonzero(np.isin(head, twice))
    if len(some):
        some = some[np.lexsort((start[some], th[some], did[some], *(k[some] for k in reversed(keys))))]
        new = np.concatenate([[True], np.logical_or.reduce([k[some][1:] != k[some][:-1] for k in keys])])
        lead = some[np.flatnonzero(new)[np.cumsum(new) - 1]]
        first[some] = new
        later[some] = ~new & ((did[some] != did[lead]) | (th[some] != th[lead]) | (start[some] != start[lead]))
    return first, later


def documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id (long), did (null first), th (hash of the text), slot, text (null as empty)."""
    small_batches(docs)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = own.select("doc_id", F.coalesce("doc_id", F.lit(LEAST)).alias("did"), F.xxhash64("text", F.col("doc_id").isNull()).alias("th"), "text")
    return own.withColumn("slot", slot(F.col("did"), F.col("th")))


def slot(did: Column, th: Column) -> Column:
    return F.pmod(F.xxhash64(did, th), F.lit(SLOTS))


def salted(df: DataFrame, *by: str) -> DataFrame:
    """``df`` with ``salt``: rows of one key are told apart by these columns, so that a key with a third of them is many tasks'."""
    return df.withColumn("salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int"))


def join_spread(rows: DataFrame, table: DataFrame, on: list[str], by: list[str]) -> DataFrame:
    """``rows`` joined with ``table``, which has a row a key: that row is dealt out to the salts of its rows first."""
    own = salted(rows, *by)
    wanted = own.select(*on, "salt").distinct().join(table.hint("merge"), on)
    return own.join(wanted.hint("merge"), [*on, "salt"]).drop("salt")


def bitmap(rows: DataFrame) -> np.ndarray:
    """For each slot whether a row (did, th) may have it. The bits come to the driver, SLOTS / 8 bytes whatever the input."""
    s = slot(F.col("did"), F.col("th"))
    bits = rows.select((s / 32768).cast("int").alias("a"), (s % 32768).alias("b")).groupBy("a").agg(F.bitmap_construct_agg("b").alias("bits"))
    out = np.zeros(SLOTS // 8, np.uint8)
    for r in bits.collect():
        out[r["a"] * 4096 : (r["a"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def has(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1
