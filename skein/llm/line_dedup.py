"""Line dedup by a deletion-neighbourhood join.

A line is dropped if a line that starts earlier in the corpus has the same words, or is at most one edit (a symbol
replaced, put in or left out) away. Words are separated by ASCII white space. The symbols of a line of ``NEAR_WORDS`` words or
more are its words; those of a line of fewer words (short ones, and scripts without blanks) are its characters other than
white space, and it needs ``NEAR_CHARS`` of them to be compared for an edit. Lines are judged on the input, so a line that is
dropped itself still counts as the earlier one. Lines without words stay.

*Candidates.* Of two lines one edit apart, the first halves of the shorter one's symbols agree or the second halves do. Each
line gives the hashes of both, for its own length and for one less; only lines that share one with a different line go on.
*Variants.* Each candidate gives the hash of its symbols, and of its symbols without each one in turn. Lines that share a
variant without the symbol at one place differ by that one; a line equal to another's variant lacks one. The earliest
line of a variant and place stands for all, so no pairs are made within a group.
*Verification.* The edit distance of each line and the earlier one is computed on the symbols. Lines with the same words are
told by two 64-bit hashes.

Earlier is the smaller doc_id (null first), then the smaller hash of the text, then the smaller line number. Rows that
repeat whole are one document and get one result; null text is empty and has no lines; an empty table gives none. A very
long text is held whole in one task (some 60 bytes of memory a byte of it). Columns of ``docs`` may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.session import checkpoint

from . import _bytes as B
from . import _records as R

NEAR_WORDS, NEAR_CHARS = 8, 20
BLOCK, FLUSH = 1 << 20, 1_000_000
ROWS = "kind int, part int, did long, th long, data binary"
#: Rows for a part: lines, halves, variants. Rows for a document: dropped lines, candidates.
LINES, HALVES, VARIANTS, DROPPED, CANDIDATES, CLAIMS = range(6)
SECOND = np.uint64(0xD6E8FEB86659FD93)
#: Sets hashes of characters apart from those of words.
CHARS = np.uint64(0xA0761D6478BD642F)


class Symbols:
    """The symbols of lines: where each line's first one is, how many it has, and hashes of any run of them."""

    def __init__(self, place: np.ndarray, value: np.ndarray, start: np.ndarray, end: np.ndarray, powers: B.Powers) -> None:
        self.first = np.searchsorted(place, start)
        self.n = np.searchsorted(place, end) - self.first
        up, self.down = powers.upto(len(place) + 2)
        self.sums, self.more = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * up[: len(place)])]) for w in (value, B.mix(value ^ SECOND)))

    def hash(self, start: np.ndarray, n: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
        sums = self.sums if sums is None else sums
        return B.mix((sums[start + n] - sums[start]) * self.down[start] + n.astype(np.uint64) * SECOND)

    def whole(self, line: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
        return self.hash(self.first[line], self.n[line], sums)

    def without(self, line: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Hashes of the symbols of ``line`` without the one at ``place``."""
        a, n = self.first[line], self.n[line]
        left, right = self.sums[a + place] - self.sums[a], self.sums[a + n] - self.sums[a + place + 1]
        return B.mix((left + right * self.down[1]) * self.down[a] + (n - 1).astype(np.uint64) * SECOND)

    def halves(self, line: np.ndarray) -> list[np.ndarray]:
        """First and second half of each line, as of its length and of one less."""
        a, n, out = self.first[line], self.n[line], []
        for m in (n, n - 1):
            p = m // 2
            for s, k, side in ((a, p, 1), (a + n - (m - p), m - p, 2)):
                out.append(B.mix(self.hash(s, k) ^ (m.astype(np.uint64) * np.uint64(4) + np.uint64(side))))
        return out


class Lines:
    """Lines of a block of texts: row, number in the row, bytes, words, and the characters of lines of few words."""

    def __init__(self, buf: np.ndarray, at: np.ndarray, powers: B.Powers) -> None:
        n = np.flatnonzero(buf == 10)
        start = np.sort(np.concatenate([at[:-1][at[1:] > at[:-1]], n[~np.isin(n + 1, at)] + 1]))
        self.row = np.searchsorted(at, start, "right") - 1
        self.start, self.end = start, np.minimum(np.concatenate([start[1:], [len(buf)]]), at[self.row + 1])
        self.number = np.arange(len(start)) - np.searchsorted(self.row, np.arange(len(at) - 1))[self.row]
        spans = B.Spans(buf, powers)
        s, e, _ = B.words(buf, at, B.SOLID_BYTE)
        self.words = Symbols(s, spans.hash(s, e), self.start, self.end, powers)
        few = np.flatnonzero((self.words.n > 0) & (self.words.n < NEAR_WORDS) & (self.end - self.start >= NEAR_CHARS))
        step = np.zeros(len(buf) + 1, np.int8)
        step[self.start[few]] += 1
        step[self.end[few]] -= 1
        c = np.flatnonzero((np.cumsum(step[:-1], dtype=np.int8) > 0) & ((buf & 0xC0) != 0x80) & B.SOLID_BYTE[buf])
        wide = 1 + sum((buf[c] >= x).astype(np.int64) for x in (0xC0, 0xE0, 0xF0))
        self.chars = Symbols(c, spans.hash(c, np.minimum(c + wide, len(buf))) ^ CHARS, self.start, self.end, powers)

    def near(self) -> list[tuple[Symbols, np.ndarray]]:
        """Symbols, and the lines that are compared by them."""
        long = self.words.n >= NEAR_WORDS
        return [(self.words, np.flatnonzero(long)), (self.chars, np.flatnonzero(~long & (self.chars.n >= NEAR_CHARS)))]


def _batches(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["kind", "part", "did", "th", "data"])


def _by_doc(kind: int, did: np.ndarray, th: np.ndarray, line: np.ndarray) -> list[tuple]:
    if not len(did):
        return []
    order = np.lexsort((line, th, did))
    did, th, line = did[order], th[order], line[order].astype(np.uint32)
    cuts = np.flatnonzero(np.concatenate([[True], (did[1:] != did[:-1]) | (th[1:] != th[:-1])]))
    return [(kind, int(th[a]) & 0x7FFFFFFF, int(did[a]), int(th[a]), line[a:b].tobytes()) for a, b in zip(cuts, [*cuts[1:], len(did)], strict=True)]


def _shared(r: R.Records) -> tuple[np.ndarray, np.ndarray]:
    """Of halves (half, line hash, did, th, line): those of more than one line hash, and the first of each half and line hash."""
    first, _ = R.first_of_equals((r.c[0], r.c[1]), *r.c[2:])
    own = r[first]
    s = np.sort(own.c[0])
    many = np.unique(s[1:][s[1:] == s[:-1]])
    return first, np.isin(r.c[0], many)


def _line_rows(parts: int):
    """Tasks over documents (did, th, text)."""

    def settle(lines: list[R.Records], halves: list[R.Records]) -> pa.RecordBatch:
        rows = []
        if lines:
            r = R.Records.join(lines)
            first, later = R.first_of_equals((r.c[0], r.c[1]), *r.c[2:])
            rows += R.by_part(LINES, parts, r[first]) + _by_doc(DROPPED, *r[later].c[2:])
        if halves:
            r = R.Records.join(halves)
            first, many = _shared(r)
            r, many = r[first], many[first]
            hot = r[many]
            rows += _by_doc(CANDIDATES, *hot.c[2:])
            # a half of many lines: two of them tell other tasks of it
            order = np.argsort(hot.c[0], kind="stable")
            new = np.concatenate([[True], hot.c[0][order][1:] != hot.c[0][order][:-1]]) if len(order) else np.zeros(0, bool)
            rank = np.arange(len(order)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            rows += R.by_part(HALVES, parts, R.Records.join([r[~many], hot[order[rank < 2]]]))
        return _batches(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, lines, halves, held = B.Powers(), [], [], 0
        for batch in batches:
            buf, at = B.column_bytes(batch.column("text"))
            did, th = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("did", "th"))
            for i, j in B.blocks(at, BLOCK):
                x = Lines(buf[at[i] : at[j]], at[i : j + 1] - at[i], powers)
                whole = np.flatnonzero(x.words.n)
                if not len(whole):
                    continue
                place = lambda w, x=x, i=i, j=j: (did[i:j][x.row[w]], th[i:j][x.row[w]], x.number[w].astype(np.uint32))
                lines.append(R.Records(x.words.whole(whole), x.words.whole(whole, x.words.more), *place(whole)))
                held += len(whole)
                for symbols, near in x.near():
                    if len(near):
                        h = symbols.whole(near)
                        halves += [R.Records(k, h, *place(near)) for k in symbols.halves(near)]
                        held += 4 * len(near)
                if held > FLUSH:
                    yield settle(lines, halves)
                    lines, halves, held = [], [], 0
        yield settle(lines, halves)

    return run


def _merge_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = {LINES: [], HALVES: []}
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        for k, own in held.items():
            own += [R.Records.unpack(x) for x in batch.column("data").filter(pa.array(kind == k)).to_pylist()]
        if (kind > HALVES).any():
            yield batch.filter(pa.array(kind > HALVES))
    if held[LINES]:
        r = R.Records.join(held.pop(LINES))
        _, later = R.first_of_equals((r.c[0], r.c[1]), *r.c[2:])
        yield _batches(_by_doc(DROPPED, *r[later].c[2:]))
    if held[HALVES]:
        r = R.Records.join(held.pop(HALVES))
        first, many = _shared(r)
        yield _batches(_by_doc(CANDIDATES, *r[first & many].c[2:]))


CLAIM = "kind int, part int, did long, th long, line long, edid long, eth long, eline long, text string, data binary"
CLAIM_TYPES = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
CLAIM_NAMES = [x.split()[0] for x in CLAIM.split(", ")]


def _claim_batch(parts: list[tuple] = (), lines: list[tuple] = (), claims: R.Records | None = None) -> pa.RecordBatch:
    if claims is not None:
        n = len(claims)
        cols = [pa.array(np.full(n, k, np.int32)) for k in (CLAIMS, 0)] + [pa.array(c.astype(np.int64)) for c in claims.c] + [pa.nulls(n, pa.string()), pa.nulls(n, pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names=CLAIM_NAMES)
    rows = [(k, p, 0, 0, 0, 0, 0, 0, None, d) for k, p, _, _, d in parts] + [(LINES, 0, a, b, c, 0, 0, 0, t, None) for a, b, c, t in lines]
    cols = list(zip(*rows, strict=True)) if rows else [()] * 10
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, CLAIM_TYPES, strict=True)], names=CLAIM_NAMES)


def _claims(r: R.Records) -> tuple[np.ndarray, R.Records]:
    """Of variants (hash, place or -1, did, th, line): which go on, and (did, th, line, earlier did, th, line) for the rest.

    For each variant and place the earliest goes on. Others of that place differ from it by one word; those of other places
    can only be one edit from a whole line (place -1) of that hash.
    """
    order = np.lexsort((r.c[4], r.c[3], r.c[2], r.c[1], r.c[0]))
    s = r[order]
    v, place = s.c[0], s.c[1]
    new = np.concatenate([[True], (v[1:] != v[:-1]) | (place[1:] != place[:-1])])
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    out = [(np.flatnonzero(~new), lead[~new])]
    # a whole line (place -1 sorts first) against the earliest of each place
    group = np.concatenate([[True], v[1:] != v[:-1]])
    head = np.flatnonzero(group)[np.cumsum(group) - 1]
    cut = np.flatnonzero(new & (place >= 0) & (place[head] == -1))
    whole = head[cut]
    before = lambda a, b: (s.c[2][a] < s.c[2][b]) | (s.c[2][a] == s.c[2][b]) & ((s.c[3][a] < s.c[3][b]) | (s.c[3][a] == s.c[3][b]) & (s.c[4][a] < s.c[4][b]))
    earlier = before(whole, cut)
    out += [(cut[earlier], whole[earlier]), (whole[~earlier], cut[~earlier])]
    a, b = (np.concatenate(x) for x in zip(*out, strict=True))
    go = np.zeros(len(r), bool)
    go[order] = new
    claims = R.Records(*(c[a] for c in s.c[2:]), *(c[b] for c in s.c[2:]))
    return go, claims[(claims.c[0] != claims.c[3]) | (claims.c[1] != claims.c[4]) | (claims.c[2] != claims.c[5])]


def _variant_rows(parts: int):
    """Tasks over documents with candidates (did, th, packed, lines)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, held, n = B.Powers(), [], 0

        def settle():
            go, claims = _claims(r := R.Records.join(held))
            yield _claim_batch(R.by_part(VARIANTS, parts, r[go]))
            yield _claim_batch(claims=claims)

        for batch in batches:
            z = zstandard.ZstdDecompressor()
            texts = []
            for did, th, packed, lines in zip(batch.column("did").to_pylist(), batch.column("th").to_pylist(), batch.column("packed"), batch.column("lines"), strict=True):
                raw = np.frombuffer(z.decompress(packed.as_py()), np.uint8)
                x = Lines(raw, np.array([0, len(raw)]), powers)
                own = np.unique(np.concatenate([np.frombuffer(p, np.uint32) for p in lines.as_py()])).astype(np.int64)
                texts += [(did, th, int(k), raw[x.start[k] : x.end[k]].tobytes().decode("utf-8", "replace")) for k in own]
                for symbols, near in x.near():
                    some = near[np.isin(near, own)]
                    size = symbols.n[some]
                    line = np.repeat(some, size)
                    place = np.arange(len(line)) - np.repeat(np.cumsum(size) - size, size)
                    v = np.concatenate([symbols.whole(some), symbols.without(line, place)])
                    line, place = np.concatenate([some, line]), np.concatenate([np.full(len(some), -1), place])
                    held.append(R.Records(v, place.astype(np.int32), np.full(len(v), did, np.int64), np.full(len(v), th, np.int64), line.astype(np.uint32)))
                    n += len(v)
                if n > FLUSH:
                    yield from settle()
                    held, n = [], 0
            yield _claim_batch(lines=texts)
        if held:
            yield from settle()

    return run


def _merge_variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = []
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        held += [R.Records.unpack(x) for x in batch.column("data").filter(pa.array(kind == VARIANTS)).to_pylist()]
        if (kind != VARIANTS).any():
            yield batch.filter(pa.array(kind != VARIANTS))
    if held:
        yield _claim_batch(claims=_claims(R.Records.join(held))[1])


def symbols_of(line: str) -> list[bytes] | str:
    """What edits of a line are counted in."""
    words = line.encode().split()
    return words if len(words) >= NEAR_WORDS else b"".join(words).decode()


def one_edit(a: list | str, b: list | str) -> bool:
    """Whether two sequences are at most one edit apart."""
    if abs(len(a) - len(b)) > 1:
        return False
    n = min(len(a), len(b))
    left = next((i for i in range(n) if a[i] != b[i]), n)
    right = next((i for i in range(n - left) if a[-1 - i] != b[-1 - i]), n - left)
    return left + right >= max(len(a), len(b)) - 1


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = [one_edit(symbols_of(a), symbols_of(b)) for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)]
        rows = batch.filter(pa.array(ok, pa.bool_()))
        yield _batches([(DROPPED, 0, d, t, np.uint32(k).tobytes()) for d, t, k in zip(*(rows.column(c).to_pylist() for c in ("did", "th", "line")), strict=True)])


def _pack(bits, member: bool, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            batch = batch.filter(pa.array(R.has(bits.value, batch.column("__slot").to_numpy()) == member))
            buf, at = B.column_bytes(batch.column("__text"))
            packed = pa.array([z.compress(buf[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), packed], names=[*(c.removeprefix("__k_") for c in keep[:-2]), "__did", "__th", "__packed"])

    return run


def _cut(keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for packed, dropped in zip(batch.column("__packed"), batch.column("__dropped"), strict=True):
                raw = z.decompress(packed.as_py())
                lines = raw.split(b"\n") if raw else []
                gone = set(np.concatenate([np.frombuffer(p, np.uint32) for p in dropped.as_py()]).tolist()) if dropped.is_valid and len(dropped) else ()
                kept = b"\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else raw
                out.append((kept.decode("utf-8", "replace"), len(lines), len(gone)))
            cols = list(zip(*out, strict=True)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64()), strict=True))], names=[*keep, "__new", "__lines", "__gone"])

    return run


def drop_lines(docs: DataFrame, text: str = "text", part_bytes: int = 12 << 20) -> DataFrame:
    """``docs`` with ``__new`` (the text without dropped lines), ``__lines`` and ``__gone`` (numbers of lines); all rows stay."""
    spark = docs.sparkSession
    own = R.documents(docs, text)
    size = own.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    parts = max(1, -(-size // part_bytes))
    first = checkpoint(own.select("did", "th", "text").mapInArrow(B.tidy(_line_rows(parts)), ROWS).repartitionById(parts, F.pmod("part", F.lit(parts)).cast("int")).mapInArrow(B.tidy(_merge_lines), ROWS))
    lists = lambda df, kind: df.where(F.col("kind") == kind).groupBy("did", "th").agg(F.collect_list("data").alias("lines"))

    slots = own.select(F.col("did").alias("__did"), F.col("th").alias("__th"), F.col("text").alias("__text"), F.col("slot").alias("__slot"))
    candidates = first.where(F.col("kind") == CANDIDATES)
    bits = spark.sparkContext.broadcast(R.bitmap(candidates))
    packed = slots.mapInArrow(B.tidy(_pack(bits, True, ["__did", "__th"])), "__did long, __th long, __packed binary").toDF("did", "th", "packed")
    variants = packed.join(lists(first, CANDIDATES), ["did", "th"]).mapInArrow(B.tidy(_variant_rows(parts)), CLAIM)
    found = checkpoint(variants.repartitionById(parts, F.pmod(F.when(F.col("kind") == VARIANTS, F.col("part").cast("long")).otherwise(F.xxhash64("did", "th", "line")), F.lit(parts)).cast("int")).mapInArrow(B.tidy(_merge_variants), CLAIM))
    where = lambda d, t, k: F.struct(F.col(d), F.col(t), F.col(k))
    lines = found.where(F.col("kind") == LINES).groupBy("did", "th", "line").agg(F.first("text").alias("text"))
    claims = found.where(F.col("kind") == CLAIMS).select("did", "th", "line", "edid", "eth", "eline").distinct()
    # very many lines may claim one earlier line
    both = R.join_spread(claims.join(lines.withColumnRenamed("text", "a"), ["did", "th", "line"]), lines.toDF("edid", "eth", "eline", "b"), ["edid", "eth", "eline"], ["did", "th", "line"])
    near = both.select("did", "th", "line", "a", "b").mapInArrow(B.tidy(_verify), ROWS)

    dropped = checkpoint(lists(first.where(F.col("kind") == DROPPED).unionAll(near), DROPPED))
    bits = spark.sparkContext.broadcast(R.bitmap(dropped))
    keep = [f"__k_{c}" for c in docs.columns if c != text]
    t = F.coalesce(F.col(text), F.lit(""))
    ids = docs.select(*(F.col(c).alias(f"__k_{c}") for c in docs.columns if c != text), F.coalesce(F.col("doc_id").cast("long"), F.lit(R.LEAST)).alias("__did"), F.xxhash64(t, F.col("doc_id").isNull()).alias("__th"), t.alias("__text"), F.col(text).isNull().alias("__null"))
    ids = ids.withColumn("__slot", R.slot(F.col("__did"), F.col("__th")))
    names = [c for c in docs.columns if c != text] + ["__null"]
    pack = lambda member: ids.mapInArrow(B.tidy(_pack(bits, member, [*keep, "__null", "__did", "__th"])), T.StructType([*(docs.schema[c] for c in names[:-1]), T.StructField("__null", T.BooleanType()), T.StructField("__did", T.LongType()), T.StructField("__th", T.LongType()), T.StructField("__packed", T.BinaryType())]))
    hit = pack(True).join(dropped.toDF("__did", "__th", "__dropped"), ["__did", "__th"], "left")
    rest = pack(False).withColumn("__dropped", F.lit(None).cast("array<binary>"))
    out = T.StructType([*(docs.schema[c] for c in names[:-1]), T.StructField("__null", T.BooleanType()), T.StructField("__new", T.StringType()), T.StructField("__lines", T.LongType()), T.StructField("__gone", T.LongType())])
    cut = lambda df: df.select(*names, "__packed", "__dropped").mapInArrow(B.tidy(_cut(names)), out)
    new = cut(hit).unionAll(cut(rest))
    return new.select(*(F.when(F.col("__null"), None).otherwise(F.col("__new")).alias(text) if c == text else F.col(c) for c in docs.columns), "__new", "__lines", "__gone")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, text (null text: empty) for each row."""
    return drop_lines(docs.select("doc_id", "text")).select("doc_id", F.col("__lines").alias("n_lines"), F.col("__gone").alias("n_dropped"), F.col("__new").alias("text"))
