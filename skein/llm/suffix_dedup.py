"""Removal of repeated byte strings across a corpus by a prefix-free parse.

A byte is removed if a string of ``WINDOW`` bytes that covers it also starts earlier in the corpus: at a smaller doc_id, or
earlier in the same document. Strings never cross documents and are judged on the input.

*Parse.* The trigger of a string is the ``GRAM``-byte part with the least rolling hash (the leftmost of equals). A phrase is a
maximal run of consecutive string starts with one trigger, and its text reaches to the end of the last string; phrases
overlap by ``WINDOW - 1`` bytes, and every string lies in exactly one phrase. Equal strings have equal triggers, so strings
of two phrases can be equal only if the phrases have equal triggers.

*Corpus order.* Occurrences of phrases are sorted by trigger, phrase and place. All but the first of a phrase are removed
whole. The phrases of triggers with several make up the dictionary (the ends of repeated passages, mostly): their suffixes
are ranked by their first ``WINDOW`` bytes with prefix doubling, and of suffixes with one rank all but the first in corpus
order, by the first occurrence of their phrase, are removed. Suffixes of different triggers never meet, so the dictionary is
dealt out by trigger.

Each task first settles what repeats within its own rows, so that a passage with very many copies reaches the shuffle once
a task. A trigger with more than ``HOT`` phrases in any block of text, or more than ``MANY`` in all, isn't left to one task:
the strings of all its phrases, from every block, are dealt out by hash, string by string.

A document is known by doc_id and a hash of its text; rows that repeat whole are one document and get one result. Of rows
with one doc_id and different texts, that with the smaller hash is earlier. A null doc_id comes first; null text is empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import checkpoint

from . import _bytes as B
from . import _records as R

WINDOW, GRAM, HOT, MANY = 100, 32, 8, 4096
BLOCK, FLUSH = 1 << 20, 1_000_000
ROWS = "kind int, part int, did long, th long, data binary"
#: Kinds of rows between tasks: phrases, strings, the dictionary (for a part), removed runs, runs to be resolved (for a document).
PHRASES, STRINGS, DICTIONARY, REMOVED, RESOLVE = range(5)


def parse(buf: np.ndarray, at: np.ndarray, spans: B.Spans) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of strings, trigger hash and phrase hash of each phrase; ``at`` are the documents' offsets."""
    n = len(buf) - WINDOW + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    place = np.arange(len(buf) - GRAM + 1)
    gram = spans.hash(place, place + GRAM)
    bits = np.uint64(max(20, len(buf).bit_length()))
    least = (gram >> bits << bits) | place.astype(np.uint64)
    width, wanted = 1, WINDOW - GRAM + 1
    while 2 * width <= wanted:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < wanted:
        least = np.minimum(least[: n], least[wanted - width : wanted - width + n])
    trigger = (least[:n] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    step = np.zeros(len(buf) + 1, np.int32)  # strings that would cross the end of a document
    ends = at[1:][at[1:] > at[:-1]]
    np.add.at(step, np.maximum(ends - WINDOW + 1, 0), 1)
    np.add.at(step, ends, -1)
    valid = np.cumsum(step[:n]) == 0
    opens = valid.copy()
    opens[1:] &= ~valid[:-1] | (trigger[1:] != trigger[:-1])
    start = np.flatnonzero(opens)
    run = np.cumsum(opens) - 1
    size = np.bincount(run[valid], minlength=len(start)).astype(np.int64)
    return start, size, gram[trigger[start]], spans.hash(start, start + size + WINDOW - 1)


def _chunks(at: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first row, end row, first byte, end byte): whole rows, or overlapping parts of a long one."""
    for i, j in B.blocks(at, BLOCK):
        if at[j] - at[i] <= 2 * BLOCK:
            yield i, j, at[i], at[j]
        else:
            for a in range(at[i], max(at[i] + 1, at[j] - WINDOW + 1), BLOCK):
                yield i, j, a, min(at[j], a + BLOCK + WINDOW - 1)


def _batches(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["kind", "part", "did", "th", "data"])


def _by_doc(kind: int, did: np.ndarray, th: np.ndarray, *columns: np.ndarray) -> list[tuple]:
    """A row for each document, with 32-bit columns (the first of them start)."""
    if not len(did):
        return []
    order = np.lexsort((columns[0], th, did))
    did, th, columns = did[order], th[order], np.stack([c[order].astype(np.uint32) for c in columns])
    cuts = np.flatnonzero(np.concatenate([[True], (did[1:] != did[:-1]) | (th[1:] != th[:-1])]))
    return [(kind, int(th[a]) & 0x7FFFFFFF, int(did[a]), int(th[a]), columns[:, a:b].tobytes()) for a, b in zip(cuts, [*cuts[1:], len(did)], strict=True)]


def _merged_runs(did: np.ndarray, th: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of consecutive starts: did, th, start, size."""
    order = np.lexsort((start, th, did))
    did, th, start = did[order], th[order], start[order].astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (did[1:] != did[:-1]) | (th[1:] != th[:-1]) | (start[1:] != start[:-1] + 1)])) if len(did) else np.zeros(0, np.int64)
    return did[new], th[new], start[new], np.diff(np.concatenate([new, [len(did)]]))


def _strings(parts: int, r: R.Records) -> list[tuple]:
    """Rows for strings (hash, did, th, start): the first of equals go to their part, later ones are removed."""
    first, later = R.first_of_equals((r.c[0],), *r.c[1:])
    return [*R.by_part(STRINGS, parts, r[first]), *_by_doc(REMOVED, *_merged_runs(*r[later].c[1:]))]


def _explode(spans: B.Spans, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrase number and hash place of each string of the phrases."""
    which = np.repeat(np.arange(len(start)), size)
    place = start[which] + np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
    return which, place


def _parse_rows(parts: int):
    """Tasks over documents: (did, th, text) to rows."""

    def settle(phrases: list[R.Records], strings: list[R.Records]) -> pa.RecordBatch:
        rows = []
        if phrases:
            r = R.Records.join(phrases)
            first, later = R.first_of_equals((r.c[1], r.c[0]), *r.c[2:5])
            # the mark belongs to the trigger: it must outlive the phrase that brought it
            r = R.Records(*r.c[:6], np.isin(r.c[0], r.c[0][r.c[6]]))
            gone = r[later]
            rows += _by_doc(REMOVED, gone.c[2], gone.c[3], gone.c[4], gone.c[5])
            rows += R.by_part(PHRASES, parts, r[first], narrow=True)
        if strings:
            rows += _strings(parts, R.Records.join(strings))
        return _batches(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, phrases, strings, held = B.Powers(), [], [], 0
        for batch in batches:
            buf, at = B.column_bytes(batch.column("text"))
            did, th = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("did", "th"))
            for i, j, a, b in _chunks(at):
                part = buf[a:b]
                spans, local = B.Spans(part, powers), np.clip(at[i : j + 1] - a, 0, b - a)
                start, size, trigger, phrase = parse(part, local, spans)
                if not len(start):
                    continue
                row = np.searchsorted(local, start, "right") - 1
                r = R.Records(trigger, phrase, did[i:j][row], th[i:j][row], (start + a - at[i:j][row]).astype(np.uint32), size.astype(np.uint8))
                # a trigger with very many phrases: all but a few go on as strings, and those few carry a mark, by which the
                # phrases of the trigger in all blocks (these few, too) become strings, for all of them to meet
                order = np.lexsort((phrase, trigger))
                t, q = trigger[order], phrase[order]
                new = np.concatenate([[True], t[1:] != t[:-1]])
                kind = np.cumsum(new | np.concatenate([[True], q[1:] != q[:-1]]))
                many = np.zeros(len(order), bool)
                many[order] = kind - kind[np.flatnonzero(new)][np.cumsum(new) - 1] >= HOT
                if many.any():
                    which, place = _explode(spans, start[many], size[many])
                    over = r[many]
                    h = spans.hash(place, place + WINDOW)
                    strings.append(R.Records(h, over.c[2][which], over.c[3][which], (over.c[4][which] + (place - start[many][which])).astype(np.uint32)))
                    held += int(size[many].sum())
                r = R.Records(*r.c, np.isin(trigger, trigger[many]))[~many]
                phrases.append(r)
                held += len(r)
                if held > FLUSH:
                    yield settle(phrases, strings)
                    phrases, strings, held = [], [], 0
        yield settle(phrases, strings)

    return run


def _merge_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tasks over parts: phrases become removed runs and runs to resolve; other rows pass."""
    held = []
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        held += [R.Records.unpack(x) for x in batch.column("data").filter(pa.array(kind == PHRASES)).to_pylist()]
        if (kind != PHRASES).any():
            yield batch.filter(pa.array(kind != PHRASES))
    if not held:
        return
    r = R.Records.join(held)
    del held
    first, later = R.first_of_equals((r.c[1], r.c[0]), *r.c[2:5])
    marked = np.unique(r.c[0][r.c[6]])
    gone, r = r[later], r[first]
    yield _batches(_by_doc(REMOVED, gone.c[2], gone.c[3], gone.c[4], gone.c[5]))
    triggers, n = np.unique(r.c[0], return_counts=True)
    own = n[np.searchsorted(triggers, r.c[0])]
    hot = np.isin(r.c[0], marked)
    open_ = (own > 1) | hot
    more = r[open_]
    yield _batches(_by_doc(RESOLVE, *more.c[2:6], more.c[0], (own[open_] > MANY) | hot[open_]))


def _runs(parts: list[bytes], columns: int = 2) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, np.uint32).reshape(columns, -1) for x in parts], axis=1).astype(np.int64) if parts else np.zeros((columns, 0), np.int64)


def _resolve_rows(parts: int):
    """Tasks over documents with runs to resolve: (did, th, packed, runs) to rows of the dictionary, or of strings."""

    def settle(phrases: list[R.Records], texts: list[bytes], strings: list[R.Records]) -> pa.RecordBatch:
        rows = []
        if phrases:
            r = R.Records.join(phrases)
            size = r.c[4].astype(np.int64) + WINDOW - 1
            end = np.cumsum(size)
            part = ((r.c[0] >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.concatenate([[True], np.diff(part[order]) != 0]))
            raw = np.frombuffer(b"".join(texts), np.uint8)
            for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
                own = order[a:b]
                text = np.concatenate([raw[end[k] - size[k] : end[k]] for k in own])
                head = r[own].pack()
                rows.append((DICTIONARY, int(part[own[0]]), 0, len(head), head + zstandard.ZstdCompressor(level=1).compress(text.tobytes())))
        if strings:
            rows += _strings(parts, R.Records.join(strings))
        return _batches(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, phrases, texts, strings, held = B.Powers(), [], [], [], 0
        for batch in batches:
            dids, ths = batch.column("did").to_pylist(), batch.column("th").to_pylist()
            z = zstandard.ZstdDecompressor()
            for did, th, packed, runs in zip(dids, ths, batch.column("packed"), batch.column("runs"), strict=True):
                start, size, trigger, many = _runs(runs.as_py(), 4)
                text = z.decompress(packed.as_py())
                few = np.flatnonzero(many == 0)
                if len(few):
                    texts += [text[a : a + n + WINDOW - 1] for a, n in zip(start[few].tolist(), size[few].tolist(), strict=True)]
                    phrases.append(R.Records(B.mix(trigger[few].astype(np.uint64)), np.full(len(few), did, np.int64), np.full(len(few), th, np.int64), start[few].astype(np.uint32), size[few].astype(np.uint8)))
                    held += 8 * len(few)
                order = np.flatnonzero(many)[np.argsort(start[many > 0])]
                start, size = start[order], size[order]
                k = 0
                while k < len(start):  # a stretch of the text at a time
                    end = int(np.searchsorted(start, start[k] + BLOCK))
                    a = int(start[k])
                    b = int((start[k:end] + size[k:end]).max()) + WINDOW - 1
                    spans = B.Spans(np.frombuffer(text, np.uint8)[a:b], powers)
                    _, place = _explode(spans, start[k:end] - a, size[k:end])
                    strings.append(R.Records(spans.hash(place, place + WINDOW), np.full(len(place), did, np.int64), np.full(len(place), th, np.int64), (place + a).astype(np.uint32)))
                    held += len(place)
                    k = end
                if held > FLUSH:
                    yield settle(phrases, texts, strings)
                    phrases, texts, strings, held = [], [], [], 0
        yield settle(phrases, texts, strings)

    return run


def suffix_ranks(text: np.ndarray) -> np.ndarray:
    """Ranks of all suffixes by their first ``WINDOW`` bytes (8, then doubled, then two that overlap); the end is padded."""
    wide = np.concatenate([text, np.zeros(WINDOW + 8, np.uint8)]).astype(np.uint64)
    key = np.zeros(len(text) + WINDOW, np.uint64)
    for k in range(8):
        key |= wide[k : k + len(key)] << np.uint64(56 - 8 * k)
    _, rank = np.unique(key, return_inverse=True)
    for step in (8, 16, 32, WINDOW - 64):
        after = np.concatenate([rank[step:], np.zeros(step, rank.dtype)])
        _, rank = np.unique(rank.astype(np.uint64) << np.uint64(32) | after.astype(np.uint64), return_inverse=True)
    return rank[: len(text)]


def _merge_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tasks over parts: the dictionary and strings become removed runs."""
    strings, phrases, texts = [], [], []
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        strings += [R.Records.unpack(x) for x in batch.column("data").filter(pa.array(kind == STRINGS)).to_pylist()]
        own = batch.filter(pa.array(kind == DICTIONARY))
        for cut, data in zip(own.column("th").to_pylist(), own.column("data").to_pylist(), strict=True):
            phrases.append(R.Records.unpack(data[:cut]))
            texts.append(zstandard.ZstdDecompressor().decompress(data[cut:]))
        if (kind == REMOVED).any():
            yield batch.filter(pa.array(kind == REMOVED))
    if strings:
        r = R.Records.join(strings)
        _, later = R.first_of_equals((r.c[0],), *r.c[1:])
        yield _batches(_by_doc(REMOVED, *_merged_runs(*r[later].c[1:])))
    if phrases:
        r = R.Records.join(phrases)
        raw = np.frombuffer(b"".join(texts), np.uint8)
        del phrases, texts
        end = np.cumsum(r.c[4].astype(np.int64) + WINDOW - 1)
        order = np.argsort(r.c[0], kind="stable")
        new = np.concatenate([[True], r.c[0][order][1:] != r.c[0][order][:-1]])
        # some triggers at a time: their suffixes meet no others
        done = np.cumsum(r.c[4][order].astype(np.int64) + WINDOW - 1)
        block = (done[np.flatnonzero(new)] - 1) // BLOCK
        cuts = np.flatnonzero(new)[np.concatenate([[True], block[1:] != block[:-1]])]
        for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
            own = order[a:b]
            if b - a > 1:
                yield _batches(_repeated_suffixes(r[own], [raw[e - n : e] for e, n in zip(end[own].tolist(), (r.c[4][own].astype(np.int64) + WINDOW - 1).tolist(), strict=True)]))


def _repeated_suffixes(r: R.Records, texts: list[np.ndarray]) -> list[tuple]:
    """Removed runs of phrases (trigger, did, th, start, size) with their texts."""
    size = r.c[4].astype(np.int64)
    first = np.cumsum(size + WINDOW - 1) - (size + WINDOW - 1)
    rank = suffix_ranks(np.concatenate(texts))
    which = np.repeat(np.arange(len(size)), size)
    step = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
    did, th, start = r.c[1][which], r.c[2][which], r.c[3][which].astype(np.int64) + step
    _, later = R.first_of_equals((rank[first[which] + step],), did, th, start)
    return _by_doc(REMOVED, *_merged_runs(did[later], th[later], start[later]))


def covered(n: int, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which of ``n`` bytes the strings starting in the runs cover."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, np.minimum(start + size + WINDOW - 1, n), -1)
    return np.cumsum(step[:n]) > 0


def _cut(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            z = zstandard.ZstdDecompressor()
            for packed, runs in zip(batch.column("packed"), batch.column("runs"), strict=True):
                raw = z.decompress(packed.as_py())
                gone = covered(len(raw), *_runs(runs.as_py() or []))
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if gone.any() else raw
                spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                out.append((len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest(), *([kept] if keep_text else [])))
            cols = list(zip(*out, strict=True)) if out else [()] * (5 if keep_text else 4)
            kinds = [pa.int64()] * 3 + [pa.string()] + [pa.binary()] * keep_text
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_text
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", *names])

    return run


def _pack(bits, member: bool):
    """Packed texts of the documents whose slot is set (or, without ``member``, of those whose slot is not)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            batch = batch.filter(pa.array(R.has(bits.value, batch.column("slot").to_numpy()) == member))
            buf, at = B.column_bytes(batch.column("text"))
            packed = pa.array([z.compress(buf[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "did", "th")), packed], names=["doc_id", "did", "th", "packed"])

    return run


def remove_repeats(docs: DataFrame, part_bytes: int = 12 << 20, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and with ``keep_text`` the remaining bytes) for each row."""
    spark = docs.sparkSession
    own = R.documents(docs)
    size = own.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    parts = max(1, -(-size // part_bytes))
    packed_as = "doc_id long, did long, th long, packed binary"
    runs = lambda df, kind: df.where(F.col("kind") == kind).groupBy("did", "th").agg(F.collect_list("data").alias("runs"))

    packed = lambda bits, member: own.mapInArrow(B.tidy(_pack(bits, member)), packed_as)

    parsed = own.select("did", "th", "text").mapInArrow(B.tidy(_parse_rows(parts)), ROWS)
    first = checkpoint(parsed.repartitionById(parts, F.pmod("part", F.lit(parts)).cast("int")).mapInArrow(B.tidy(_merge_phrases), ROWS))
    resolve = first.where(F.col("kind") == RESOLVE)
    affected = spark.sparkContext.broadcast(R.bitmap(resolve))
    open_runs = packed(affected, True).join(runs(first, RESOLVE), ["did", "th"]).select("did", "th", "packed", "runs").mapInArrow(B.tidy(_resolve_rows(parts)), ROWS)
    rest = open_runs.unionAll(first.where(F.col("kind") == STRINGS)).repartitionById(parts, F.pmod("part", F.lit(parts)).cast("int")).mapInArrow(B.tidy(_merge_rest), ROWS)
    removed = checkpoint(first.where(F.col("kind") == REMOVED).unionAll(rest))
    affected = spark.sparkContext.broadcast(R.bitmap(removed))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    cut = packed(affected, True).join(runs(removed, REMOVED), ["did", "th"], "left").select("doc_id", "packed", "runs").mapInArrow(B.tidy(_cut(keep_text)), schema)
    # documents that lose nothing need no shuffle
    whole = packed(affected, False).select("doc_id", "packed", F.array().cast("array<binary>").alias("runs")).mapInArrow(B.tidy(_cut(keep_text)), schema)
    return cut.unionAll(whole)
