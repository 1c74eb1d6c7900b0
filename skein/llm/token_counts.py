"""Token counts that follow edits without counting whole texts anew.

For each document a segment tree is kept over its pre-tokens: leaves hold the text, characters and tokens of ``LEAF``
pre-tokens or so, inner nodes their sums. An edit replaces characters [start, end) by a string. Pre-tokens are matches of a
pattern that looks at most ``AHEAD`` characters past its match, so all pre-tokens that end so far before the edit stay;
matching starts again at the next boundary and stops as soon as it meets an old boundary behind the edit, from where on
everything is as before. Only the pre-tokens between are encoded, the leaves they lie in rewritten, and the sums above those
updated; an edit reads no other leaf. Trees are a column: ``with_trees`` counts texts once, ``apply_edits`` takes stored trees
and new edits, and gives texts and trees for the next edits.

Edits of a document apply one after the other, in the order (seq, start, end, replacement), each to the text that the ones
before have made. Places beyond the text are clipped, a null replacement is empty, a null text is an empty one, edits with null
places and edits of documents that don't exist do nothing. Each row is a document, also if rows repeat; an empty table gives
none; a column to be kept must not have the name of a result. A text and its tree are held whole by one task. The vocabulary
file is a parameter.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _bytes as B
from ._matches import places

#: The pre-tokens of the byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LEAF, AHEAD = 64, 3
EDITS = "array<struct<seq:long,start:long,end:long,replacement:string>>"


class Counter:
    """Tokens of pre-tokens; what has been seen is remembered, up to ``most`` pre-tokens."""

    def __init__(self, vocabulary: str, pattern: str = PATTERN, most: int = 500_000) -> None:
        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(pattern)
        self.known: dict[str, int] = {}
        self.most = most
        self.encoded = 0

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known
        new = set(pieces).difference(known)
        if new:
            if len(known) + len(new) > self.most:
                known.clear()
                new = set(pieces)
            known.update((p, len(self.encoding._core_bpe.encode_single_piece(p.encode("utf-8", "surrogatepass")))) for p in new)
        self.encoded += len(pieces)
        return [known[p] for p in pieces]

    def whole(self, text: str) -> int:
        return sum(self.counts(self.split.findall(text)))


class Tree:
    """Segment tree over leaves of pre-tokens (text, their characters, their tokens); node 1 is the root, leaf i is node ``size + i``."""

    def __init__(self, text: str, lengths: list[int], counts: list[int]) -> None:
        self.leaves = self._dealt(text, lengths, counts, LEAF) or [("", [], [])]
        self._build()

    @staticmethod
    def _dealt(text: str, lengths: list[int], counts: list[int], each: int) -> list[tuple[str, list[int], list[int]]]:
        out, at = [], 0
        for i in range(0, len(lengths), max(each, 1)):
            own = lengths[i : i + each]
            n = sum(own)
            out.append((text[at : at + n], own, counts[i : i + each]))
            at += n
        return out

    def _build(self) -> None:
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = np.zeros(2 * self.size, np.int64), np.zeros(2 * self.size, np.int64)
        self.chars[self.size : self.size + len(self.leaves)] = [len(x) for x, _, _ in self.leaves]
        self.tokens[self.size : self.size + len(self.leaves)] = [sum(t) for _, _, t in self.leaves]
        for a in (self.chars, self.tokens):
            k = self.size
            while k > 1:
                a[k // 2 : k] = a[k : 2 * k].reshape(-1, 2).sum(1)
                k //= 2

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character (the last for the end), and where the leaf starts."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if place - start >= self.chars[node] and self.chars[node + 1] > 0:
                start += int(self.chars[node])
                node += 1
        return node - self.size, start

    def put(self, first: int, last: int, text: str, lengths: list[int], counts: list[int]) -> None:
        """Replace the pre-tokens of leaves ``first`` to ``last``; leaves that grew too long have all dealt out anew."""
        if len(lengths) > 4 * LEAF * (last - first + 1):
            self.leaves[first : last + 1] = self._dealt(text, lengths, counts, LEAF)
            self._build()
            return
        new = self._dealt(text, lengths, counts, -(-len(lengths) // (last - first + 1)))
        for k in range(first, last + 1):
            old = len(self.leaves[k][0]), sum(self.leaves[k][2])
            self.leaves[k] = new[k - first] if k - first < len(new) else ("", [], [])
            more = len(self.leaves[k][0]) - old[0], sum(self.leaves[k][2]) - old[1]
            node = self.size + k
            while node:
                self.chars[node] += more[0]
                self.tokens[node] += more[1]
                node //= 2

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    @property
    def pieces(self) -> int:
        return sum(len(x) for _, x, _ in self.leaves)

    @property
    def text(self) -> str:
        return "".join(x for x, _, _ in self.leaves)

    def pack(self) -> bytes:
        """Characters and tokens of all pre-tokens; sums are cheap to make again."""
        both = np.array([[x for _, own, _ in self.leaves for x in own], [x for _, _, own in self.leaves for x in own]], np.uint32)
        return zstandard.ZstdCompressor(level=1).compress(both.tobytes())

    @staticmethod
    def unpack(text: str, data: bytes) -> Tree:
        lengths, counts = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint32).reshape(2, -1).tolist()
        return Tree(text, lengths, counts)


class Document:
    """A text with its tree; with a stored tree nothing is encoded."""

    def __init__(self, text: str, counter: Counter, stored: bytes | None = None) -> None:
        self.counter = counter
        if stored is not None:
            self.tree = Tree.unpack(text, stored)
            return
        pieces = counter.split.findall(text)
        self.tree = Tree(text, [len(p) for p in pieces], counter.counts(pieces))

    @property
    def text(self) -> str:
        return self.tree.text

    def edit(self, start: int, end: int, replacement: str) -> int:
        """Apply an edit; the number of pre-tokens encoded anew."""
        tree = self.tree
        n = int(tree.chars[1])
        start = min(max(start, 0), n)
        end = min(max(end, start), n)
        shift = len(replacement) - (end - start)
        # the last boundary that the edit can't reach: AHEAD characters before it
        first, leaf_start = tree.find(max(0, start - AHEAD))
        at, keep = leaf_start, 0
        lengths = tree.leaves[first][1]
        while keep < len(lengths) and at + lengths[keep] <= start - AHEAD:
            at += lengths[keep]
            keep += 1
        # the new text from there to the end of a leaf behind the edit, and of more leaves if need be
        upto = tree.find(end)[0]
        last, done, old = first, keep, at  # an old boundary, found leaf by leaf
        place, pieces, synced = 0, [], False
        while not synced:
            whole = upto == len(tree.leaves) - 1
            before = "".join(x for x, _, _ in tree.leaves[first : upto + 1])
            window = before[at - leaf_start : start - leaf_start] + replacement + before[end - leaf_start :]
            for m in self.counter.split.finditer(window, place):
                while old < end or old + shift < at + place:  # an old boundary not before this one
                    if done == len(tree.leaves[last][1]):
                        if last + 1 == len(tree.leaves):
                            break
                        last, done = last + 1, 0
                        continue
                    old += tree.leaves[last][1][done]
                    done += 1
                if old >= end and old + shift == at + place and place >= start - at + len(replacement):
                    synced = True
                    break
                if not whole and m.end() >= len(window) - AHEAD:  # more text could change this match
                    break
                pieces.append(m.group())
                place = m.end()
            else:
                if whole:
                    last, done, synced = len(tree.leaves) - 1, len(tree.leaves[-1][1]), True
            upto = min(len(tree.leaves) - 1, 2 * upto - first + 1)
        head, tail = tree.leaves[first], tree.leaves[last]
        rest = sum(tail[1][:done])
        text = head[0][: at - leaf_start] + "".join(pieces) + tail[0][rest:]
        tree.put(first, last, text, head[1][:keep] + [len(p) for p in pieces] + tail[1][done:], head[2][:keep] + self.counter.counts(pieces) + tail[2][done:])
        return len(pieces)


RESULT = T.StructType([T.StructField(n, T.LongType()) for n in ("n_chars_before", "n_tokens_before", "n_edits", "n_reencoded", "n_pieces", "n_chars_after", "n_tokens_after")])


def _edited(keep: list[str], vocabulary: str, stored: bool, give: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            counter = counter or Counter(vocabulary)
            rows, texts, trees = [], [], []
            saved = batch.column("__tree").to_pylist() if stored else [None] * len(batch)
            for text, tree, edits in zip(batch.column("__text").to_pylist(), saved, batch.column("__edits").to_pylist(), strict=True):
                d = Document(text or "", counter, tree)
                before, pieces = (int(d.tree.chars[1]), d.tree.total), d.tree.pieces
                own = sorted((e["seq"] or 0, e["start"], e["end"], e["replacement"] or "") for e in edits or () if e is not None and e["start"] is not None and e["end"] is not None)
                again = sum(d.edit(*e[1:]) for e in own)
                rows.append((*before, len(own), again, pieces, int(d.tree.chars[1]), d.tree.total))
                if give:
                    texts.append(text if text is None and not own else d.text)
                    trees.append(d.tree.pack())
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(RESULT)
            more = [pa.array(texts, pa.string()), pa.array(trees, pa.binary())] if give else []
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(c, pa.int64()) for c in cols), *more], names=[*keep, *RESULT.names, *(["text", "tree"] if give else [])])

    return run


def _run(docs: DataFrame, edits: Column, keep: list[str], text: str, tree: str | None, give: bool, vocabulary: str) -> DataFrame:
    B.small_batches(docs)
    df = docs.select(*keep, F.col(text).alias("__text"), edits.cast(EDITS).alias("__edits"), *([F.col(tree).alias("__tree")] if tree else []))
    more = [T.StructField("text", T.StringType()), T.StructField("tree", T.BinaryType())] if give else []
    return df.mapInArrow(B.tidy(_edited(keep, vocabulary, tree is not None, give)), T.StructType([*(docs.schema[c] for c in keep), *RESULT.fields, *more]))


def count_edited(docs: DataFrame, edits: Column, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Columns ``keep`` of each row, with its counts before and after ``edits`` (an array column, see EDITS)."""
    return _run(docs, edits, keep, text, None, False, vocabulary)


def with_trees(docs: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Columns ``keep``, text, tree and counts of each row: what ``apply_edits`` goes on from."""
    return _run(docs, F.lit(None), keep, text, None, True, vocabulary)


def apply_edits(stored: DataFrame, edits: Column, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """``stored`` (with text and tree) after ``edits``; only what the edits touch is encoded, no tree is built from its text."""
    return _run(stored, edits, keep, "text", "tree", True, vocabulary)


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """``docs`` with an array column ``edits`` from rows (doc_id, seq, start, end, replacement)."""
    own = edits.groupBy("doc_id").agg(F.collect_list(F.struct("seq", "start", "end", "replacement")).alias("edits"))
    return docs.join(own, "doc_id", "left")


#: What the query edits: long digit or hexadecimal strings and e-mail addresses, which a redaction would replace.
REDACTED = r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\.[A-Za-z.]+|[0-9a-f]{16,}|\+?[0-9][0-9() -]{7,}[0-9]"


def redactions(text: Column, pattern: str = REDACTED, by: str = "[redacted]") -> Column:
    """Edits that replace each match; from the last one to the first, so that places hold."""
    one = lambda x: F.struct((-x["start"]).alias("seq"), x["start"].alias("start"), x["end"].alias("end"), F.lit(by).alias("replacement"))
    return F.transform(places(F.coalesce(text, F.lit("")), pattern), one).cast(EDITS)


def report(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and counts of each document before and after redaction."""
    return count_edited(docs, redactions(F.col("text")), ["doc_id"], vocabulary=vocabulary)
