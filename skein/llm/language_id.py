"""Language identification with string kernels.

The kernel of two texts is the cosine of their presence vectors over blended byte n-grams (lengths 1 to 3 of the lower-cased
UTF-8 text). Nyström landmarks map a text to features, and kernel ridge regression gives one score for each language against
the rest; batches of texts are scored by matrix products.

Training takes at most ``per_language`` rows of each language and ``sample_rows`` in all, of the ``most_languages`` languages with
the most rows; those with the least hashes, whole. Their n-grams are found where the rows are: the driver gets a set of codes
a text (at most 2**24 codes, whatever its length), keeps the ``vocabulary`` most frequent, and its memory depends on these
parameters, not on the input. A very long text is one row of one task, which holds some 20 bytes a byte of it.

Rows that repeat are predicted alike; of equal scores the first language by name wins; an empty
table gives none, and without labelled rows all is unknown. A column of ``docs`` that has the name of a result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from . import _bytes as B

UNKNOWN = "und"
#: Codes: 1-grams from 0, 2-grams from 2**8, 3-grams from 2**16 + 2**8.
SPACE = (1 << 8) + (1 << 16) + (1 << 24)


def grams(text: np.ndarray) -> np.ndarray:
    """The distinct n-grams of a text's bytes, as sorted codes."""
    b = text.astype(np.int32)
    parts = [b]
    if len(b) > 1:
        two = b[:-1] << 8 | b[1:]
        parts.append(two + (1 << 8))
        if len(b) > 2:
            parts.append((two[:-1] << 8 | b[2:]) + (1 << 8) + (1 << 16))
    return np.unique(np.concatenate(parts))


class Model:
    """Vocabulary, landmarks and weights, all small; ``scores`` maps presence rows to languages."""

    def __init__(self, sets: list[np.ndarray], langs: list[str], landmarks: int, least_texts: int, ridge: float, vocabulary: int) -> None:
        self.langs = sorted(set(langs))
        codes, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.int32), np.zeros(0))
        codes, n = (x[n >= min(least_texts, max(1, len(sets) // 4))] for x in (codes, n))
        self.codes = np.sort(codes[np.argsort(-n, kind="stable")[:vocabulary]])
        x = np.zeros((len(sets), len(self.codes)), np.float32)
        for r, s in enumerate(sets):
            x[r, np.flatnonzero(np.isin(self.codes, s, assume_unique=True))] = 1
        x /= np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
        # landmarks: evenly from each language, in the order of the sample
        turn = np.zeros(len(langs), np.int64)
        for lang in self.langs:
            own = [i for i, y in enumerate(langs) if y == lang]
            turn[own] = np.arange(len(own))
        chosen = np.argsort(turn, kind="stable")[:landmarks]
        self.landmarks = np.ascontiguousarray(x[chosen].T)
        inner = (x[chosen] @ x[chosen].T).astype(np.float64)
        values, vectors = np.linalg.eigh(inner) if len(chosen) else (np.zeros(0), np.zeros((0, 0)))
        good = values > 1e-6
        root = vectors[:, good] / np.sqrt(values[good])
        phi = (x @ self.landmarks).astype(np.float64) @ root
        phi1 = np.concatenate([phi, np.ones((len(phi), 1))], 1)
        y = np.array([[1.0 if lang == k else -1.0 for k in self.langs] for lang in langs]).reshape(len(langs), len(self.langs))
        # every language weighs the same
        weight = np.array([1 / langs.count(lang) for lang in langs])
        weight /= weight.sum() or 1
        a = phi1.T @ (phi1 * weight[:, None]) + ridge * np.eye(phi1.shape[1])
        self.weights = np.linalg.solve(a, phi1.T @ (y * weight[:, None])) if self.langs else np.zeros((phi1.shape[1], 0))
        self.weights, self.bias = (root @ self.weights[:-1]).astype(np.float32), self.weights[-1].astype(np.float32)

    def lookup(self) -> np.ndarray:
        """The column of each code, -1 for others."""
        out = np.full(SPACE, -1, np.int16 if len(self.codes) < 1 << 15 else np.int32)
        out[self.codes] = np.arange(len(self.codes))
        return out

    def scores(self, present: np.ndarray) -> np.ndarray:
        norm = np.sqrt(np.maximum(present.sum(1, keepdims=True), 1))
        return (present @ self.landmarks / norm) @ self.weights + self.bias


def _predictor(model, rows: int = 256):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        column = m.lookup()
        for batch in batches:
            buf, at = B.column_bytes(batch.column("__low"))
            letter = batch.column("__letter").to_numpy(zero_copy_only=False)
            langs, scores = np.full(len(batch), UNKNOWN, object), np.zeros(len(batch))
            for a in range(0, len(batch) if m.langs else 0, rows):
                own = np.arange(a, min(len(batch), a + rows))
                own = own[letter[own]]
                if not len(own):
                    continue
                present = np.zeros((len(own), len(m.codes) + 1), np.float32)  # the last column takes the rest
                for r, i in enumerate(own):
                    b = buf[at[i] : at[i + 1]].astype(np.int32)
                    present[r, column[b]] = 1
                    if len(b) > 1:
                        two = b[:-1] << 8 | b[1:]
                        present[r, column[two + (1 << 8)]] = 1
                        if len(b) > 2:
                            present[r, column[(two[:-1] << 8 | b[2:]) + ((1 << 8) + (1 << 16))]] = 1
                s = np.round(m.scores(present[:, :-1]).astype(np.float64), 4)  # beyond that, sums depend on the batch
                best = s.argmax(1)
                p = np.exp(4 * (s - s.max(1, keepdims=True)))
                langs[own], scores[own] = np.array(m.langs, object)[best], p[np.arange(len(own)), best] / p.sum(1)
            keep = [c for c in batch.schema.names if c not in ("__low", "__letter")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "__lang", "__score"])

    return run


def held_out(doc_id):
    """Whether a row takes no part in training: crc32 of doc_id as text, modulo 3, is 1. A null doc_id does take part."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _gram_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, at = B.column_bytes(batch.column("low"))
        sets = [grams(buf[a:b]).astype(np.int32).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), pa.array(sets, pa.binary())], names=["lang", "h", "grams"])


def fit(docs: DataFrame, per_language: int = 250, landmarks: int = 96, least_texts: int = 3, ridge: float = 1e-4, most_languages: int = 256, sample_rows: int = 4000, vocabulary: int = 20_000) -> Model:
    """A model from text and non-null lang of the rows that are not held out."""
    own = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("text", "lang", F.xxhash64(F.col("doc_id").cast("string")).alias("h"))
    # least hashes first, found by number and length of text before any text is sorted
    langs = [r["lang"] for r in own.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()]
    if not langs:
        return Model([], [], landmarks, least_texts, ridge, vocabulary)
    each = max(1, min(per_language, sample_rows // len(langs)))
    few = own.where(F.col("lang").isin(langs)).select("lang", "h").withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= each)
    chosen = few.groupBy("lang").agg(F.max("h").alias("most")).collect()
    most = docs.sparkSession.createDataFrame([(r["lang"], r["most"]) for r in chosen], "lang string, most long")
    B.small_batches(docs)
    rows = own.join(F.broadcast(most), "lang").where(F.col("h") <= F.col("most")).groupBy("lang", "h").agg(F.min("text").alias("text"))
    rows = rows.select("lang", "h", F.lower("text").alias("low")).mapInArrow(B.tidy(_gram_sets), "lang string, h long, grams binary").collect()
    rows.sort(key=lambda r: (r["lang"], r["h"]))
    return Model([np.frombuffer(r["grams"], np.int32) for r in rows], [r["lang"] for r in rows], landmarks, least_texts, ridge, vocabulary)


def predict(docs: DataFrame, model: Model, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and a score from 0 to 1; ``und`` and 0 for null and for text without a letter."""
    B.small_batches(docs)
    shared = B.Shared(docs, model)
    docs = docs.drop(lang, score)
    t = F.col("text")
    df = docs.withColumns({"__low": F.lower(F.coalesce(t, F.lit(""))), "__letter": F.coalesce(t.rlike(r"\p{L}"), F.lit(False))})
    schema = T.StructType([*docs.schema.fields, T.StructField("__lang", T.StringType()), T.StructField("__score", T.DoubleType())])
    return df.mapInArrow(B.tidy(_predictor(shared)), schema).withColumnsRenamed({"__lang": lang, "__score": score})


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row."""
    B.small_batches(docs)
    own = docs.select("doc_id", "text")
    df = own.withColumns({"__low": F.lower(F.coalesce("text", F.lit(""))), "__letter": F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)), "held_out": held_out(F.col("doc_id"))}).drop("text")
    shared = B.Shared(docs, fit(docs))
    out = T.StructType([docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("__lang", T.StringType()), T.StructField("__score", T.DoubleType())])
    return df.select("doc_id", "held_out", "__low", "__letter").mapInArrow(B.tidy(_predictor(shared)), out).toDF("doc_id", "held_out", "lang_pred", "score")
