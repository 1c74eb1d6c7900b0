"""The corpus pipeline: language ID, line dedup, near-dedup, benchmark decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns documents with the columns it was given; the last also adds the
probability with which a document was kept. ``run`` writes every stage as Parquet in the shared folder and reads it again, so
that a stage never recomputes the ones before it; a stage's table is deleted when the next one is written.

For every stage: an empty table gives none; columns that ``documents`` doesn't have stay as they are, whatever their names;
nulls in other columns than text change nothing but what is said below.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import decontaminate, language_id, line_dedup, mixing, near_dedup
from skein.session import delete, ensure_checkpoint_dir

#: A document goes if it has no letters, or if the best language's share of the scores is below this.
LEAST_LANGUAGE_SCORE = 0.5


#: What stages look at; other columns are only carried along.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def sheltered(stage):
    """A stage for which columns of any other names are carried under names that clash with none of its own."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        away = {c: f"other_{i}" for i, c in enumerate(docs.columns) if c not in COLUMNS}
        out = stage(spark, docs.withColumnsRenamed(away), sf_dir)
        new = {c: f"mix_{c}" for c in out.columns if c in docs.columns and c not in COLUMNS}
        return out.withColumnsRenamed(new).withColumnsRenamed({b: a for a, b in away.items()})

    return run


@sheltered
def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters (so null and empty texts) or with no clear language go. Rows that repeat stay or go together."""
    found = language_id.predict(docs, language_id.fit(docs), "__lang_pred", "__lang_score")
    return found.where((F.col("__lang_pred") != language_id.UNKNOWN) & (F.col("__lang_score") >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


@sheltered
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; so do documents that lose their last word by it.

    Rows that repeat whole (doc_id and text) are one document and stay or go together. Null and empty texts have no lines and
    stay. ``n_chars``, if there is one, is that of the new text.
    """
    found = line_dedup.drop_lines(docs)
    left = (F.col("__gone") == 0) | F.col("__new").rlike(r"\S")
    new = {"text": F.when(F.col("__gone") > 0, F.col("__new")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("__gone") > 0, F.length("__new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.where(left).withColumns(new).select(*docs.columns)


@sheltered
def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, the first by doc_id (null first) and text hash; of rows that repeat whole, one.

    Null and empty texts and texts without words are each alone and stay, once.
    """
    return near_dedup.keep_first(docs)


@sheltered
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go; null and empty texts have none and stay. Rows are judged one by one."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@sheltered
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with calibrated probabilities; texts without tokens go. Rows that repeat whole are kept or dropped together.

    ``probability`` is added (``mix_probability`` if there is one).
    """
    return mixing.sample(docs)


STAGES = [
    ("language_id", keep_known_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]

#: Kernels, consistent sampling and raking aren't SQL; the tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    ensure_checkpoint_dir(spark)
    top = f"{spark.sparkContext.getCheckpointDir()}/corpus-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
        if before:
            delete(spark, before)
        before = f"{top}/{name}"
    return docs
