"""Programs over files that keep arriving: each micro-batch is a bounded flow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.flow import Flow


def read(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    """An unbounded table of the Parquet files in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def each_batch(stream: DataFrame, program: Callable[[Flow], Flow], sink: Callable[[Flow, int], None], checkpoint_dir: str):
    """Run a program over each batch; state between batches is the sink's. Ends when all that is there has been read."""
    return stream.writeStream.option("checkpointLocation", checkpoint_dir).foreachBatch(lambda df, n: sink(program(Flow(df)), n)).trigger(availableNow=True).start()


def running_word_count(stream: DataFrame, text: str) -> DataFrame:
    """word, count over all that has arrived; Spark keeps the counts in its state store."""
    words = stream.select(F.explode(F.split(text, " ")).alias("word")).where("word != ''")
    return words.groupBy("word").agg(F.count("*").alias("count"))
