"""Sources: rows, ranges, text, delimited files, edge lists, Parquet."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from skein.operators.flow import Flow


def input_from(spark: SparkSession, rows: Iterable, schema: str, replicas: int = 1) -> Flow:
    """Rows of the driver; ``replicas`` copies of each, as if so many workers read the same source."""
    own = [r if isinstance(r, (tuple, list, dict)) else (r,) for r in rows]
    df = spark.createDataFrame(own, schema)
    return Flow(df if replicas == 1 else df.withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(replicas)))).drop("_r"))


def input_range(spark: SparkSession, start: int, end: int, name: str = "x", replicas: int = 1) -> Flow:
    """Whole numbers, made where they are used."""
    df = spark.range(start, end).withColumnRenamed("id", name)
    return Flow(df if replicas == 1 else df.select(F.explode(F.array_repeat(name, replicas)).alias(name)))


def own_source(spark: SparkSession, name: str, schema: str, parts: Sequence, rows: Callable[[object], Iterable[tuple]]) -> Flow:
    """A source of one's own: ``rows(part)`` is run in a task for each of ``parts`` and gives tuples of ``schema``.

    It is registered as data source ``name``, so ``spark.read.format(name).load()`` and SQL have it, too. A part must give
    the same rows whenever it is read: a lost task reads it again.
    """

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [InputPartition(p) for p in parts]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            yield from rows(partition.value)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            return Reader()

    if not parts:
        return Flow(spark.createDataFrame([], schema))
    spark.dataSource.register(Source)
    return Flow(spark.read.format(name).load())


def worker_index() -> Column:
    """The number of the partition that a row is in."""
    return F.spark_partition_id()


def parquet(spark: SparkSession, path: str) -> Flow:
    return Flow(spark.read.parquet(path))


def text_lines(spark: SparkSession, path: str) -> Flow:
    """line"""
    return Flow(spark.read.text(path).withColumnRenamed("value", "line"))


def delimited(spark: SparkSession, path: str, schema: str, separator: str = ",", header: bool = True) -> Flow:
    return Flow(spark.read.schema(schema).option("sep", separator).option("header", header).csv(path))


def encode_edges(spark: SparkSession, path: str, out: str, separator: str = " ", skip_header: bool = False, src_index: int = 0, dst_indexes: Iterable[int] = (1,), partition: tuple[int, int] | None = None) -> None:
    """Write (src, dst) rows of a delimited edge list as Parquet; a line may have several targets, and repeated edges stay.

    ``partition`` = (p, n) keeps sources with src mod n = p. With ``skip_header`` the first line of each file goes; any other
    line whose source or targets are no whole numbers is an error. Blank lines are passed over.
    """
    parts = F.split("value", rf"\Q{separator}\E")
    at = lambda i: F.get(parts, F.lit(i)).cast("long")
    if skip_header:
        lines = spark.read.schema("value string").option("header", True).option("enforceSchema", True).option("sep", "\u0001").option("quote", "").csv(path)
    else:
        lines = spark.read.text(path)
    lines = lines.where("trim(value) != ''")
    bad = F.raise_error(F.concat(F.lit("no edge: "), F.col("value")))
    lines = lines.withColumn("value", F.when(F.get(parts, F.lit(src_index)).try_cast("long").isNull() | F.exists(F.array(*(F.get(parts, F.lit(i)).try_cast("long") for i in dst_indexes)), lambda x: x.isNull()), bad).otherwise(F.col("value")))
    edges = lines.select(at(src_index).alias("src"), F.explode(F.array(*(at(i) for i in dst_indexes))).alias("dst"))
    if partition:
        edges = edges.where(F.pmod("src", F.lit(partition[1])) == partition[0])
    edges.write.parquet(out)


def load_edges(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) as ``encode_edges`` wrote them."""
    return spark.read.parquet(path)


def partition_edges(edges: DataFrame, parts: int) -> DataFrame:
    """All edges of a source in one of ``parts`` partitions."""
    return edges.repartition(parts, "src")


def properties(spark: SparkSession, path: str, ids: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Properties of the vertices asked for; only these columns are read."""
    return spark.read.parquet(path).select("id", *columns).join(ids.select("id").distinct(), "id", "left_semi")
