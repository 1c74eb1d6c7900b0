"""Jobs: configuration, a registry of programs by name, and results that arrive one by one."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession

from skein.operators.flow import Flow, Single


@dataclass
class JobConf:
    """``workers``: partitions of shuffles; ``resources``: tables or values that the program asks for by name."""

    name: str = "job"
    workers: int | None = None
    batch_size: int | None = None
    plan_print: bool = False
    resources: dict[str, object] = field(default_factory=dict)

    def use(self, spark: SparkSession) -> None:
        if self.workers:
            spark.conf.set("spark.sql.shuffle.partitions", self.workers)
        if self.batch_size:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", self.batch_size)

    def in_tasks(self, spark: SparkSession, name: str, most_bytes: int = 64 << 20):
        """A resource for functions that run in tasks, as ``.value``: each executor gets one copy of it, not to be changed.

        It must be a value of at most ``most_bytes`` when pickled; larger ones are tables, to be joined.
        """
        value = self.resources[name]
        if isinstance(value, (DataFrame, Flow, Single)):
            raise TypeError(f"{name} is a table: join it")
        if (size := len(cloudpickle.dumps(value))) > most_bytes:
            raise ValueError(f"{name} takes {size} bytes, over {most_bytes}: make it a table and join it")
        return spark.sparkContext.broadcast(value)


class ResultStream:
    """Rows as they arrive. A failure is raised once, or given to ``on_error``; after it, or after ``cancel``, the stream stays ended."""

    def __init__(self, df: DataFrame, conf: JobConf, on_error: Callable[[Exception], None] | None = None) -> None:
        self.on_error = on_error
        self.tag = f"{conf.name}-{uuid.uuid4().hex}"
        self.poisoned = False
        self._df, self._rows = df, None

    def __iter__(self) -> Iterator[Row]:
        return self

    def __next__(self) -> Row:
        if self.poisoned:
            raise StopIteration
        sc = self._df.sparkSession.sparkContext
        sc.addJobTag(self.tag)
        try:
            if self._rows is None:
                self._rows = self._df.toLocalIterator()
            return next(self._rows)
        except StopIteration:
            self.poisoned = True
            raise
        except Exception as e:
            cancelled, self.poisoned = self.poisoned, True
            if cancelled:
                raise StopIteration from None
            if self.on_error is None:
                raise
            self.on_error(e)
            raise StopIteration from None
        finally:
            sc.removeJobTag(self.tag)

    def try_next(self) -> Row | None:
        return next(self, None)

    def cancel(self) -> None:
        """Stop the job's tasks; no more rows come."""
        self.poisoned = True
        self._df.sparkSession.sparkContext.cancelJobsWithTag(self.tag)


Program = Callable[[SparkSession, JobConf], Flow | Single | DataFrame]


def run(spark: SparkSession, program: Program, conf: JobConf | None = None, on_error: Callable[[Exception], None] | None = None) -> ResultStream:
    """Build a program's plan and give its result."""
    conf = conf or JobConf()
    conf.use(spark)
    out = program(spark, conf)
    df = out if isinstance(out, DataFrame) else out.df
    if conf.plan_print:
        df.explain("formatted")
    return ResultStream(df, conf, on_error)


class Registry:
    """Programs by name, for callers that send a name and arguments."""

    def __init__(self) -> None:
        self._programs: dict[str, Callable[..., Flow | Single | DataFrame]] = {}

    def register(self, name: str) -> Callable:
        def keep(f: Callable) -> Callable:
            if name in self._programs:
                raise ValueError(f"{name} is registered already")
            self._programs[name] = f
            return f

        return keep

    def submit(self, spark: SparkSession, name: str, conf: JobConf | None = None, **arguments) -> ResultStream:
        program = self._programs[name]
        return run(spark, lambda s, c: program(s, c, **arguments), conf)
