"""Flow and Single: pipelines over DataFrames with scopes.

A ``Flow`` is a DataFrame, the column that tells its scope (none at the top), and key columns for keyed operators. Inside
``apply`` each outer row is a scope of its own: row-wise operators are unchanged, and every operator that needs all its input
works within each scope, by putting the scope's column into its keys. A ``Single`` is at most one row for each scope; an
aggregate that has a value for empty input carries that value, so that scopes without rows get it.

Expressions are Columns or SQL text, which Catalyst optimizes; ``map_arrow`` and its kin take Python functions over Arrow
batches for what can't be said so.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.session import checkpoint

Expr = Column | str
_fresh = itertools.count()


def col(e: Expr) -> Column:
    """An expression from a Column or SQL text."""
    return F.expr(e) if isinstance(e, str) else e


def _truth(e: Expr) -> Column:
    """Null counts as false."""
    return F.coalesce(col(e), F.lit(False))


@dataclass(frozen=True)
class Flow:
    df: DataFrame
    scope: str | None = None
    key: tuple[str, ...] = ()
    #: How many subtasks and loops this flow is inside of.
    level: int = 0

    # -- shape -----------------------------------------------------------------------------------------------

    @property
    def columns(self) -> list[str]:
        """Columns without the scope's."""
        return [c for c in self.df.columns if c != self.scope]

    @property
    def _scopes(self) -> list[str]:
        return [self.scope] if self.scope else []

    def _with(self, df: DataFrame, **changes) -> Flow:
        return replace(self, df=df, **changes)

    def _same_scope(self, other: Flow) -> None:
        if self.scope != other.scope:
            raise ValueError("both flows must be in the same scope")

    # -- rows ------------------------------------------------------------------------------------------------

    def map(self, **exprs: Expr) -> Flow:
        """One row for each row, with just these columns."""
        return self._with(self.df.select(*self._scopes, *(col(e).alias(n) for n, e in exprs.items())), key=())

    def extend(self, **exprs: Expr) -> Flow:
        """One row for each row, with these columns added or replaced."""
        return self._with(self.df.withColumns({n: col(e) for n, e in exprs.items()}))

    def filter(self, condition: Expr) -> Flow:
        return self._with(self.df.where(_truth(condition)))

    def filter_map(self, **exprs: Expr) -> Flow:
        """``map``, without rows whose first expression is null."""
        first = next(iter(exprs))
        return self._with(self.map(**exprs).df.where(F.col(first).isNotNull()), key=())

    def flat_map(self, array: Expr, name: str, keep: Iterable[str] = ()) -> Flow:
        """A row for each element of an array expression, with columns ``keep`` of the row it came from."""
        return self._with(self.df.select(*self._scopes, *keep, F.explode(col(array)).alias(name)), key=())

    def map_arrow(self, func: Callable, schema: str) -> Flow:
        """A Python function over iterators of Arrow batches; lazy, so a later limit stops even an endless one. The schema
        must hold the scope's column if there is one."""
        return self._with(self.df.mapInArrow(func, schema), key=())

    unary = map_arrow

    def stateful(self, make: Callable, schema: str) -> Flow:
        """An operator with state of its own for each scope; at the top for each partition.

        ``make()`` gives an object with ``on_batch(batch)`` and ``on_end()``, which give Arrow batches of ``schema``; the latter
        when the scope's rows are over. If it has ``on_cancel()``, that is called when no more rows are wanted before the end (a worker that is
        killed has no time for it).
        Batches have no scope column. A scope's rows are in one task, one after the other, but never in memory as a whole; a scope
        without rows has no operator.
        """
        scope = self.scope

        def run(batches):
            import pyarrow as pa

            def out(of, mark):
                for b in of or ():
                    yield b if scope is None else pa.RecordBatch.from_arrays([*b.columns, pa.repeat(mark, len(b))], names=[*b.schema.names, scope])

            def runs():
                """Mark and rows of each run of one scope in each batch."""
                for batch in batches:
                    if scope is None:
                        yield None, batch
                        continue
                    marks, rest = batch.column(scope), batch.drop_columns([scope])
                    codes = marks.dictionary_encode().indices.to_numpy()
                    cuts = [0, *((codes[1:] != codes[:-1]).nonzero()[0] + 1), len(batch)] if len(batch) else []
                    for i, j in zip(cuts, cuts[1:]):
                        yield marks[i], rest.slice(i, j - i)

            # at the top a partition has its operator, with rows or without
            now, mark, done = make() if scope is None else None, None, False
            try:
                for m, rows in runs():
                    if scope is not None and (now is None or m != mark):
                        if now is not None:
                            yield from out(now.on_end(), mark)
                        now, mark = make(), m
                    yield from out(now.on_batch(rows), mark)
                if now is not None:
                    yield from out(now.on_end(), mark)
                done = True
            finally:
                if not done and now is not None and hasattr(now, "on_cancel"):
                    now.on_cancel()

        if scope is None:
            return self._with(self.df.mapInArrow(run, schema), key=())
        kind = self.df.schema[scope].dataType.simpleString()
        return self._with(self.df.repartition(scope).sortWithinPartitions(scope).mapInArrow(run, f"{schema}, `{scope}` {kind}"), key=())

    def lookup(self, table: DataFrame, on: str | list[str], how: str = "inner") -> Flow:
        """Each row with the matching rows of a table that belongs to no scope, such as a graph's edges."""
        return self._with(self.df.join(table, on, how).select(*self.df.columns, *(c for c in table.columns if c not in self.df.columns)))

    def copied(self) -> tuple[Flow, Flow]:
        """Two handles of one flow."""
        return self, self

    # -- partitions ------------------------------------------------------------------------------------------

    def repartition(self, route: Expr, workers: int) -> Flow:
        """Rows to worker ``route mod workers``, literally."""
        return self._with(self.df.repartitionById(workers, F.pmod(col(route), F.lit(workers)).cast("int")))

    def broadcast(self, workers: int) -> Flow:
        """Every row once for each worker, with the worker's number as ``worker``. Rows are copied, not joined."""
        return self._with(self.df.withColumn("worker", F.explode(F.sequence(F.lit(0), F.lit(workers - 1)))))

    def aggregate(self) -> Flow:
        """All rows in one partition; in a scope, all rows of the scope."""
        return self._with(self.df.repartition(self.scope) if self.scope else self.df.coalesce(1))

    def key_by(self, **keys: Expr) -> Flow:
        return self._with(self.df.withColumns({n: col(e) for n, e in keys.items()}), key=tuple(keys))

    def partition_by_key(self, workers: int | None = None) -> Flow:
        cols = [*self._scopes, *self.key]
        return self._with(self.df.repartition(workers, *cols) if workers else self.df.repartition(*cols))

    @property
    def partitions(self) -> int:
        return self.df.rdd.getNumPartitions()

    def fold_partition(self, **aggs: Expr) -> Flow:
        """Aggregates of each partition that has rows, as worker, ...; lay the rows out with ``repartition`` first."""
        return self._with(self._numbered().groupBy(*self._scopes, "worker").agg(*(col(e).alias(n) for n, e in aggs.items())), key=())

    reduce_partition = fold_partition

    def fold_partition_from(self, **folds: tuple[Expr, Expr]) -> Flow:
        """name=(initial value, aggregate expression) of each partition that has rows; without any, worker 0's initial values."""
        if self.scope:
            raise ValueError("initial values of partitions are given out at the top only")
        out = self.fold_partition(**{n: F.coalesce(col(a), col(i)) for n, (i, a) in folds.items()}).df
        zero = self.df.sparkSession.range(1).select(F.lit(0).alias("worker"), *(col(i).alias(n) for n, (i, _) in folds.items()))
        return self._with(out.unionByName(zero.join(out.where("worker = 0").select("worker"), "worker", "left_anti")), key=())

    def limit_partition(self, n: int, *order: Expr) -> Flow:
        """At most ``n`` rows of each partition (by ``order``, if given)."""
        if not order and not self.scope:

            def head(batches):
                left = n
                for b in batches:
                    if left <= 0:
                        return
                    yield b.slice(0, min(left, len(b)))
                    left -= min(left, len(b))

            return self._with(self.df.mapInArrow(head, self.df.schema))
        by = [col(o) for o in order] or [F.lit(0)]
        w = Window.partitionBy(*self._scopes, "worker").orderBy(*by)
        return self._with(self._numbered().withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n", "worker"))

    def _numbered(self) -> DataFrame:
        return self.df.withColumn("worker", F.spark_partition_id())

    # -- merging and splitting -------------------------------------------------------------------------------

    def merge(self, other: Flow) -> Flow:
        """All rows of both (UNION ALL); the columns must be the same."""
        self._same_scope(other)
        if [(f.name, f.dataType) for f in self.df.schema] != [(f.name, f.dataType) for f in other.df.schema]:
            raise TypeError(f"can't merge {self.df.schema.simpleString()} with {other.df.schema.simpleString()}")
        return self._with(self.df.unionAll(other.df))

    def merge_isomer(self, other: Flow) -> Flow:
        """Rows of both as either = struct(tag, a, b); those of the left sort before those of the right."""
        self._same_scope(other)
        a, b = (T.df.select(*T.columns).schema for T in (self, other))
        left = F.struct(F.lit(0).alias("tag"), F.struct(*self.columns).alias("a"), F.lit(None).cast(b).alias("b"))
        right = F.struct(F.lit(1).alias("tag"), F.lit(None).cast(a).alias("a"), F.struct(*other.columns).alias("b"))
        return self._with(self.df.select(*self._scopes, left.alias("either")).unionAll(other.df.select(*self._scopes, right.alias("either"))), key=())

    def branch(self, condition: Expr) -> tuple[Flow, Flow]:
        """Rows for which the condition holds, and the others."""
        return self.filter(condition), self._with(self.df.where(~_truth(condition)))

    switch = branch

    def binary(self, other: Flow, func: Callable, schema: str) -> Flow:
        """A Python function over the Arrow tables of both sides, for each scope and key."""
        self._same_scope(other)
        cols = [*self._scopes, *self.key]
        if not cols:
            raise ValueError("binary needs a key or a scope")
        return self._with(self.df.groupBy(*cols).cogroup(other.df.groupBy(*cols)).applyInArrow(func, schema), key=())

    def zip(self, other: Flow, order: Iterable[Expr], other_order: Iterable[Expr]) -> Flow:
        """Rows side by side, by their places in the given orders; the longer side's rest is left out."""
        self._same_scope(other)
        left, right = self._placed(order), other._placed(other_order)
        clash = set(self.columns) & set(other.columns)
        right = right.withColumnsRenamed({c: f"right_{c}" for c in clash})
        return self._with(left.join(right, [*self._scopes, "_place"]).drop("_place"), key=())

    def _placed(self, order: Iterable[Expr]) -> DataFrame:
        """Rows numbered from 0. At the top: sorted by range, numbered in each partition, and shifted by the counts before."""
        order = [col(o) for o in order]
        if self.scope:
            return self.df.withColumn("_place", F.row_number().over(Window.partitionBy(self.scope).orderBy(*order)) - 1)
        ranged = checkpoint(self.df.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_in", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
        sizes = ranged.groupBy("_part").count().orderBy("_part").collect()
        shift = dict(zip((r["_part"] for r in sizes), itertools.accumulate([0, *(r["count"] for r in sizes)]), strict=False))
        if not shift:
            return ranged.drop("_part").withColumnRenamed("_in", "_place")
        before = F.create_map(*(F.lit(x) for kv in shift.items() for x in kv))
        return ranged.withColumn("_place", before[F.col("_part")].cast("long") + F.col("_in")).drop("_part", "_in")

    # -- distinct, order, limit ------------------------------------------------------------------------------

    def dedup(self, *keys: str) -> Flow:
        """One row for each key (of the flow, or the whole row)."""
        keys = keys or self.key
        return self._with(self.df.dropDuplicates([*self._scopes, *(keys or self.columns)]))

    def sort(self, *order: Expr) -> Flow:
        return self._with(self.df.orderBy(*self._scopes, *(col(o) for o in order)))

    sort_by = sort

    def limit(self, n: int) -> Flow:
        """Any ``n`` rows; in a scope, of each."""
        return self._with(self.df.limit(n)) if not self.scope else self.sort_limit(n, F.lit(0))

    def sort_limit(self, n: int, *order: Expr) -> Flow:
        """The first ``n`` rows in the order."""
        order = [col(o) for o in order] or [F.col(c) for c in self.columns]
        if not self.scope:
            return self._with(self.df.orderBy(*order).limit(n))
        w = Window.partitionBy(self.scope).orderBy(*order)
        return self._with(self.df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n"))

    sort_limit_by = sort_limit

    # -- aggregates ------------------------------------------------------------------------------------------

    def _single(self, aggs: dict[str, Column], empty: dict[str, Column] | None) -> Single:
        if self.scope:
            return Single(self.df.groupBy(self.scope).agg(*(a.alias(n) for n, a in aggs.items())), self.scope, empty, self.level)
        df = self.df.agg(*(a.alias(n) for n, a in aggs.items()), F.count("*").alias("_rows"))
        if empty is None:
            df = df.where("_rows > 0")
        else:
            df = df.withColumns({n: F.coalesce(n, e) for n, e in empty.items()})
        return Single(df.drop("_rows"), None, empty, self.level)

    def count(self, name: str = "count") -> Single:
        return self._single({name: F.count("*")}, {name: F.lit(0).cast("long")})

    def any(self, name: str = "any") -> Single:
        """Whether there is a row; at the top only one is looked for."""
        flow = self if self.scope else self._with(self.df.limit(1))
        return flow._single({name: F.count("*") > 0}, {name: F.lit(False)})

    def collect(self, value: Expr, name: str = "values") -> Single:
        """All values in one array, sorted."""
        v = col(value)
        kind = self.df.select(v.alias("v")).schema["v"].dataType.simpleString()
        return self._single({name: F.array_sort(F.collect_list(v))}, {name: F.array().cast(f"array<{kind}>")})

    def fold(self, **folds: tuple[Expr, Expr]) -> Single:
        """name=(initial value, aggregate expression): the initial value is the result for no rows."""
        return self._single({n: col(a) for n, (_, a) in folds.items()}, {n: col(i) for n, (i, _) in folds.items()})

    def fold_with(self, name: str, value: Expr, initial: Expr, step: Callable[[Column, Column], Column], combine: Callable[[Column, Column], Column] | None = None) -> Single:
        """A fold that is no built-in aggregate: ``step`` over the values. It must not depend on their order.

        With ``combine``, which puts two results together, pieces of some thousand rows are folded first, and their
        results then; ``initial`` must be neutral. Without it all values of a scope meet in one task.
        """
        flow, start = self, col(initial)
        if combine is not None:
            piece = self.df.select(*self._scopes, col(value).alias("_v"), F.expr("monotonically_increasing_id() div 8192").alias("_p"))
            folded = piece.groupBy(*self._scopes, "_p").agg(F.aggregate(F.collect_list("_v"), start, step).alias("_v"))
            flow, value, step = self._with(folded, key=()), F.col("_v"), combine
        return flow._single({name: F.aggregate(F.array_sort(F.collect_list(col(value))), start, step)}, {name: start})

    def reduce(self, **aggs: Expr) -> Single:
        """Aggregates that have no value for no rows: then there is no result."""
        return self._single({n: col(a) for n, a in aggs.items()}, None)

    def reduce_with(self, name: str, value: Expr, step: Callable[[Column, Column], Column]) -> Single:
        """A reduce that is no built-in aggregate: ``step`` over two values, from the first one on; none for no rows.

        ``step`` must not depend on the order of values: pieces of some thousand rows are reduced first, and their results then.
        """
        many = lambda: F.array_sort(F.collect_list("_v"))
        over = lambda a: F.reduce(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), F.get(a, F.lit(0)), step)
        piece = self.df.select(*self._scopes, col(value).alias("_v"), F.expr("monotonically_increasing_id() div 8192").alias("_p")).where("_v is not null")
        folded = piece.groupBy(*self._scopes, "_p").agg(over(many()).alias("_v"))
        return self._with(folded, key=())._single({name: over(many())}, None)

    def reduce_by_key(self, **aggs: Expr) -> Flow:
        """Aggregates of each key; partly summed before the shuffle."""
        return self._with(self.df.groupBy(*self._scopes, *self.key).agg(*(col(a).alias(n) for n, a in aggs.items())))

    def fold_by_key(self, **folds: tuple[Expr, Expr]) -> Flow:
        return self.reduce_by_key(**{n: F.coalesce(col(a), col(i)) for n, (i, a) in folds.items()})

    # -- joins -----------------------------------------------------------------------------------------------

    def _join(self, other: Flow, how: str) -> Flow:
        """By key; null keys match. Columns of the right side that the left has, too, are prefixed ``right_``."""
        self._same_scope(other)
        if not self.key or len(self.key) != len(other.key):
            raise ValueError("both sides need key_by with as many keys")
        clash = (set(self.df.columns) & set(other.df.columns)) | {self.scope}
        right = other.df.select(*(F.col(c).alias(f"right_{c}" if c in clash else c) for c in other.df.columns))
        named = lambda c: f"right_{c}" if c in clash else c
        on = F.lit(True)
        for a, b in zip([*self._scopes, *self.key], [*other._scopes, *other.key], strict=True):
            on = on & F.col(a).eqNullSafe(F.col(named(b)))
        df = self.df.join(right, on, how)
        if self.scope and how not in ("left_semi", "left_anti"):
            df = df.withColumn(self.scope, F.coalesce(self.scope, named(self.scope))).drop(named(self.scope))
        return self._with(df)

    def inner_join(self, other: Flow) -> Flow:
        return self._join(other, "inner")

    def left_outer_join(self, other: Flow) -> Flow:
        return self._join(other, "left")

    def right_outer_join(self, other: Flow) -> Flow:
        return self._join(other, "right")

    def full_outer_join(self, other: Flow) -> Flow:
        return self._join(other, "full")

    def semi_join(self, other: Flow) -> Flow:
        return self._join(other, "left_semi")

    def anti_join(self, other: Flow) -> Flow:
        return self._join(other, "left_anti")

    # -- scopes ----------------------------------------------------------------------------------------------

    def apply(self, body: Callable[[Flow], Single], unique: str | None = None, in_flight: int = 64) -> Flow:
        """For each row the value of a subtask over it, joined to the row; rows whose subtask has no value go.

        ``unique`` names a column without repeats; without it rows are numbered, and written so that both uses see the same
        numbers. Equal rows are different subtasks. ``in_flight`` has no meaning here: all subtasks run as one set.
        """
        scope = f"_s{next(_fresh)}"
        if unique:
            outer = self.df.withColumn(scope, F.col(unique))
        else:
            outer = checkpoint(self.df.withColumn(scope, F.monotonically_increasing_id()))
        inner = outer.drop(self.scope) if self.scope else outer
        out = body(Flow(inner, scope, level=self.level + 1))
        if not isinstance(out, Single):
            raise TypeError("the body of apply must end in at most one value for each row (a Single)")
        if out.scope != scope:
            raise ValueError("the body's result isn't of this subtask")
        clash = [c for c in out.columns if c in self.df.columns]
        if clash:
            raise ValueError(f"the subtask's result and the row both have {clash}")
        df = outer.join(out.df, scope, "inner" if out.empty is None else "left")
        if out.empty:
            df = df.withColumns({n: F.coalesce(n, e) for n, e in out.empty.items()})
        return self._with(df.drop(scope))

    def apply_parallel(self, in_flight: int, body: Callable[[Flow], Single], unique: str | None = None) -> Flow:
        return self.apply(body, unique, in_flight)

    def segment_apply(self, body: Callable[[Flow], Single]) -> Flow:
        """A subtask for each key, over the rows that have it: key columns and value. Null is a key."""
        scope = f"_s{next(_fresh)}"
        tagged = self.df.withColumn(scope, F.struct(*self._scopes, *self.key))
        out = body(Flow(tagged.drop(*self._scopes), scope, level=self.level + 1))
        if not isinstance(out, Single) or out.scope != scope:
            raise TypeError("the body of segment_apply must end in a Single of its scope")
        keys = tagged.select(scope).distinct()
        same = F.col(f"k.{scope}") == F.col(f"v.{scope}")
        df = keys.alias("k").join(out.df.alias("v"), same, "inner" if out.empty is None else "left").select(f"k.{scope}", *(F.col(f"v.{c}") for c in out.columns))
        if out.empty:
            df = df.withColumns({n: F.coalesce(n, e) for n, e in out.empty.items()})
        return self._with(df.select(*(F.col(f"{scope}.{c}") for c in [*self._scopes, *self.key]), *out.columns))

    # -- loops -----------------------------------------------------------------------------------------------

    def iterate(self, rounds: int, body: Callable[[Flow], Flow], every: int = 5) -> Flow:
        """``rounds`` rounds of the body, planned as a whole; written every few rounds to keep the plan short."""
        from skein.plans.loops import EmitKind, IterCondition, run_loop

        return run_loop(self, IterCondition(rounds), EmitKind.LAST, body, every)

    def iterate_until(self, condition, body: Callable[[Flow], Flow], every: int = 5) -> Flow:
        """Rows leave as soon as they meet the condition, also before the first round; all do after the last."""
        from skein.plans.loops import EmitKind, run_loop

        return run_loop(self, condition, EmitKind.LAST, body, every)

    def iterate_emit_until(self, condition, kind, body: Callable[[Flow], Flow], every: int = 5) -> Flow:
        """As ``iterate_until``; rows that stay are given out after each round, too, or also before the first."""
        from skein.plans.loops import run_loop

        return run_loop(self, condition, kind, body, every)

    # -- sinks -----------------------------------------------------------------------------------------------

    def sink_into(self, collector: Callable | list) -> None:
        """Give every row to a function or list, a partition at a time."""
        take = collector.append if isinstance(collector, list) else collector
        for row in self.df.toLocalIterator():
            take(row)

    def write(self, path: str, mode: str = "errorifexists") -> None:
        self.df.write.mode(mode).parquet(path)

    def explain(self, mode: str = "formatted") -> None:
        self.df.explain(mode)


@dataclass(frozen=True)
class Single:
    """At most one row for each scope. ``empty`` has the values of a scope without a row; None: such a scope has no value."""

    df: DataFrame
    scope: str | None = None
    empty: dict[str, Column] | None = field(default=None)
    level: int = 0

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != self.scope]

    def map(self, **exprs: Expr) -> Single:
        """New columns from the value, also from that of empty scopes."""
        empty = self.empty
        if empty is not None:
            spark = self.df.sparkSession
            kinds = {f.name: f.dataType for f in self.df.schema}
            base = spark.range(1).select(*(e.cast(kinds[n]).alias(n) for n, e in empty.items()))
            row = base.select(*(col(e).alias(n) for n, e in exprs.items())).schema
            values = base.select(*(col(e).alias(n) for n, e in exprs.items())).first()
            empty = {n: F.lit(values[n]).cast(row[n].dataType) for n in exprs}
        scopes = [self.scope] if self.scope else []
        return Single(self.df.select(*scopes, *(col(e).alias(n) for n, e in exprs.items())), self.scope, empty, self.level)

    def unfold(self, array: Expr, name: str) -> Flow:
        """A row for each element of an array expression."""
        scopes = [self.scope] if self.scope else []
        return Flow(self.df.select(*scopes, F.explode(col(array)).alias(name)), self.scope, level=self.level)

    def into_flow(self) -> Flow:
        return Flow(self.df, self.scope, level=self.level)

    def value(self):
        """The value on the driver: a Row, or None."""
        return self.df.first()

    sink = value
