"""Operators on small fixed inputs."""

import itertools
import time

import pyarrow as pa
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from skein import functions, job, sources, streaming
from skein.operators import graph
from skein.operators.flow import Flow
from skein.plans import EmitKind, IterCondition, algorithms
from skein.sources import input_from, input_range


def order(v):
    """Nulls last, also within rows."""
    return tuple(map(order, v)) if isinstance(v, tuple) else (v is None, v)


def values(flow, *cols):
    rows = [tuple(r) for r in flow.df.select(*(cols or flow.columns)).collect()]
    return sorted((r[0] if len(r) == 1 else r for r in rows), key=order)


def ints(spark, *xs, name="x"):
    return input_from(spark, xs, f"{name} long")


@pytest.mark.parametrize("workers", [1, 2, 4])
def test_unary_on_every_worker(spark, workers):
    out = input_range(spark, 0, 256, replicas=workers).repartition("x", workers).map(x="x + 1")
    assert values(out) == sorted(list(range(1, 257)) * workers)


def test_rows(spark):
    assert input_range(spark, 0, 2000).branch("x >= 555")[0].count().value()[0] == 1445
    assert input_range(spark, 0, 2000).branch("x >= 555")[1].count().value()[0] == 555
    assert input_range(spark, 1, 1000).flat_map("sequence(0, x - 1)", "y").count().value()[0] == 499_500
    assert input_range(spark, 0, 200).flat_map("sequence(0, x)", "y").flat_map("sequence(0, y - 1)", "z").filter("z >= 0 and y > 0").count().value()[0] > 0
    assert values(ints(spark, 0, 1, 2).merge(ints(spark, 0, 1, 2))) == [0, 0, 1, 1, 2, 2]
    assert input_range(spark, 0, 1000).merge(input_range(spark, 1000, 2000)).count().value()[0] == 2000
    assert values(ints(spark, 3, None, 5).filter("x > 3")) == [5]
    assert values(ints(spark, 1, 2, 3, 4).filter_map(y="case when x % 2 = 0 then x * x end")) == [4, 16]


def test_branches_hold_every_row(spark):
    left, right = ints(spark, 1, None, 3).switch("x > 1")
    assert values(left) == [3] and values(right) == [1, None]


def test_dedup(spark):
    out = input_range(spark, 0, 1000, replicas=2).map(x="x + 1").dedup().flat_map("array_repeat(x, 2)", "x")
    assert out.count().value()[0] == 2000
    assert input_from(spark, [(1, "a"), (1, "b"), (2, "c")], "k int, v string").key_by(k="k").dedup().count().value()[0] == 2


def test_merge_of_different_types_is_refused(spark):
    with pytest.raises(TypeError):
        ints(spark, 1).merge(input_from(spark, ["a"], "x string"))


def test_tagged_union_sorts_left_first(spark):
    out = ints(spark, 9).merge_isomer(input_from(spark, ["a"], "s string")).sort("either")
    tag, a, b = functions.either()
    assert [tuple(r) for r in out.df.select(tag, a["x"], b["s"]).collect()] == [(0, 9, None), (1, None, "a")]


def test_zip(spark):
    out = ints(spark, 3, 1, 2).zip(input_from(spark, ["c", "b", "a", "d"], "s string"), ["x"], ["s"])
    assert values(out, "x", "s") == [(1, "a"), (2, "b"), (3, "c")]
    assert ints(spark).zip(ints(spark, 1, name="y"), ["x"], ["y"]).count().value()[0] == 0


@pytest.mark.parametrize("workers", [1, 2, 4])
def test_partition_local(spark, workers):
    own = input_range(spark, 1, 10).repartition("x", workers)
    want = sorted(sum(x for x in range(1, 10) if x % workers == w) for w in range(workers))
    assert values(own.fold_partition(s="sum(x)"), "s") == want
    assert own.limit_partition(1, "x").count().value()[0] == workers
    assert own.limit_partition(1).count().value()[0] == workers
    assert input_range(spark, 0, 5).broadcast(workers).count().value()[0] == 5 * workers
    assert own.aggregate().partitions == 1


def test_aggregates(spark):
    none = ints(spark, 1).filter("x > 5")
    assert none.count().value()[0] == 0 and none.collect("x").value()[0] == [] and none.any().value()[0] is False
    assert none.fold(s=("7L", "sum(x)")).value()[0] == 7 and none.reduce(s="sum(x)").value() is None
    assert input_range(spark, 1, 10).fold(s=("0L", "sum(x)")).value()[0] == 45
    assert input_range(spark, 1, 5).fold_with("p", "x", "1L", lambda a, x: a * x).value()[0] == 24
    plus = lambda a, x: a + x
    assert input_range(spark, 0, 30_000).fold_with("s", "x", "0L", plus, plus).value()[0] == 29_999 * 15_000
    assert none.fold_with("s", "x", "0L", plus, plus).value()[0] == 0
    groups = input_range(spark, 0, 2000).key_by(k="x % 4").reduce_by_key(n="count(*)")
    assert values(groups, "k", "n") == [(k, 500) for k in range(4)]
    assert input_range(spark, 0, 8000).collect("x").value()[0] == list(range(8000))
    assert values(input_range(spark, 0, 4).collect("x").map(v="transform(values, v -> v + 1)").unfold("v", "x")) == [1, 2, 3, 4]


def joined(spark):
    left = input_from(spark, [(x, x) for x in (1, 2, 3, 4, 8, 9)], "k long, v long").key_by(k="k")
    right = input_from(spark, [(x + 1, x + 1) for x in (1, 2, 3, 4, 8, 9)], "k long, v long").key_by(k="k")
    return left, right


def test_joins(spark):
    left, right = joined(spark)
    assert values(left.inner_join(right), "k") == [2, 3, 4, 9]
    assert values(left.semi_join(right), "k") == [2, 3, 4, 9]
    assert values(left.anti_join(right), "k") == [1, 8]
    assert values(left.left_outer_join(right), "k", "right_k") == sorted([(x, x) for x in (2, 3, 4, 9)] + [(1, None), (8, None)], key=order)
    assert values(left.right_outer_join(right), "k", "right_k") == sorted([(x, x) for x in (2, 3, 4, 9)] + [(None, 5), (None, 10)], key=order)
    assert values(left.full_outer_join(right), "k", "right_k") == sorted([(x, x) for x in (2, 3, 4, 9)] + [(1, None), (8, None), (None, 5), (None, 10)], key=order)
    assert left.inner_join(Flow(right.df.limit(0), key=("k",))).collect("k").value()[0] == []


def test_joins_with_null_and_repeated_keys(spark):
    left = input_from(spark, [(None, 1), (None, 2), (7, 3)], "k int, a int").key_by(k="k")
    right = input_from(spark, [(None, 4), (7, 5), (7, 6)], "k int, b int").key_by(k="k")
    assert values(left.inner_join(right), "a", "b") == [(1, 4), (2, 4), (3, 5), (3, 6)]
    assert left.anti_join(right).count().value()[0] == 0
    with pytest.raises(ValueError):
        left.inner_join(Flow(right.df))


def test_joins_in_a_subtask(spark):
    def sides(f):
        own = f.flat_map("sequence(10 * x, 11 * x - 1)", "k")
        return own.key_by(k="k"), own.map(k="k + 1").key_by(k="k")

    def full(f):
        left, right = sides(f)
        return left.full_outer_join(right).count("n")

    def semi(f):
        left, right = sides(f)
        return left.semi_join(right).count("n")

    assert values(input_range(spark, 1, 5).apply(full)) == [(1, 2), (2, 3), (3, 4), (4, 5)]
    assert values(input_range(spark, 1, 5).apply(semi)) == [(1, 0), (2, 1), (3, 2), (4, 3)]


def test_order(spark):
    xs = input_range(spark, 1, 2000)
    assert [r[0] for r in xs.sort_limit(3, "x").df.collect()] == [1, 2, 3]
    assert [r[0] for r in xs.sort_limit_by(2, F.desc("x")).df.collect()] == [1999, 1998]
    assert input_range(spark, 1, 5).sort_limit(10, "x").count().value()[0] == 4
    assert xs.sort_limit(0, "x").count().value()[0] == 0
    top = input_range(spark, 0, 5).sort_limit_by(3, F.desc("x")).apply(lambda f: f.flat_map("case when x > 0 then sequence(0, x - 1) else array() end", "y").sort_limit(3, "y").collect("y"))
    assert values(top) == [(2, [0, 1]), (3, [0, 1, 2]), (4, [0, 1, 2])]


def test_early_stop(spark):
    endless = functions.flat_map_rows(lambda r: ({"x": i} for i in itertools.count()), pa.schema([("x", pa.int64())]))
    xs = ints(spark, 1, 2).map_arrow(endless, "x long")
    assert xs.limit(10).count().value()[0] == 10
    assert xs.any().value()[0] is True
    assert xs.limit(10).merge(xs.limit(100)).count().value()[0] == 110


def test_subtasks(spark):
    counts = input_range(spark, 0, 1000).apply(lambda f: f.flat_map("sequence(0, x)", "y").count("n"))
    assert values(counts) == [(x, x + 1) for x in range(1000)]
    even = input_range(spark, 0, 100).apply(lambda f: f.filter("x % 2 = 0").flat_map("array(x, x)", "y").collect("y", "ys"))
    assert even.filter("size(ys) = 2").count().value()[0] == 50 and even.filter("size(ys) = 0").count().value()[0] == 50
    some = input_range(spark, 0, 10).apply(lambda f: f.filter("x > 4").reduce(m="max(x)"))
    assert values(some, "x") == [5, 6, 7, 8, 9]
    assert values(ints(spark, 100, 100).apply(lambda f: f.flat_map("sequence(0, x - 1)", "y").reduce(s="sum(y)")), "s") == [4950, 4950]
    nested = input_range(spark, 1, 4).apply(lambda f: f.flat_map("sequence(1, x)", "y").apply(lambda g: g.flat_map("sequence(1, y)", "z").count("m")).fold(s=("0L", "sum(m)")))
    assert values(nested) == [(1, 1), (2, 3), (3, 6)]
    mapped = input_range(spark, 0, 3).apply(lambda f: f.filter("x > 0").count("n").map(m="n + 10"))
    assert values(mapped) == [(0, 10), (1, 11), (2, 11)]


def test_subtasks_that_are_wrong(spark):
    with pytest.raises(TypeError):
        ints(spark, 1).apply(lambda f: f)
    with pytest.raises(ValueError):
        ints(spark, 1).apply(lambda f: f.count("x"))
    with pytest.raises(ValueError):
        other = ints(spark, 1)
        ints(spark, 1).apply(lambda f: f.merge(other).count("n"))


def test_segments(spark):
    own = input_from(spark, [(1, 5), (1, 6), (None, 7)], "k int, v int").key_by(k="k")
    assert values(own.segment_apply(lambda f: f.fold(s=("0L", "sum(v)")))) == sorted([(1, 11), (None, 7)], key=order)


def test_loops(spark):
    xs = input_range(spark, 0, 20)
    step = lambda f: f.map(x="x + 2")
    assert values(xs.iterate(3, step)) == list(range(6, 26))
    after = xs.iterate_emit_until(IterCondition(3), EmitKind.AFTER, step)
    assert values(after) == sorted(x + 2 * k for k in (1, 2, 3) for x in range(20))
    before = xs.iterate_emit_until(IterCondition(3), EmitKind.BEFORE, step)
    assert values(before) == sorted(x + 2 * k for k in (0, 1, 2, 3) for x in range(20))
    assert values(ints(spark, 0).iterate(10, lambda f: f.iterate(10, lambda g: g.map(x="x + 1")))) == [100]
    assert values(ints(spark).iterate_emit_until(IterCondition(3), EmitKind.BEFORE, step)) == []


def test_loops_with_a_condition(spark):
    collatz = lambda f: f.map(x="case when x % 2 = 0 then x div 2 else 3 * x + 1 end")
    assert values(ints(spark, 10, 100).iterate_until(IterCondition(None, "x = 1"), collatz)) == [1, 1]
    out = input_range(spark, 0, 50).map(x="x", n="0").iterate_until(IterCondition(100, "n >= 10"), lambda f: f.map(x="x + 1", n="n + 1"))
    assert values(out) == [(x + 10, 10) for x in range(50)]
    # what meets the condition before the first round isn't touched; what never does leaves after the last
    assert values(ints(spark, 1, 2).iterate_until(IterCondition(2, "x = 1"), lambda f: f.map(x="x + 5"))) == [1, 12]
    with pytest.raises(ValueError):
        IterCondition(0)


def test_loops_and_subtasks(spark):
    count = lambda f: f.apply(lambda g: g.flat_map("sequence(1, x)", "y").count("n")).map(x="n + 1")
    assert values(ints(spark, 1, 2, 3).iterate(10, count)) == [11, 12, 13]
    double = lambda g: Flow(g.df.select(g.scope, F.explode(F.array("x", F.col("x") + 1)).alias("x")), g.scope)
    assert values(ints(spark, 5, 6).apply(lambda f: f.iterate(10, double).count("n")), "n") == [1024, 1024]
    # state of a blocking operator is a round's: the limit holds in each
    assert input_range(spark, 0, 50).iterate(2, lambda f: f.limit(10)).count().value()[0] == 10


OUT = {1: [2, 3, 4], 4: [3, 5], 6: [3]}


def test_toy_graph(spark):
    edges = spark.createDataFrame([(a, b) for a, bs in OUT.items() for b in bs], "src long, dst long")
    five = spark.createDataFrame([(5,)], "id long")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    four = graph.neighbors(back, five).select(F.col("neighbor").alias("id"))
    up = graph.neighbors(edges, four).select(F.col("neighbor").alias("id")).where("id = 5")
    assert [r["neighbor"] for r in graph.neighbors(back, up).collect()] == [4]
    assert sorted(r["neighbor"] for r in graph.k_hop(edges, spark.createDataFrame([(1,)], "id long"), 2).collect()) == [3, 5]
    assert graph.k_hop(edges, five, 0).count() == 0
    assert tuple(graph.totals(edges).first()) == (6, 6)
    counts = graph.k_hop_counts(edges, spark.createDataFrame([(1,), (5,)], "id long"), 2)
    assert sorted(map(tuple, counts.collect())) == [(1, 2), (5, 0)]
    dist = {r["id"]: r["dist"] for r in algorithms.bfs(edges, spark.createDataFrame([(1,)], "id long"), 5).collect()}
    assert dist == {1: 0, 2: 1, 3: 1, 4: 1, 5: 2}


def test_labels_both_ways(spark):
    t = graph.labeled(spark.createDataFrame([(1, 2)], "src long, dst long"), "p", "likes", "q")
    start = spark.createDataFrame([("q", 2), ("z", 9)], "label string, id long")
    assert [tuple(r) for r in graph.labeled_neighbors(t, start, graph.Direction.IN).select("neighbor_label", "neighbor").collect()] == [("p", 1)]
    assert graph.labeled_neighbors(t, start, graph.Direction.OUT).count() == 0
    assert sorted(map(tuple, graph.count_all_edges(t, start).collect())) == [("q", 2, 1), ("z", 9, 0)]


def test_pagerank(spark):
    edges = [(1, 2), (1, 3), (2, 3), (3, 1), (4, 1), (4, 1)]
    ranks = dict.fromkeys((1, 2, 3, 4), 0.25)
    deltas = []
    for _ in range(4):
        got = {}
        for a, b in edges:
            got[b] = got.get(b, 0) + ranks[a] / sum(x == a for x, _ in edges)
        new = {v: 0.85 * got[v] + 0.15 / 4 if v in got else r for v, r in ranks.items()}
        deltas.append(sum(abs(new[v] - ranks[v]) for v in new))
        ranks = new
    df, seen = algorithms.pagerank(spark.createDataFrame(edges, "src long, dst long"), 4, least_delta=0.0)
    assert {r["id"]: pytest.approx(r["rank"]) for r in df.collect()} == ranks and seen == pytest.approx(deltas)


def test_logistic_regression(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x, y = rng.random((50, 2)), rng.integers(0, 2, 50)
    w, g = np.ones(3), np.zeros(3)
    one = np.concatenate([np.ones((50, 1)), x], 1)
    for _ in range(6):
        w -= g / 10
        g = ((1 / (1 + np.exp(-one @ w)) - y)[:, None] * one).sum(0)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double")
    weights, last = algorithms.logistic_regression(df, ["a", "b"], "y", 6)
    assert weights == pytest.approx(list(w)) and last == pytest.approx(list(g))


def test_word_count(spark):
    lines = input_from(spark, ["This is a simple test", "This is a wonderful world"], "line string")
    assert dict(values(algorithms.word_count(lines))) == {"This": 2, "is": 2, "a": 2, "simple": 1, "test": 1, "wonderful": 1, "world": 1}


def test_files(spark, tmp_path):
    (tmp_path / "g.txt").write_text("src dst a b\n1 2 3 4\n1 2 9 9\n5 6 7 8\n")
    sources.encode_edges(spark, str(tmp_path / "g.txt"), str(tmp_path / "g"), skip_header=True, dst_indexes=(1, 2))
    assert sorted(map(tuple, sources.load_edges(spark, str(tmp_path / "g")).collect())) == [(1, 2), (1, 2), (1, 3), (1, 9), (5, 6), (5, 7)]
    sources.encode_edges(spark, str(tmp_path / "g.txt"), str(tmp_path / "h"), skip_header=True, partition=(2, 3))
    assert sorted(map(tuple, sources.load_edges(spark, str(tmp_path / "h")).collect())) == [(5, 6)]
    (tmp_path / "x.csv").write_text("a,b\n1,2.5\n")
    assert values(sources.delimited(spark, str(tmp_path / "x.csv"), "a int, b double")) == [(1, 2.5)]
    (tmp_path / "t.txt").write_text("one two\ntwo\n")
    assert dict(values(algorithms.word_count(sources.text_lines(spark, str(tmp_path / "t.txt"))))) == {"one": 1, "two": 2}
    input_range(spark, 0, 3).write(str(tmp_path / "p"))
    assert values(sources.parquet(spark, str(tmp_path / "p"))) == [0, 1, 2]


def test_sinks_and_jobs(spark):
    got = []
    input_range(spark, 0, 5).sink_into(got)
    assert sorted(r[0] for r in got) == [0, 1, 2, 3, 4]
    registry = job.Registry()

    @registry.register("up_to")
    def up_to(session, conf, n):
        return input_range(session, 0, n * conf.resources["times"])

    out = registry.submit(spark, "up_to", job.JobConf(resources={"times": 2}), n=3)
    assert sorted(r[0] for r in out) == list(range(6)) and out.try_next() is None
    stopped = registry.submit(spark, "up_to", job.JobConf(resources={"times": 2}), n=3)
    stopped.cancel()
    assert list(stopped) == []
    failing = job.run(spark, lambda s, c: input_range(s, 0, 3).map(x="raise_error('no')"))
    with pytest.raises((PySparkException, Py4JJavaError)):
        next(failing)
    assert list(failing) == []


def test_streams(spark, tmp_path):
    for k, words in enumerate((["a b"], ["b c"])):
        spark.createDataFrame([(w,) for w in words], "line string").write.mode("append").parquet(str(tmp_path / "in"))
    stream = streaming.read(spark, str(tmp_path / "in"), "line string", 1)
    seen = []
    q = streaming.each_batch(stream, lambda f: algorithms.word_count(f), lambda f, n: seen.extend(map(tuple, f.df.collect())), str(tmp_path / "ckpt"))
    assert q.awaitTermination(60)
    assert sorted(seen) in ([("a", 1), ("b", 1), ("b", 1), ("c", 1)], [("a", 1), ("b", 2), ("c", 1)])


def test_functions(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0])], "a array<double>, b array<double>")
    assert df.select(functions.dot(F.col("a"), F.col("b"))).first()[0] == 11
    assert df.select(functions.sigmoid(F.lit(0.0))).first()[0] == 0.5
    import pyarrow.compute as pc

    assert values(ints(spark, 1, 2).map(y=functions.scalar(lambda x: pc.multiply(x, 3), "long")(F.col("x")))) == [3, 6]


@pytest.mark.parametrize("separator", ["|", ".", "*", "^", "\t", "::"])
def test_edge_lists_with_any_separator(spark, tmp_path, separator):
    from skein.sources import encode_edges, load_edges

    (tmp_path / "in").write_text(separator.join(["src", "dst"]) + "\n" + "\n".join(separator.join(map(str, x)) for x in [(1, 2), (1, 3), (1, 3), (4, 1)]) + "\n\n")
    encode_edges(spark, str(tmp_path / "in"), str(tmp_path / "out"), separator, skip_header=True)
    assert sorted(tuple(r) for r in load_edges(spark, str(tmp_path / "out")).collect()) == [(1, 2), (1, 3), (1, 3), (4, 1)]
    with pytest.raises(Exception, match="no edge"):
        encode_edges(spark, str(tmp_path / "in"), str(tmp_path / "bad"), separator)


def test_first_partition_has_a_value_without_rows(spark):
    f = input_range(spark, 0, 10).repartition("x", 4)
    assert sorted(tuple(r) for r in f.fold_partition_from(n=("0L", "count(*)")).df.collect()) == [(0, 3), (1, 3), (2, 2), (3, 2)]
    assert sorted(tuple(r) for r in f.filter("x = 2").fold_partition_from(n=("0L", "count(*)")).df.collect()) == [(0, 0), (2, 1)]


def test_reduce_with(spark):
    product = lambda a, b: a * b
    assert input_range(spark, 1, 11).reduce_with("p", "x", product).value()["p"] == 3628800
    assert input_range(spark, 0, 0).reduce_with("p", "x", product).value() is None
    got = input_range(spark, 1, 4).apply(lambda f: f.flat_map("sequence(2L, x)", "y").filter("y <= 3").reduce_with("p", "y", product)).df.collect()
    assert sorted(tuple(r) for r in got if r["x"] > 1) == [(2, 2), (3, 6)]


def test_stateful_cancel_and_scopes_over_batches(spark, tmp_path):
    """Scopes that go over several batches have one operator each; on_cancel is called if a limit is met before the end."""
    folder = str(tmp_path)

    def make():
        import os
        import uuid

        class Log:
            def __init__(self):
                self.n = 0

            def mark(self, what):
                with open(os.path.join(folder, f"{what}-{uuid.uuid4().hex}"), "w") as f:
                    f.write(str(self.n))

            def on_batch(self, batch):
                self.n += len(batch)
                yield batch

            def on_end(self):
                self.mark("end")

            def on_cancel(self):
                self.mark("cancel")

        return Log()

    kinds = lambda: sorted(f.name.split("-")[0] + f.read_text() for f in tmp_path.iterdir())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        own = Flow(spark.createDataFrame([(1,), (2,), (0,)], "x int"))
        rows = own.apply(lambda f: f.flat_map("filter(sequence(1, x * 25), y -> y > 0 and x > 0)", "y").stateful(make, "y int").count("n"), unique="x").df.collect()
        assert sorted(map(tuple, rows)) == [(0, 0), (1, 25), (2, 50)]
        assert kinds() == ["end25", "end50"]
        assert len(Flow(spark.range(0, 3_000_000, 1, 1)).stateful(make, "id long").limit(5).df.collect()) == 5
        deadline = time.time() + 20
        while len(kinds()) < 3 and time.time() < deadline:
            time.sleep(0.2)
        assert kinds()[0].startswith("cancel") and len(kinds()) == 3
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_resources_for_tasks(spark):
    conf = job.JobConf(resources={"big": "x" * 100, "table": spark.range(1)})
    assert conf.in_tasks(spark, "big").value == "x" * 100
    with pytest.raises(ValueError):
        conf.in_tasks(spark, "big", most_bytes=50)
    with pytest.raises(TypeError):
        conf.in_tasks(spark, "table")
