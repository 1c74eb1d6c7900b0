import numpy as np
import pytest

from skein.llm import ann


def brute(ids, x, every, k):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = (x * x[i]).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((x[i] * x[i]).sum()))
        own = np.flatnonzero(ids != ids[i])
        own = own[np.lexsort((ids[own], -s[own]))][:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in own]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("piece", [16, 4096])
def test_recall(spark, piece):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16))
    x = centres[rng.integers(0, 30, 3000)] + 0.4 * rng.normal(size=(3000, 16))
    ids = np.arange(3000)
    df = spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    own, want = found(ann.search(df, piece=piece)), brute(ids, x, 50, 5)
    assert own.keys() == want.keys()
    assert all(len(v) == 5 for v in own.values())
    hits = sum(len({a for a, _ in own[q]} & {a for a, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)


def test_equal_vectors_and_ties(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(200)] + [(200 + i, [float(i), 1.0, 0.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    own = found(ann.search(df, piece=32, leaf_rows=8))
    assert [v for v, _ in own[0]] == [1, 2, 3, 4, 5] and [v for v, _ in own[50]] == [0, 1, 2, 3, 4]


def test_every_query_gets_its_fill(spark):
    """Small leaves far apart: few visits would find fewer than k."""
    rows = [(i, [float(i // 3 * 1000 + 1), float(i % 3), 1.0]) for i in range(150)] + [(0, [1.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    own = found(ann.search(df, leaf_rows=2, branch=4, recall=0.01))
    assert {q: len(x) for q, x in own.items()} == {0: 5, 50: 5, 100: 5}


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (50, None), (100, []), (150, [0.0, 0.0]), (200, [float("nan"), 1.0]), (250, [float("inf"), 1.0]), (300, [None, 1.0]), (350, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    own = found(ann.search(df))
    assert {q: [v for v, _ in x] for q, x in own.items()} == {0: [1, 2]}
    assert ann.search(df.limit(0)).count() == 0
    assert ann.search(df.where("vec_id = 1")).count() == 0
    assert ann.search(df.where("vec_id = 0")).count() == 0


def test_extreme_sizes(spark):
    """Squares of components that overflow or vanish; a cosine doesn't depend on lengths."""
    rows = [(0, [1e200, 1e200]), (1, [1.0, 1.0]), (2, [1e-200, 1e-200]), (3, [1e308, 0.0]), (50, [5e-324, 0.0]), (4, [1e-300, 1e300])]
    own = found(ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert {v for v, _ in own[0][:2]} == {1, 2} and all(abs(s - 1) < 1e-12 for _, s in own[0][:2]) and len(own[0]) == 5
    assert own[50][0] == (3, 1.0) and len(own[50]) == 5 and all(np.isfinite(s) for x in own.values() for _, s in x)


def test_scores_are_those_of_the_plain_formula(spark):
    """Against brute force on a whole table: the same scores, and at least nine of ten neighbours."""
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    own = found(ann.search(df))
    t = df.orderBy("vec_id").toArrow()
    x, ids = np.stack(t.column("embedding").to_numpy()).astype(np.float64), t.column("vec_id").to_numpy()
    want = brute(ids, x, 50, 5)
    assert own.keys() == want.keys()
    same = [(a, b) for q in want for a in own[q] for b in want[q] if a[0] == b[0]]
    assert len(same) >= 0.9 * sum(map(len, want.values())) and all(abs(a[1] - b[1]) < 1e-12 for a, b in same)
