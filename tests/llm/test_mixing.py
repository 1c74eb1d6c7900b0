import numpy as np
import pytest

from skein.llm import mixing as M


def table(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 40))), ["en", "de", "fr", None][int(rng.choice(4, p=[0.6, 0.2, 0.15, 0.05]))], ["a", "b", None][int(rng.choice(3, p=[0.7, 0.2, 0.1]))]) for i in range(4000)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_marginals_meet_targets(spark):
    got = M.report(table(spark), budget=0.3).toPandas()
    mixed = got["n_tokens"] * got["probability"]
    assert mixed.sum() == pytest.approx(0.3 * got["n_tokens"].sum(), rel=1e-6)
    for d in M.DIMENSIONS:
        have = got["n_tokens"].groupby(got[d].fillna("null")).sum().astype(float) ** M.FLATTEN[d]
        want = have / have.sum() * 0.3 * got["n_tokens"].sum()
        share = mixed.groupby(got[d].fillna("null")).sum()
        assert np.allclose(share[want.index], want, rtol=1e-3), d
    kept = (got["n_tokens"] * got["kept"]).sum()
    assert abs(kept - mixed.sum()) < 0.08 * mixed.sum()


def test_driver_and_spark_rake_alike(spark):
    m = M.measured(table(spark))
    a, b = (M.probabilities(m, budget=0.7, rounds=4, driver_cells=n).toPandas().sort_values(list(M.DIMENSIONS)).reset_index(drop=True) for n in (M.DRIVER_CELLS, 0))
    assert len(a) == len(b) and np.allclose(a["probability"], b["probability"])
    assert a["probability"].between(0, 1).all()


def test_given_targets(spark):
    targets = spark.createDataFrame([("source", "a", 500.0), ("source", "b", 500.0), ("lang", "en", 700.0), ("lang", "de", 300.0), ("topic", "short", 1000.0)], "dim string, value string, target double")
    got = M.report(table(spark), targets=targets).toPandas()
    mixed = got["n_tokens"] * got["probability"]
    assert mixed[got["source"] == "b"].sum() == pytest.approx(500, rel=1e-3) and mixed[got["lang"] == "fr"].sum() == 0


def test_odd_rows(odd, empty):
    got = M.report(odd).collect()
    assert len(got) == odd.count() and not any(r["kept"] for r in got if r["doc_id"] in (1, 2, 3))
    out = M.sample(odd)
    assert out.columns == [*odd.columns, "mix_probability"] and out.count() <= odd.count()
    assert M.report(empty).count() == 0 and M.sample(empty).count() == 0


@pytest.mark.parametrize(("text", "n"), [(None, 0), ("", 0), (" \n\t", 0), ("a", 1), (" a  b\nc ", 3)])
def test_tokens(spark, text, n):
    assert spark.createDataFrame([(text,)], "t string").select(M.tokens_of(M.F.col("t"))).first()[0] == n


def test_against_plain_raking(spark):
    """Iterative proportional fitting over dicts of cells, for given topics and targets that no cell limits."""
    df = table(spark).withColumn("subject", M.F.expr("if(doc_id % 3 = 0, 'x', 'y')"))
    rows = [r.asDict() for r in df.collect()]
    cells = {}
    for r in rows:
        key = (r["source"], r["lang"], r["subject"])
        cells[key] = cells.get(key, 0) + len(r["text"].split())
    goals = [{}, {}, {}]
    for key, n in cells.items():
        for g, v in zip(goals, key, strict=True):
            g[v] = g.get(v, 0) + n
    goals = [{v: 1000 * n**p / sum(m**p for m in g.values()) for v, n in g.items()} for g, p in zip(goals, (0.7, 0.5, 0.9), strict=True)]
    raked = {k: float(n) for k, n in cells.items()}
    for _ in range(500):
        for d, g in enumerate(goals):
            have = {v: sum(x for k, x in raked.items() if k[d] == v) for v in g}
            raked = {k: x * g[k[d]] / have[k[d]] for k, x in raked.items()}
    assert all(raked[k] < cells[k] for k in cells)
    targets = spark.createDataFrame([(d, v, t) for d, g in zip(M.DIMENSIONS, goals, strict=True) for v, t in g.items()], "dim string, value string, target double")
    got = M.report(df, "subject", targets=targets).select(*M.DIMENSIONS, "probability").distinct().collect()
    assert len(got) == len(cells)
    for r in got:
        key = tuple(r[d] for d in M.DIMENSIONS)
        assert r["probability"] == pytest.approx(raked[key] / cells[key], rel=1e-4)
