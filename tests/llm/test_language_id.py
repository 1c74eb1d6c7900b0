import numpy as np
from pyspark.sql import functions as F

from skein.llm import language_id as L

from .conftest import words


def test_held_out_accuracy(documents):
    df = documents([(i, words("en", i, 40)) for i in range(120)], "en").unionAll(documents([(1000 + i, words("de", i, 40)) for i in range(60)], "de"))
    rows = {r["doc_id"]: r for r in L.report(df).collect()}
    held = {i for i, r in rows.items() if r["held_out"]}
    assert 20 < len(held) < 100
    assert all(rows[i]["lang_pred"] == ("en" if i < 1000 else "de") for i in held)
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def test_only_training_rows_teach(documents):
    """Labels of held-out rows have no effect."""
    df = documents([(i, words("en", i, 40)) for i in range(60)], "en").unionAll(documents([(1000 + i, words("de", i, 40)) for i in range(60)], "de"))
    other = df.withColumn("lang", F.when(L.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    a, b = ({r["doc_id"]: r["lang_pred"] for r in L.report(x).collect()} for x in (df, other))
    assert a == b and "xx" not in b.values()


def test_odd_rows(odd, empty):
    rows = L.report(odd).collect()
    assert len(rows) == odd.count()
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 3, 4)} == {"und"}
    assert all(r["lang_pred"] != "und" for r in rows if r["doc_id"] in (5, 6, 7, 8))
    assert L.report(empty).count() == 0
    assert {r["lang_pred"] for r in L.report(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    model = L.fit(odd)
    out = L.predict(L.predict(odd, model), model)
    assert out.columns == [*odd.columns, "lang_pred", "score"] and out.count() == odd.count()


def test_against_dense_kernel_ridge(documents):
    """With all training texts as landmarks the scores are those of kernel ridge regression, here in its dual form over sets."""
    rows = [("en", words("en", i, 12)) for i in range(30)] + [("de", words("de", i, 12)) for i in range(20)]
    held = [words("en", 900, 9), words("de", 901, 9), words("en", 902, 4) + " " + words("de", 903, 4)]
    df = documents([(i, t) for i, (_, t) in enumerate(rows)]).withColumn("lang", F.when(F.col("doc_id") < 30, "en").otherwise("de"))
    model = L.fit(df, landmarks=1000, least_texts=1, ridge=1e-2, vocabulary=1 << 24)
    out = {r["doc_id"] for r in df.where(L.held_out(F.col("doc_id"))).collect()}
    rows = [r for i, r in enumerate(rows) if i not in out]
    sets = lambda t: {t.lower().encode()[a : a + n] for n in (1, 2, 3) for a in range(len(t.encode()) - n + 1)}
    train, known = [sets(t) for _, t in rows], set().union(*(sets(t) for _, t in rows))
    kernel = lambda x, y: len(x & y) / np.sqrt(len(x) * len(y))
    langs = [k for k, _ in rows]
    weight = np.array([1 / langs.count(k) for k in langs])
    weight /= weight.sum()
    k = np.array([[kernel(x, y) + 1 for y in train] for x in train])
    y = np.array([[1.0 if k == lang else -1.0 for lang in ("de", "en")] for k in langs])
    alpha = np.linalg.solve(k + 1e-2 * np.diag(1 / weight), y)
    want = np.array([[kernel(sets(t) & known, x) + 1 for x in train] for t in held]) @ alpha
    column = model.lookup()
    present = np.zeros((3, len(model.codes) + 1), np.float32)
    for r, t in enumerate(held):
        present[r, column[L.grams(np.frombuffer(t.lower().encode(), np.uint8))]] = 1
    assert np.allclose(model.scores(present[:, :-1]), want, atol=2e-3)


def test_bounds(documents):
    """More languages than are learned, and a small sample: the most frequent ones stay."""
    df = documents([(i, words("en", i, 20)) for i in range(60)], "en").unionAll(documents([(100 + i, words("de", i, 20)) for i in range(40)], "de"))
    df = df.unionAll(documents([(200 + i, f"zz{i} yy") for i in range(5)], "rare"))
    model = L.fit(df, most_languages=2, sample_rows=10, vocabulary=300)
    assert model.langs == ["de", "en"] and len(model.codes) <= 300 and model.landmarks.shape[1] <= 10
    assert {r["lang_pred"] for r in L.predict(df, model).collect()} <= {"de", "en"}


def test_ties(documents):
    """Texts that two languages share have one score for both: the first name for every copy."""
    df = documents([(i, "same words here") for i in range(30)], "b").unionAll(documents([(100 + i, "same words here") for i in range(30)], "a"))
    assert {r["lang_pred"] for r in L.report(df).collect()} == {"a"}
