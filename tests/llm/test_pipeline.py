"""The stages in order on the smallest tables; each stage is judged on its own input."""

from pyspark.sql import functions as F

import corpus_pipeline as P
from skein.llm import decontaminate, queries

from .test_decontaminate import brute as hits
from .test_near_dedup import brute as classes

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = docs.columns
    for name, stage in P.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = {r["doc_id"]: r for r in docs.collect()}
        assert after.keys() <= before.keys() and len(after) == docs.count()
        rows = [(i, r["text"]) for i, r in before.items()]
        if name != "mixing":
            assert docs.columns == names
        if name == "language_id":
            assert len(after) >= 0.99 * len(before)
        if name == "near_dedup":
            assert after.keys() == set(classes(rows).values())
        if name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
            assert after.keys() == {i for i, x in hits(rows, items).items() if not x[-1]}
        if name == "mixing":
            assert docs.columns == [*names, "probability"] and 0 < len(after) < len(before)


def test_run(spark):
    out = P.run(spark, FOLDER)
    assert 0 < out.count() < 200 and "probability" in out.columns


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert decontaminate.FOUND.names[0] == "n_words"


def test_odd_rows(spark, odd, empty):
    """Each stage on nulls, empty, very long and repeated texts, columns with clashing names, and an empty table."""
    clash = odd.withColumns({"__lang": F.lit(1), "lang_pred": F.lit("x"), "score": F.lit(2.0), "class_id": F.lit(3), "line": F.lit(4), "n_hit": F.lit(5), "__topic": F.lit(6)})
    kept = {}
    for name, stage in P.STAGES:
        out = stage(spark, clash, FOLDER)
        assert all(r["__lang"] == 1 and r["__topic"] == 6 and r["class_id"] == 3 for r in out.collect())
        assert out.columns == [*clash.columns, *(["mix_probability"] if name == "mixing" else [])], name
        kept[name] = sorted(out.select("doc_id").collect(), key=lambda r: (r[0] is not None, r[0] or 0))
        kept[name] = [r[0] for r in kept[name]]
        assert stage(spark, empty, FOLDER).count() == 0
    assert kept["language_id"] == [None, 5, 6, 7, 7, 8, 9]
    assert kept["line_dedup"] == [None, None, 1, 2, 3, 4, 5, 6, 7, 7, 9]
    assert kept["near_dedup"] == [None, None, 1, 2, 3, 4, 5, 6, 7, 9]
    assert kept["decontamination"] == [None, None, 1, 2, 3, 4, 5, 6, 7, 7, 8, 9]
    assert not {1, 2, 3} & set(kept["mixing"]) and kept["mixing"].count(7) != 1
