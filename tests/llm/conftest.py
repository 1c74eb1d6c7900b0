import pytest
from pyspark.sql import types as T

DOCUMENT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

LANGS = {
    "en": "the of and that with from this they have which there would their about".split(),
    "de": "der die und nicht mit dass sich auch über werden für wird einen größer".split(),
}


def words(lang: str, seed: int, n: int) -> str:
    """Invented prose."""
    import random

    rng = random.Random(f"{lang}{seed}")
    return " ".join(rng.choice(LANGS[lang]) + rng.choice(["", "", "er", "ung" if lang == "de" else "ing", str(rng.randrange(90))]) for _ in range(n))


@pytest.fixture
def documents(spark):
    """(doc_id, text) pairs to a table with all columns of documents."""

    def make(rows, lang="en", source="s"):
        return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t)) for i, t in rows], DOCUMENT)

    return make


@pytest.fixture
def odd(documents, spark):
    """Nulls, empty texts, signs only, a very long text, repeated rows and ties, and columns with clashing names."""
    from pyspark.sql import functions as F

    long_text = " ".join(f"w{i % 977}x{i}" for i in range(40_000))
    rows = [(None, None), (1, None), (2, ""), (3, " \n \n"), (4, "!?"), (5, long_text), (6, "one"), (7, "a b c d e f g h i j k l"), (7, "a b c d e f g h i j k l"), (8, "a b c d e f g h i j k l"), (None, "é ü 日本 語")]
    df = documents(rows).unionAll(documents([(9, "the end of it all")], None, None))
    return df.withColumns({"n_words": F.lit(1), "items": F.lit("x"), "slot": F.lit(2), "probability": F.lit(0.5), "kept": F.lit(True)})


@pytest.fixture
def empty(documents):
    return documents([])
