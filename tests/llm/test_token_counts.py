import random

from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import token_counts as K

COUNTER = K.Counter(K.VOCABULARY)
PARTS = ["a", "b", "'", "ll", "'s", " ", "  ", "\n", "1", "22", "é", "!", "?!", "the", "'ve", "\t", "日本", " x", "", " ", "🙂"]
TEXT = st.lists(st.sampled_from(PARTS), max_size=300).map("".join)


@settings(max_examples=150, deadline=None)
@given(TEXT, st.lists(st.tuples(st.integers(0, 400), st.integers(0, 60), TEXT), max_size=5))
def test_edits_count_as_whole_texts(text, edits):
    d = K.Document(text, COUNTER)
    for at, n, new in edits:
        want = d.text[: min(at, len(d.text))] + new + d.text[min(at, len(d.text)) + n :]
        d.edit(at, at + n, new)
        assert d.text == want and d.tree.total == len(COUNTER.encoding.encode_ordinary(want))
        assert int(d.tree.chars[1]) == len(want) and sum(sum(t) for _, _, t in d.tree.leaves) == d.tree.total and K.Tree.unpack(want, d.tree.pack()).text == want


def test_a_small_edit_reencodes_little():
    rng = random.Random(0)
    text = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(20_000))
    d = K.Document(text, COUNTER)
    assert d.edit(50_000, 50_003, "zz") < 20
    assert d.tree.total == len(COUNTER.encoding.encode_ordinary(d.text))


def test_table(spark, documents, odd, empty):
    docs = documents([(1, "call 0123456789abcdef0 or me@example.org now"), (2, "plain"), (3, None)])
    rows = {r["doc_id"]: r for r in K.report(docs).collect()}
    whole = lambda t: len(COUNTER.encoding.encode_ordinary(t))
    assert rows[1]["n_edits"] == 2 and rows[1]["n_tokens_after"] == whole("call [redacted] or [redacted] now")
    assert rows[1]["n_tokens_before"] == whole("call 0123456789abcdef0 or me@example.org now")
    assert rows[2]["n_tokens_after"] == rows[2]["n_tokens_before"] == whole("plain") and rows[3]["n_tokens_after"] == 0
    assert K.report(odd).count() == odd.count() and K.report(empty).count() == 0


def test_edits_table(spark, documents):
    docs = documents([(1, "abc def"), (2, "xyz")])
    edits = spark.createDataFrame([(1, 2, 0, 1, "Q"), (1, 1, 3, 3, " new"), (1, 3, None, 1, "no"), (9, 1, 0, 1, "no"), (2, 1, 100, 200, "!")], "doc_id long, seq long, start long, end long, replacement string")
    from pyspark.sql import functions as F

    rows = {r["doc_id"]: r for r in K.count_edited(K.with_edits(docs, edits), F.col("edits"), ["doc_id"]).collect()}
    whole = lambda t: len(COUNTER.encoding.encode_ordinary(t))
    assert rows[1]["n_tokens_after"] == whole("Qbc new def") and rows[1]["n_edits"] == 2
    assert rows[2]["n_tokens_after"] == whole("xyz!")


def test_stored_trees(spark, documents):
    """Two rounds of edits on stored trees; only what they touch is encoded."""
    from pyspark.sql import functions as F

    text = "alpha beta gamma " * 3000
    stored = K.with_trees(documents([(1, text), (2, None), (3, "x")]), ["doc_id"])
    first = K.apply_edits(stored, F.expr("array(named_struct('seq', 1L, 'start', 100L, 'end', 105L, 'replacement', 'Q'), named_struct('seq', 2L, 'start', 0L, 'end', 0L, 'replacement', 'new '))"), ["doc_id"])
    rows = {r["doc_id"]: r for r in K.apply_edits(first, F.expr("array(named_struct('seq', 1L, 'start', 3L, 'end', 4L, 'replacement', '!'))"), ["doc_id"]).collect()}
    want = "new " + text[:100] + "Q" + text[105:]
    whole = lambda t: len(COUNTER.encoding.encode_ordinary(t))
    assert rows[1]["text"] == want[:3] + "!" + want[4:] and rows[1]["n_tokens_before"] == whole(want)
    assert rows[1]["n_tokens_after"] == whole(rows[1]["text"]) and rows[1]["n_reencoded"] < 20
    assert rows[2]["text"] == "new!Q" and rows[2]["n_tokens_after"] == whole("new!Q")
    assert {r["doc_id"]: r["text"] for r in stored.collect()} == {1: text, 2: None, 3: "x"}


def test_many_edits_of_a_long_text(documents):
    """The work must not follow the product of edits and length."""
    text = "id 0123456789abcdef0 and more words of text, " * 8000
    row = K.report(documents([(1, text), (1, text)])).first()
    assert row["n_edits"] == 8000 and row["n_tokens_after"] == len(COUNTER.encoding.encode_ordinary(text.replace("0123456789abcdef0", "[redacted]")))
