import hashlib
import random
import re

import pytest

from skein.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokens(t):
    return WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))


def brute(docs, items, window=10):
    wins = {}
    for i, t in items:
        w = tokens(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[k : k + n]), set()).add("" if i is None else str(i))
    out = {}
    for i, t in docs:
        w, hit, found = tokens(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if x := wins.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= x
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def corpus(seed):
    rng = random.Random(seed)
    some = lambda n: [rng.choice("a b c d e É 7 zz".split()) for _ in range(n)]
    items = [(i, " ".join(some(rng.choice([0, 2, 9, 10, 11, 30])))) for i in range(25)] + [(99, None), (None, "q q q")]
    docs = []
    for i in range(40):
        w = some(rng.randrange(60))
        if i % 2:
            own = (rng.choice(items)[1] or "").split()
            w[5:5] = own[: rng.choice([3, 100])]
        docs.append((i, rng.choice([" ", "-", ". "]).join(x.upper() if rng.random() < 0.2 else x for x in w)))
    return [*docs, (900, None), (901, ""), (902, "?!")], items


@pytest.mark.parametrize(("seed", "item_bytes"), [(1, 1 << 24), (2, 1 << 24), (3, 400)])
def test_hits(spark, documents, seed, item_bytes):
    docs, items = corpus(seed)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in D.report(documents(docs), bench, item_bytes=item_bytes, shard_bytes=300).collect()}
    assert got == brute(docs, items)
    clean = {i for i, x in brute(docs, items).items() if not x[-1]}
    kept = D.remove(documents(docs), bench, item_bytes=item_bytes)
    assert {r["doc_id"] for r in kept.collect()} == clean and kept.columns == documents(docs).columns


def test_longest_matches(spark, documents):
    words = [f"w{i}" for i in range(40)]
    bench = spark.createDataFrame([(5, " ".join(words))], "item_id long, text string")
    row = D.find(documents([(1, "x y " + " ".join(words[3:25]) + " z")]), bench, ["doc_id"]).first()
    assert max((m["n_words"], m["item_word"], m["doc_word"]) for m in row["longest"]) == (22, 3, 2)


def test_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, "b c d e f g h i j k"), (2, ""), (3, None)], "item_id long, text string")
    got = D.report(odd, bench).collect()
    assert len(got) == odd.count() and sorted(r["doc_id"] for r in got if r["contaminated"]) == [7, 7, 8]
    kept = D.remove(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 3
    assert D.report(empty, bench).count() == 0 and D.report(odd, bench.limit(0)).where("contaminated").count() == 0


def test_repetitive(spark, documents):
    """The work must not follow the product of equal words; small ones are compared with brute force."""
    docs = [(1, "na " * 500), (2, "na " * 9 + "x " + "na " * 12 + "y"), (3, "ab na " * 40), (4, "na")]
    items = [(1, "na " * 60), (2, "na na"), (3, "na ab " * 30), (4, "ab na x")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in D.report(documents(docs), bench).collect()}
    assert got == brute(docs, items)
    bench = spark.createDataFrame([(1, "na " * 5000)], "item_id long, text string")
    row = D.find(documents([(1, "na " * 200_000)]), bench, ["doc_id"]).first()
    assert row["n_hit"] == row["n_words"] == 200_000 and max(m["n_words"] for m in row["longest"]) == 5000
