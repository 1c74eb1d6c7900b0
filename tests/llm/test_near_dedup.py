import math
import random
import re
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from skein.llm import near_dedup as N
from skein.llm.components import connected_components

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(rows):
    """Class by least doc_id, over all pairs that share a shingle."""
    docs = {i: WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")) for i, t in rows}
    n, df = len(docs), Counter(w for v in docs.values() for w in set(v))
    idf = lambda w: min(1, max(0, math.log(n / df[w]) / -math.log(N.DF_FLOOR))) if df[w] >= max(2, math.ceil(N.DF_FLOOR * n)) else 1
    vec, where = {}, defaultdict(set)
    for i, w in docs.items():
        k, vec[i] = min(5, len(w)), Counter()
        for p in range(len(w) - k + 1 if k else 0):
            vec[i][tuple(w[p : p + k])] += (1 + sum(map(idf, w[p : p + k])) / k) / 2
            where[tuple(w[p : p + k])].add(i)
    root = {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in {(a, b) for own in where.values() for a in own for b in own if a < b}:
        both = sum(min(vec[a][s], vec[b][s]) for s in vec[a] if s in vec[b])
        if both / (sum(vec[a].values()) + sum(vec[b].values()) - both) >= N.LEAST:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {i: find(i) for i in docs}


def corpus():
    rng = random.Random(5)
    fresh = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    texts = []
    for _ in range(15):
        base = fresh(150)
        texts.append(base)
        for _ in range(rng.randrange(5)):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = "new"
            texts.append(w)
    hot = fresh(200)  # a large group of near copies, and one of exact copies
    texts += [[*hot[:k], "x", *hot[k + 1 :]] for k in range(60)] + [hot] * 20 + [fresh(80) for _ in range(20)] + [["only", "three", "words"]] * 2
    rng.shuffle(texts)
    return [(i, " ".join(w)) for i, w in enumerate(texts)]


def test_classes(documents):
    rows = corpus()
    got = {r["doc_id"]: r for r in N.report(documents(rows)).collect()}
    assert {i: r["class_id"] for i, r in got.items()} == brute(rows)
    assert sum(r["kept"] for r in got.values()) == len(set(brute(rows).values()))
    kept = N.keep_first(documents(rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(brute(rows).values())) and kept.columns == documents(rows).columns


def test_small_groups_in_a_large_template_bucket(documents):
    """Pages of one template, below the threshold for each other, that hold pairs above it."""
    rng = random.Random(3)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    template, texts = fresh(150), []
    for _ in range(40):
        both = fresh(9)
        texts += [[*template, *both, *fresh(7)], [*template, *both, *fresh(7)], [*template, *fresh(16)]]
    rng.shuffle(texts)
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    want = brute(rows)
    assert len(set(want.values())) == 80
    assert {r["doc_id"]: r["class_id"] for r in N.report(documents(rows)).collect()} == want


def test_weights_beyond_half_precision():
    """One shingle that repeats more often than a 16-bit float can count."""
    idf = SimpleNamespace(value=N.Idf(np.zeros(0, np.uint64), np.zeros(0, np.int64), 2))
    bits = SimpleNamespace(value=np.full(N.R.SLOTS // 8, 255, np.uint8))
    batch = pa.RecordBatch.from_pydict({"did": [1, 2, 3], "th": [1, 2, 3], "slot": [1, 2, 3], "text": ["ha " * 70000, "ha " * 69000, "ha " * 3001]})
    x, y, z = next(N._vectors(idf, bits)([batch])).column("vector").to_pylist()
    assert abs(N.weighted_jaccard(x, y) - 68996 / 69996) < 1e-6
    assert abs(N.weighted_jaccard(z, x) - 2997 / 69996) < 1e-6


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (12, 11), (20, 20)] + [(100, 100 + k) for k in range(1, 50)]
    rng = random.Random(4)
    edges += [(1000 + rng.randrange(300), 1000 + rng.randrange(300)) for _ in range(160)] + [(5000 - k, 5001 - k) for k in range(40)]
    root = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    want = {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}
    for few in (0, 1000):
        got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), few=few).collect()}
        assert got == want
        assert connected_components(spark.createDataFrame([], "a long, b long"), few=few).count() == 0


def test_odd_rows(odd, empty):
    got = N.report(odd).collect()
    assert len(got) == odd.count()
    assert [r["class_size"] for r in got if r["doc_id"] in (2, 3, 4)] == [1, 1, 1]
    assert sorted(r["kept"] for r in got if r["doc_id"] in (7, 8)) == [False, False, True]
    assert N.report(empty).count() == 0
    out = N.keep_first(odd)
    assert out.columns == odd.columns and out.count() == odd.count() - 2
    assert N.keep_first(empty).count() == 0
