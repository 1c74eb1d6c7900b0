import hashlib
import random
import re

import numpy as np
import pytest

from skein.llm import suffix_dedup as S


def brute(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def corpus():
    rng = random.Random(2)
    noise = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passage = noise(700)
    rows = [" " * 5000, "ab" * 3000, "x" + " " * 300, None, "", "z" * 99, "z" * 100, "z" * 101, passage]
    rows += [noise(rng.randrange(200)) + passage[rng.randrange(300) : rng.randrange(300, 700)] + noise(rng.randrange(200)) for _ in range(60)]
    rows += [f"{i}" * 7 + " The quick brown fox jumps over the lazy dog and then some more words so that it is long enough " + f"{i}" * 60 for i in range(60)]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("part_bytes", "block", "many"), [(1 << 20, 1 << 20, 4096), (4096, 1000, 4096), (4096, 1000, 2)])
def test_against_brute_force(documents, monkeypatch, part_bytes, block, many):
    monkeypatch.setattr(S, "BLOCK", block)
    monkeypatch.setattr(S, "MANY", many)
    rows = corpus()
    got = {r["doc_id"]: tuple(r)[1:] for r in S.remove_repeats(documents(rows).repartition(3), part_bytes).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("lone_first", [False, True])
def test_hot_block_and_single_phrases(spark, lone_first):
    """A block with many phrases of a trigger, and blocks that hold one phrase of it, or a part of one."""
    rng = random.Random(11)
    noise = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    long = np.frombuffer(noise(50000).encode(), np.uint8)
    place = np.arange(len(long) - S.GRAM + 1)
    k = int(S.B.Spans(long, S.B.Powers()).hash(place, place + S.GRAM).argmin())
    trigger = long[k : k + S.GRAM].tobytes().decode()
    hot = [noise(80) + trigger + noise(80) for _ in range(20)]
    lone = [t if i % 2 else noise(50) + t[20:150] + noise(50) for i, t in enumerate(hot[4:16])]
    ids = iter(range(100))
    blocks = [[(next(ids), t)] for t in lone] if lone_first else []
    blocks.append([(next(ids), t) for t in hot])
    blocks += [] if lone_first else [[(next(ids), t)] for t in lone]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(range(len(blocks)), len(blocks)).flatMap(lambda i: blocks[i]), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in S.remove_repeats(docs).collect()}
    assert got == brute([r for b in blocks for r in b]) and sum(r[2] > 0 for r in got.values()) == len(lone)


def test_suffix_ranks():
    text = np.frombuffer(("ab" * 200 + "c" + "ab" * 200).encode(), np.uint8)
    rank = S.suffix_ranks(text)
    starts = range(len(text) - S.WINDOW + 1)
    strings = [text[i : i + S.WINDOW].tobytes() for i in starts]
    order = {s: k for k, s in enumerate(sorted(set(strings)))}
    own = [rank[i] for i in starts]
    assert all((own[i] < own[j]) == (order[strings[i]] < order[strings[j]]) for i in starts for j in range(i % 7, len(own), 7))


def test_odd_rows(odd, empty):
    got = S.remove_repeats(odd, keep_text=True).collect()
    assert len(got) == odd.count() and S.remove_repeats(empty).count() == 0
    assert all(r["n_removed"] == 0 for r in got)  # rows that repeat whole are one document
