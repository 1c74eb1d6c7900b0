import random
import re

import pytest

from skein.llm import line_dedup as L

BASE = "the quick brown fox jumps over the lazy dog and runs away"


def near(w, v):
    """Equal, or one edit apart in words (both long) or else in characters."""
    long = len(w) >= L.NEAR_WORDS
    if w == v or long != (len(v) >= L.NEAR_WORDS):
        return w == v
    a, b = (w, v) if long else ("".join(w), "".join(v))
    return (long or min(len(a), len(b)) >= L.NEAR_CHARS) and L.one_edit(a, b)


def brute(rows):
    """Kept lines of each text: every earlier line is looked at."""
    seen, out = [], {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        kept, lines = [], t.split("\n") if t else []
        for line in lines:
            w = [x for x in re.split(r"[ \t\n\r\x0b\f]+", line) if x]
            if not w or not any(near(w, v) for v in seen):
                kept.append(line)
            seen.append(w)
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def check(df, rows):
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in L.report(df).collect()}
    assert got == brute(rows)


def test_small(documents):
    ws = BASE.split()
    rows = [(1, BASE), (2, f"{BASE}\n{BASE} now"), (3, "the quick brown cat jumps over the lazy dog and runs away\n\nshort\nshort"), (4, None), (5, ""), (6, f"now {BASE}\n"), (7, "\n" + " ".join(ws[1:]) + "\r"), (8, "the quick brown cat jumps over the lazy dog and runs home"), (9, "a b c d e"), (10, "a  b c d\te"), (11, "quick the brown fox jumps over the lazy dog and runs away")]
    rows += [(20 + i, " ".join([*ws[:6], str(i), *ws[6:]])) for i in range(40)]
    check(documents(rows), rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_edits(documents, seed):
    rng = random.Random(seed)
    lines = [" ".join(rng.choice("ab cd ef gh".split()) for _ in range(rng.randrange(1, 14))) for _ in range(60)]
    rows = []
    for i in range(60):
        own = []
        for _ in range(4):
            w = rng.choice(lines).split()
            for _ in range(rng.randrange(3)):
                k = rng.randrange(len(w) + 1)
                w[k : k + rng.randrange(2)] = ["zz"] * rng.randrange(2)
            own.append(" ".join(w))
        rows.append((i, "\n".join(own)))
    check(documents(rows), rows)


def test_short_lines_and_scripts_without_blanks(documents):
    """Lines of few words by characters, equal ones of any length; a line of characters never meets one of words."""
    text = "東京の空は青く広がり人々は静かに歩いていたそして夜が来る"
    rows = [(1, text), (2, text[:5] + "山" + text[6:]), (3, text[:-1]), (4, "x" + text), (5, text[:3] + "山川" + text[5:]), (6, "yes\nno"), (7, "no\nok"), (8, " yes "), (9, "0123456789 0123456789"), (10, "01234567890 12345678x"), (11, "0123456789 012345678"), (12, "0123456789 012345"), (13, "é" * 20 + "\n" + "é" * 21)]
    rows += [(20 + i, f"Internationalisation of number {i}") for i in range(12)]
    check(documents(rows), rows)


def test_long_and_repetitive(documents):
    rows = [(1, "ab " * 50_000), (2, "ab " * 49_999), (3, "é" * 60_000), (4, "é" * 60_001 + "\n" + "ab\n" * 3)]
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in L.report(documents(rows)).collect()}
    assert got == {1: (1, 0), 2: (1, 1), 3: (1, 0), 4: (5, 3)}


def test_one_edit():
    a = BASE.split()
    assert L.one_edit(a, a) and L.one_edit(a, a[:-1]) and L.one_edit(a[1:], a) and L.one_edit(a, [*a[:3], "x", *a[4:]])
    assert not L.one_edit(a, [*a[:3], "x", *a[4:-1], "y"]) and not L.one_edit(a, [a[1], a[0], *a[2:]])


def test_odd_rows(odd, empty):
    out = L.drop_lines(odd).collect()
    assert len(out) == odd.count()
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[1][0]["text"] is None and by[1][0]["__new"] == ""
    # rows that repeat whole are one document; another document with the line loses it
    assert [r["__gone"] for r in by[7]] == [0, 0] and by[8][0]["__gone"] == 1
    assert L.report(empty).count() == 0
