"""Periodic runs against all pairs of place and period."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w):
    out = {}
    for q in range(1, len(w) // 4 + 1):
        same = [w[i] == w[i + q] for i in range(len(w) - q)] + [False]
        i = 0
        while i < len(same):
            j = i
            while same[j]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)  # smaller periods come first
            i = j + 1
    return sorted((s, n, q) for (s, n), q in out.items())


def brute_row(doc_id, text):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *four, sha("".join(f"{s},{m},{q}\n" for s, m, q in sorted(runs, key=lambda r: (r[0], r[2])))), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def agrees(df):
    from quire.llm.periodic_runs import run_digests

    got = Counter(tuple(r) for r in run_digests(df).collect())
    assert got == Counter(brute_row(r.doc_id, r.text) for r in df.collect())
    return sum(n for r, n in got.items() if r[1])


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 12000")
    assert agrees(docs) > 5


def test_edges(spark):
    rnd = random.Random(3)
    texts = [None, "", " \t\n", "a", "a " * 5, "a " * 6, "a b " * 3, "a b " * 4, "a b " * 4 + "a", "a\x0ba\fa\ra\na a", "x y " * 9, "a " * 900, "a b a b a b a b c c c c c c a b a b a b a b", "d " * 6 + "e " * 6]
    texts += ["".join(rnd.choice("ab") + " " for _ in range(rnd.randint(0, 60))) for _ in range(200)]
    texts += [" ".join([rnd.choice("xyz") for _ in range(rnd.randint(0, 5))] + [rnd.choice("abc") for _ in range(rnd.randint(1, 9))] * rnd.randint(2, 9)) for _ in range(200)]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(7, "a b " * 4, "x", 1)] * 2 + [(None, "a b " * 40, None, None), (None, None, None, None)]
    assert agrees(spark.createDataFrame(rows, "doc_id long, text string, runs string, best int")) > 100
    assert agrees(spark.createDataFrame([(f"k{i}", "a b c " * 9) for i in range(40)], "doc_id string, text string")) > 0
    assert agrees(spark.createDataFrame([], "doc_id long, text string")) == 0


def test_agreement_of_places():
    from quire.llm.periodic_runs import agree, grammar

    rng = np.random.default_rng(1)
    for letters in (1, 2, 3, 50):
        middle = np.concatenate([rng.integers(2, 2 + letters, 60)] * 3 + [rng.integers(2, 2 + letters, 40)])
        s = np.r_[0, middle, 1]
        i, j = (x.ravel() for x in np.meshgrid(np.arange(1, len(s) - 1), np.arange(1, len(s) - 1)))
        i, j = i[i < j], j[i < j]
        levels = grammar(s)
        ahead, behind = agree(levels, i, j), agree(levels, i, j, back=True)
        for a, b, x, y in zip(i, j, ahead, behind, strict=True):
            assert x == next(k for k in range(len(s)) if s[a + k] != s[b + k])
            assert y == next(k for k in range(len(s)) if s[a - 1 - k] != s[b - 1 - k])


@pytest.mark.parametrize("text", ["one " * 200_000, "a b c d e " * 40_000])
def test_very_long(spark, text):
    from quire.llm.periodic_runs import periodic_runs

    n, q = len(text.split()), len(set(text.split()))
    row = periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in row.runs] == [(0, n, q)] and bytes(row.collapsed).decode().split() == text.split()[:q]
