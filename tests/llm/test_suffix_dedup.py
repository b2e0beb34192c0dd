"""Suffix-array dedup against a count of all windows."""

import random
from collections import Counter

import numpy as np

EDGE = "doc_id long, text string, k1 long, body int, ranges string"


def brute(texts, length=200):
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    for b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        yield len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)


def agrees(df, length=200, **more):
    from quire.llm.suffix_dedup import without_repeats

    rows = df.collect()
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in without_repeats(df, length, **more).collect())
    want = Counter((r.doc_id, *b) for r, b in zip(rows, brute([r.text for r in rows], length), strict=True))
    assert got == want
    return sum(n * k[2] for k, n in want.items())


def test_whole_table(spark, sf):
    assert agrees(spark.read.parquet(f"{sf}/documents.parquet")) > 0


def test_edges_ties_and_hot_passages(spark):
    rnd = random.Random(5)
    some = lambda letters, n: "".join(rnd.choice(letters) for _ in range(n))
    base = some("abcdé ", 3000)
    texts = [None, "", None, "x" * 5000, "x" * 199, "x" * 200, "ab" * 700, "ab" * 500 + "c", base, base, base + base[:300]]
    for _ in range(80):  # pieces of one text, about as long as a window
        cut = [rnd.randint(0, 2700) for _ in range(rnd.randint(1, 4))]
        texts.append("".join(base[a : a + rnd.choice([150, 195, 199, 200, 201, 205, 260, 300])] + some("pqrst", rnd.randint(0, 60)) for a in cut))
    texts += [some("xyz", rnd.randint(5, 300)) + base[100:320] + some("xyz", rnd.randint(5, 300)) for _ in range(200)]
    texts += [some("xyz", 100) + base[1000:1195] + rnd.choice("ab") * rnd.randint(1, 9) + some("xyz", 100) for _ in range(200)]
    rows = [(i, t, 1, 2, "x") for i, t in enumerate(texts)] + [(3, "x" * 5000, 1, 2, "x"), (None, base, None, None, None), (None, base, None, None, None), (None, None, None, None, None)]
    assert agrees(spark.createDataFrame(rows, EDGE)) > 0
    assert agrees(spark.createDataFrame(rows, EDGE), hot_rows=20) > 0  # windows compared over the boundaries of buckets
    assert agrees(spark.createDataFrame(rows[:12], EDGE), 50) > 0
    assert agrees(spark.createDataFrame([], EDGE)) == 0


def test_text_over_several_chunks(spark):
    rnd = random.Random(6)
    long = "".join(rnd.choice("abcdefgh") for _ in range(300_000))
    from quire.llm.suffix_dedup import without_repeats

    copy = "z" * 131_000 + long[130_950:131_400] + "y" * 10  # over the end of a chunk of both
    out = {r.doc_id: r for r in without_repeats(spark.createDataFrame([(1, long), (2, copy)], "doc_id long, text string")).collect()}
    assert bytes(out[1].kept).decode() == long[:130_950] + long[131_400:] and out[1].n_spans == 1
    assert bytes(out[2].kept) == b"y" * 10


def test_multikey_quicksort():
    from quire.llm.suffix_dedup import multikey_quicksort, words_of_bytes

    rnd = random.Random(7)
    strings = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 40))) for _ in range(2000)] + [b"", b"a" * 40, b"a" * 40]
    order, shared = multikey_quicksort(words_of_bytes(strings, 5))
    padded = [s.ljust(40, b"\0") for s in strings]
    assert [padded[i] for i in order] == sorted(padded)
    for before, at, n in zip(order[:-1], order[1:], shared[1:], strict=True):
        assert n == next((k for k in range(40) if padded[before][k] != padded[at][k]), 40)
    assert multikey_quicksort(np.empty((0, 3), np.uint64))[0].tolist() == []
