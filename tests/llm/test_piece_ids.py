"""Ids of pieces against all segmentations of short texts."""

import random

import numpy as np
import public_tokenizers


def all_best(p, s):
    """Ids of the segmentation of greatest score, of ties the one whose last piece is longest, then the one before it, and so on."""
    best = None

    def go(at, cuts, score):
        nonlocal best
        if at == len(s):
            key = (score, [b - a for a, b in zip([0, *cuts], cuts, strict=False)][::-1])
            if best is None or key > best[0]:
                best = (key, list(cuts))
            return
        for j in range(at + 1, min(len(s), at + p.longest) + 1):
            piece = p.score.get(s[at:j])
            if piece or j == at + 1:
                go(j, [*cuts, j], score + (piece[0] if piece else p.unknown))

    go(0, [], 0.0)
    cuts = best[1]
    return [i for a, b in zip([0, *cuts], cuts, strict=False) for i in p.ids_of(s[a:b])], best[0][0]


def test_ids_of_short_texts(spark):
    from quire.llm.maxplus_pieces import SPACE, Pieces, encode_pieces

    model = public_tokenizers.path("piece_bpe_32k.model")
    p, r = Pieces.load(model), random.Random(9)
    texts = ["", " ", "the", "Hello", "aaaaaaa", "  a  b", "é☃x", "in the", "a\nb"] + ["".join(r.choice("atheinr s") for _ in range(r.randint(1, 9))) for _ in range(80)]
    out = {x.doc_id: x for x in encode_pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        ids, score = all_best(p, SPACE + t.replace(" ", SPACE)) if t else ([], 0.0)
        assert np.frombuffer(out[i].ids, "<u4").tolist() == ids and out[i].score == score, t


def test_chunks_give_the_ids_of_the_whole_text(spark):
    """Texts over many chunks, cut where no piece crosses, and one without such a place, whose score is that of the whole."""
    from quire.llm.maxplus_pieces import encode_pieces

    model, r = public_tokenizers.path("piece_bpe_32k.model"), random.Random(10)
    texts = [" ".join("".join(r.choice("atheinrs") for _ in range(r.randint(1, 12))) for _ in range(400)) for _ in range(6)] + ["a" * 900, "é☃" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def encoded(chunk):
        rows = {}
        for x in sorted(encode_pieces(df, model, chunk).collect(), key=lambda x: (x.doc_id, x.chunk)):
            ids, score, n = rows.get(x.doc_id, ([], 0.0, 0))
            rows[x.doc_id] = (ids + np.frombuffer(x.ids, "<u4").tolist(), score + x.score, n + 1)
            assert x.round_trip
        return rows

    whole, parts, small = encoded(100_000), encoded(500), encoded(64)
    for i in whole:
        assert whole[i][1] == parts[i][1] == small[i][1] and whole[i][2] == 1 < parts[i][2] < small[i][2]
        assert i == 6 or whole[i][0] == parts[i][0] == small[i][0]
