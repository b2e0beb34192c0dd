"""Words are cut where no piece crosses, and each part is segmented once."""

from __future__ import annotations

import public_tokenizers
from quire.llm.maxplus_pieces import Pieces


def test_parts_of_words_are_segmented_once(monkeypatch):
    p = Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    part, seen = p.part, []
    monkeypatch.setattr(p, "part", lambda w: seen.append(w) or part(w))
    odd = next(c for c in map(chr, range(0x2500, 0x2600)) if c not in p.score)
    word = f"▁hello{odd}hello{odd}hello"
    ids, score, same = p.word(word)
    assert sorted(set(seen)) == sorted(seen) == sorted(["▁hello", odd, "hello"])
    parts = [part(w) for w in ("▁hello", odd, "hello", odd, "hello")]
    assert ids == b"".join(x[0] for x in parts) and same
    assert abs(score - p.traced(word, 0, len(word), len(word))[1]) < 1e-9
    assert p.word("▁hello") == part("▁hello") and seen.count("▁hello") == 1
