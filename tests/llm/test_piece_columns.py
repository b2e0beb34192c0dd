"""Words of one length are segmented together, as each would be alone."""

import random
from array import array

import public_tokenizers
from quire.llm.maxplus_pieces import SPACE, Pieces


def test_words_together_are_as_alone_and_few_go_alone(monkeypatch):
    p = Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(5)
    pieces = [s for s in p.score if SPACE not in s]
    letters = "etaoinshrdluETAOIN0123456789.,-()é本語の"
    words = {SPACE + "".join(rng.choices(letters, k=rng.randrange(0, 14))) for _ in range(3000)} | {SPACE + "".join(rng.choices(pieces, k=rng.randrange(1, 6))) for _ in range(3000)}
    words |= {SPACE + "a" * k for k in range(1, 300)} | {SPACE + "x\U0001f600y\ud800" + c for c in letters}
    texts = ["".join(rng.choices(sorted(words), k=40)) for _ in range(300)] + ["", SPACE, "".join(sorted(words))]
    alone = [p.words(t) for t in texts]
    calls, forward = [], Pieces.forward
    monkeypatch.setattr(Pieces, "forward", lambda self, s, *a: calls.append(s) or forward(self, s, *a))
    p.known.clear()
    assert list(p.texts(texts)) == alone
    assert len(calls) < 1000  # unknown characters, lengths of few words and words of more than 256 characters
    for w in rng.sample(sorted(w for w in words if len(w) <= 256 and p.pairs.issuperset(map(str.__add__, w, w[1:]))), 200):
        ids, score = p.traced(w, 0, len(w), len(w))
        assert p.known[w][:2] == (array("I", ids).tobytes(), score)
