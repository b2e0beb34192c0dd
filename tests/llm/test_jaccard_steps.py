"""How much the steps of the similarity join leave to the next one."""

import random


def test_sets_alike_by_chance_are_told_by_prefixes(spark, monkeypatch):
    """Documents of which half is found elsewhere, each part in another one, have no partner; a growing
    corpus has ever more of them. Their whole sets are not written and counted."""
    from quire.llm import ngram_jaccard

    r = random.Random(11)
    prose = lambda n: ["".join(r.choices("abcdefghij", k=7)) for _ in range(n)]
    pool = [prose(25) for _ in range(40)]
    words = [sum((x for _ in range(8) for x in (r.choice(pool), prose(25))), []) for _ in range(200)]
    for i in range(10):  # one word of 400 differs
        words.append([*words[i][:200], "other", *words[i][201:]])
    texts = list(enumerate(map(" ".join, words)))

    rows, write = {}, ngram_jaccard.written

    def counted(df, name, *partition_by):
        out = write(df, name, *partition_by)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(ngram_jaccard, "written", counted)
    out = {x.doc_id: x.component_id for x in ngram_jaccard.jaccard_components(spark.createDataFrame(texts, "doc_id long, text string"), 3, 90).collect()}
    assert out == {i: i - 200 if i >= 200 else i for i in range(210)}
    assert 20 <= rows["jaccard-sets"] < 60
