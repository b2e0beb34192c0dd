"""Ids beyond the whole numbers of a float, nulls beside them, clashing names and rows of one id."""

import random

import public_tokenizers
import pytest

BIG = [9007199254740993, None, 9007199254740995]
TEXTS = ["one two three four five. " * 4, "password=hunter22x9 and more words here", "ein Haus und ein Baum stehen hier. " * 3]


@pytest.fixture(scope="module")
def big(spark):
    return spark.createDataFrame([(i, t, "en", "s", None, i) for i, t in zip(BIG, TEXTS, strict=True)], "doc_id long, text string, lang string, source string, n_chars long, other long")


def ids(df, name="doc_id"):
    return sorted({r[name] for r in df.select(name).collect()}, key=lambda x: (x is None, x))


def test_large_ids_beside_nulls(big, spark):
    from quire.llm.host_consensus import extract_pages
    from quire.llm.langid import identify
    from quire.llm.maxplus_pieces import encode_pieces
    from quire.llm.ngram_jaccard import jaccard_components, one_of_each
    from quire.llm.packing import pack
    from quire.llm.role_repair import repair_conversations
    from quire.llm.secret_scan import mask_secrets, scan_secrets
    from pyspark.sql import functions as F

    want = sorted(BIG, key=lambda x: (x is None, x))
    pages = big.select(F.col("doc_id").alias("page_id"), F.lit("http://h.example/").alias("url"), F.concat(F.lit("<p>"), "text").alias("html"))
    assert ids(extract_pages(pages), "page_id") == want
    assert ids(jaccard_components(big)) == want and ids(one_of_each(big)) == want
    model = public_tokenizers.path("piece_bpe_32k.model")
    assert ids(encode_pieces(big, model)) == want and ids(encode_pieces(big, model, chunk=30)) == want
    assert ids(scan_secrets(big)) == want and ids(pack(big, public_tokenizers.path("byte_bpe_50k.json"))) == want
    assert ids(identify(big.withColumn("held_out", F.lit(True)), big)) == want
    masked = mask_secrets(big)
    assert ids(masked) == want and ids(masked, "other") == want and masked.schema == big.schema
    turns = big.select(F.col("doc_id").alias("conv_id"), F.col("doc_id").alias("turn"), F.lit("user").alias("role"), "text")
    out = repair_conversations(turns)
    assert out.count() == 3 and ids(out, "conv_id") == want and ids(out, "turn") == want


def test_stages_with_clashing_names(spark):
    from quire.llm.cqf_dedup import without_copies
    from quire.llm.ngram_jaccard import one_of_each

    a, b = "alpha beta gamma delta epsilon zeta eta theta " * 3, "one two three four five six seven eight nine"
    rows = [(2, a), (1, a), (2, b), (2, b)]
    names = ["_id", "_gone", "_hash", "_number", "gone_id", "GONE_HASH", "gone_number", "key", "node", "sig"]
    df = spark.createDataFrame([(*r, *names) for r in rows], ["doc_id", "text", *names])
    for stage in (without_copies, one_of_each):
        out = stage(df)
        assert out.columns == df.columns and sorted((r.doc_id, r.text) for r in out.collect()) == [(1, a), (2, b)]


def test_jaccard_templates(spark):
    """A thousand short documents that share one frequent pair of tokens, and two hundred with half of a template."""
    from quire.llm.ngram_jaccard import jaccard_components

    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    head, half = " ".join(word() for _ in range(4)), " ".join(word() for _ in range(40))
    texts = [f"{head} " + " ".join(word() for _ in range(12)) for _ in range(1000)]
    texts += [f"{half} " + " ".join(word() for _ in range(r.choice([1, 2, 3, 30]))) for _ in range(200)]
    out = {x.doc_id: x.component_id for x in jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, 90).collect()}
    sets = [set(zip(w, w[1:], w[2:], strict=False)) for w in map(str.split, texts)]
    near = [i for i in range(1000, 1200) if len(sets[i]) < 50]
    assert all(out[i] == i for i in range(1200) if i not in near)
    parent = {i: i for i in near}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for i in near:
        for j in near:
            n = len(sets[i] & sets[j])
            if i < j and 100 * n >= 90 * (len(sets[i]) + len(sets[j]) - n):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    assert {i: out[i] for i in near} == {i: find(i) for i in near}


def test_shards_with_many_nulls(spark):
    from quire.llm.minimax_shards import minimax_shards

    rows = [(i, None) for i in range(4000)] + [(i, f"{i:010}") for i in range(4000, 6000)]
    load, nulls = {}, set()
    for r in minimax_shards(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        load[r.shard] = load.get(r.shard, 0) + r["size"]
        if r["size"] == 1:
            nulls.add(r.shard)
    assert len(nulls) == 1 and max(load.values()) - 26000 / 8 <= 1000 and sum(load.values()) == 26000


def test_host_contract():
    from quire.llm.host_consensus import extract

    body = "Long, main text. " * 20
    page = f'<html><body><main><p>{body}</p><p>Hello <span class="ad">x</span> world <a class="share" href="y">tweet</a>!</p><article class="comment"><p>Nice post, I like it.</p></article></main></body></html>'
    assert extract(page, ["html>body>main"]) == body.strip() + "\nHello world !"
    assert extract(f"<body><article class='post'><p>{body}</p></article></body>", []) == body.strip()


def test_language_slices():
    import numpy as np

    from quire.llm.langid import _ngrams

    text = "Über die Brücke gehen wir 中文 heute. " * 5
    whole = np.sort(np.concatenate(list(_ngrams(text))))
    for chars in (1, 7, 50):
        assert np.array_equal(np.sort(np.concatenate(list(_ngrams(text, chars)))), whole)


def test_learnt_words(spark):
    from quire.llm.secret_scan import RANK, guess_cost, learnt_ranks, scan_secrets

    docs = spark.createDataFrame([(i, "Quillon (brombeer), zelthaus. pass: quillonbrombeerzelthaus9 pwd: XkQzPwLmNtRvBsDfGh") for i in range(5)] + [(9, None), (10, "")], "doc_id long, text string")
    ranks = learnt_ranks(docs)
    assert ranks["quillon"] > len(RANK) and ranks["password"] == 1 and "zelthaus" in ranks and "brombeer" in ranks
    assert "xkqzpwlmntrvbsdfgh" not in ranks and len(learnt_ranks(docs, 1)) == len(RANK) + 0
    out = {r.doc_id: r.n_guess for r in scan_secrets(docs).collect()}
    assert len(out) == 7 and out[9] == 0
    assert guess_cost("quillonbrombeerzelthaus", ranks) < 8 < guess_cost("quillonbrombeerzelthaus")


def test_states_by_tree(spark):
    """States of a tree of matrices have the best total score, whatever the fan."""
    import numpy as np

    from quire.llm.maxplus_pieces import boundary_states, chunk_states

    rng = np.random.default_rng(3)
    docs = {row: [rng.integers(-50, 0, (4, 4)).astype(float) for _ in range(n)] for row, n in ((1, 1), (2, 2), (3, 9), (4, 40))}
    df = spark.createDataFrame([(row, i, m.ravel().tolist()) for row, ms in docs.items() for i, m in enumerate(ms)], "row long, at long, matrix array<double>")
    total = lambda ms, states: sum(m[a, b] for m, (a, b) in zip(ms, states, strict=True))
    for fan in (2, 3, 16):
        got = {}
        for r in chunk_states(df, fan).orderBy("at").collect():
            got.setdefault(r["row"], []).append((r.entry, r.leave))
        for row, ms in docs.items():
            states = got[row]
            assert states[0][0] == 0 and states[-1][1] == 0 and all(x[1] == y[0] for x, y in zip(states, states[1:], strict=False))
            assert total(ms, states) == total(ms, boundary_states(ms))
    assert chunk_states(df.limit(0)).count() == 0


def test_conversation_without_numbers(spark):
    """Rows with one or no turn number and without a conversation are cut into bounded parts."""
    from quire.llm.role_repair import repair_conversations

    roles = ["user", "assistant"]
    rows = [(None, None, roles[i % 2], f"t{i:04}") for i in range(700)] + [(5, 3, roles[i % 2], "same") for i in range(300)] + [(6, i, roles[i % 2], "x") for i in range(200)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(7)
    out = repair_conversations(df).collect()
    assert len(out) == 1200
    sizes = {}
    for r in out:
        sizes[r.conv_id, r.block, r.part] = sizes.get((r.conv_id, r.block, r.part), 0) + 1
    assert max(sizes.values()) == 64 and len([k for k in sizes if k[0] is None]) == 11
    cost = lambda c: sum(r.cost for r in out if r.conv_id == c)
    whole = {c: sum(r.cost for r in repair_conversations(df.filter(f"conv_id <=> {'null' if c is None else c}"), 10_000).collect()) for c in (None, 5, 6)}
    assert all(abs(cost(c) - w) < 1e-6 for c, w in whole.items())
