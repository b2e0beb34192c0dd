"""The rendering of a conversation is put together from its rows."""

import random


def rendered(spark, rows, **more):
    from quire.llm.role_repair import repair_conversations

    out = repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3), **more).collect()
    assert len(out) == len(rows) and len({(r.conv_id, r.block, r.part, r.position) for r in out}) == len(out)
    texts = {}
    for r in sorted(out, key=lambda r: (r.conv_id, r.block, r.part, r.position)):
        texts[r.conv_id] = texts.get(r.conv_id, "") + r.rendered
    return texts


def test_turns_of_one_number(spark):
    text = rendered(spark, [(1, 1, "user", "first"), (1, 1, "user", "second"), (1, 2, "assistant", "answer")])[1]
    assert text == "<|user|>\nfirst\nsecond<|end|>\n<|assistant|>\nanswer<|end|>\n"


def test_blocks_and_parts_in_order(spark):
    r = random.Random(1)
    rows = [(c, t // 2, ("user", "assistant")[t % 2], f"c{c}t{t:04}") for c in range(3) for t in range(300)]
    rows += [(7, 5, "user", f"same {i:04}") for i in range(400)]  # one turn number, over many parts
    r.shuffle(rows)
    whole, parts = rendered(spark, rows), rendered(spark, rows, block=8)
    assert whole == parts
    places = [whole[7].index(f"same {i:04}") for i in range(400)]
    assert places == sorted(places) and whole[7].count("<|user|>") == 1
