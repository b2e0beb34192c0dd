"""What Python workers hold: the parts that packing remembers, and the texts taken from a batch at once."""

import tracemalloc

import pyarrow as pa
import public_tokenizers
from quire.llm import packing
from quire.llm.common import slices


def test_slices_are_all_rows_in_order_and_bounded():
    texts = ["a" * 700_000, None, "", "ä" * 300_000, "b" * 2_500_000, "c", None]
    batch = pa.RecordBatch.from_pydict({"n": list(range(7)), "text": texts})
    cut = list(slices(batch))
    assert [n for s in cut for n in s.column("n").to_pylist()] == list(range(7))
    sizes = [[len((t or "").encode()) for t in s.column("text").to_pylist()] for s in cut]
    assert max(sum(s) - max(s) for s in sizes) <= 1_000_000 and len(cut) == 3
    assert sum(s.num_rows for s in slices(batch.slice(0, 0))) == 0
    assert [s.num_rows for s in slices(batch.slice(1, 2))] == [2]


def test_packing_forgets_parts_of_texts_long_past():
    packing._TOKENIZERS.clear()
    encode = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    word = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(5))
    tracemalloc.start()
    try:
        first = encode([" ".join(map(word, range(20_000)))])
        for k in range(20_000, 700_000, 20_000):
            encode([" ".join(map(word, range(k, k + 20_000)))])
        assert tracemalloc.get_traced_memory()[0] < 70 << 20
    finally:
        tracemalloc.stop()
    assert encode([" ".join(map(word, range(20_000)))]) == first
