"""Exact dedup with ids of any type, many rows without one, and filters in any number of blocks."""

from collections import Counter
from decimal import Decimal

import numpy as np
import pytest


@pytest.mark.parametrize(("kind", "of"), [("string", lambda i: f"id{i:02}"), ("long", lambda i: i - (1 << 63)), ("decimal(20,0)", Decimal)])
def test_ids(spark, kind, of):
    from quire.llm.cqf_dedup import exact_groups, without_copies

    texts = ["a b", "ab", "a  b", "c", None, "", "c", "x y z"]
    rows = [(of(i), t) for i, t in enumerate(texts)] + [(None, "n n")] * 400 + [(None, "a   b")]
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(5)
    out = exact_groups(df).collect()
    assert Counter((r.doc_id is None, r.kept) for r in out)[True, True] == 2 and len(out) == len(rows)
    by = {int(r.doc_id) if kind.startswith("dec") else r.doc_id: r for r in out if r.doc_id is not None}
    assert {k for k, r in by.items() if r.kept} == {of(3), of(4), of(7)}
    assert by[of(0)].keep_id is None and by[of(0)].group_size == 4 and by[of(6)].keep_id == of(3)
    kept = without_copies(df).collect()
    assert sorted(str(r.text) for r in kept) == ["None", "a   b", "c", "n n", "x y z"]


def test_blocks_of_filters(spark):
    from quire.llm import cqf_dedup as C

    rng = np.random.default_rng(4)
    fps = rng.integers(0, 1 << (C.QUOTIENT_BITS + C.REMAINDER_BITS), 3000)
    fps = np.concatenate([fps, fps[:500], fps[:100]])
    runs = C.merged_runs(fps >> C.REMAINDER_BITS, fps & ((1 << C.REMAINDER_BITS) - 1), np.ones(len(fps), np.int64))
    for bits in (6, 12, 20):
        rows = C._filter_rows(*runs, bits)
        assert rows["block"].is_unique and rows["block"].max() < 1 << bits
        again = C._merge((0,), rows)
        assert dict(zip(again["fp"], again["n"], strict=True)) == {int(f): 3 if k < 100 else 2 for k, f in enumerate(fps[:500])}
