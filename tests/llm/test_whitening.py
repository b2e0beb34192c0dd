"""Whitening against the eigenvectors of the covariance, formed from exact differences."""

from collections import Counter, defaultdict

import numpy as np
import pytest

EDGE = "vec_id long, embedding array<float>, label int, x int, v string"


def agrees(df, width=None):
    from quire.llm.whitening import whiten

    kept = [r for r in df.collect() if r.embedding and all(c is not None and np.isfinite(c) for c in r.embedding)]
    if width:
        kept = [r for r in kept if len(r.embedding) == width]
    x = np.floor(64 * np.array([r.embedding for r in kept], float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    apart = x * n - sums
    centred = apart / n
    v = centred.T @ centred / n
    e = np.sort(np.linalg.eigvalsh(v))[::-1]
    out = whiten(df).collect()
    k = min(32, x.shape[1])
    assert Counter((r.vec_id, r.component, r.deviation) for r in out) == Counter((r.vec_id, c, int(d)) for r, d in zip(kept, (apart**2).sum(axis=1), strict=True) for c in range(1, k + 1))
    assert {r.n for r in out} == {n}
    live = [c for c in range(k) if e[c] > 1e-13 * e.sum()]
    near = lambda c: max(1e-9, 1e-14 * e[0] / e[c])  # noqa: E731  # rounding of the covariance that is formed here
    columns = defaultdict(dict)
    for r in out:
        if r.component - 1 in live:
            assert r.explained == pytest.approx(e[r.component - 1] / e.sum(), rel=near(r.component - 1)) and r.identity_error < 1e-9
            columns[r.component - 1][r.vec_id] = r.whitened
        else:
            assert r.whitened is None and abs(r.explained) < 1e-12
    z = np.array([[columns[c][r.vec_id] for c in live] for r in kept])
    assert np.abs(z.T @ z / n - np.eye(len(live))).max() < 1e-9 and np.abs(z.mean(axis=0)).max() < 1e-9
    back = centred.T @ z / n  # V times the component, over sqrt(e): the component times sqrt(e)
    for c in range(len(live)):
        unit = back[:, c] / e[c] ** 0.5
        assert np.linalg.norm(unit) == pytest.approx(1, abs=near(c))
        assert np.abs(v @ unit - e[c] * unit).max() < 1e-9 * e[0]
    return out


def test_whole_table(spark, sf):
    assert len(agrees(spark.read.parquet(f"{sf}/embeddings.parquet"))) == 500 * 32


def test_ill_conditioned_and_without_variance(spark):
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(300, 10)) * 10.0 ** np.arange(4, -6, -1)
    rows[:, 8] = rows[:, 2]  # a direction without variance
    rows[:, 9] = 7
    agrees(spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(rows)], "vec_id long, embedding array<double>").repartition(3))


def test_edges(spark):
    rng = np.random.default_rng(3)
    good = [[float(np.float32(c)) for c in r] for r in rng.normal(size=(40, 5))]
    bad = [None, [], [1.0, None, 2.0, 3.0, 4.0], [1.0, float("nan"), 2.0, 3.0, 4.0], [float("inf")] * 5, [float("-inf"), 1.0, 1.0, 1.0, 1.0], [None] * 5]
    rows = [(i, v, 0, 1, "x") for i, v in enumerate(good + bad)]
    agrees(spark.createDataFrame(rows + [(900, [1.0, 2.0], 0, 1, "x")], EDGE), width=5)
    agrees(spark.createDataFrame(rows, EDGE))

    from quire.llm.whitening import whiten

    twice = whiten(spark.createDataFrame(rows + rows[:1] + [(None, good[1], None, None, None)], EDGE)).collect()
    assert len(twice) == 42 * 5 and {r.n for r in twice} == {42} and sum(r.vec_id is None for r in twice) == 5
    assert whiten(spark.createDataFrame([], EDGE)).count() == 0
    assert whiten(spark.createDataFrame(rows[40:], EDGE)).count() == 0
    one = whiten(spark.createDataFrame(rows[:1], EDGE)).collect()
    assert [(r.component, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(c, 0, None, None, None) for c in range(1, 6)]
