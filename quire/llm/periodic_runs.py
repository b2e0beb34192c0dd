"""Periodic runs of words: maximal repetitions of four periods or more, by recompression.

A stretch with period q in which at least 3 q words equal the word q later holds three neighbouring
points of the grid of multiples of q that do so. These grids, over all q together, have n log n
points; the three equal points in a row are the candidates. Texts with candidates are compressed
into a run-length grammar: blocks of one symbol become a symbol, then pairs whose left symbol has
an even hash and right one an odd hash, and so on until one symbol is left. Equal stretches are
parsed alike but for their ends, so how far two places agree, to the right and to the left, is found
by one walk up and down the levels: that is the exact extent of each candidate.

A batch of texts is one sequence with separators that occur once, and all its candidates walk
together, so the work is in array operations. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, let, words_of

#: Words of one batch (a longer text is a batch of its own) and candidates that walk together.
BATCH_WORDS, WALK = 1 << 19, 1 << 18
#: Least number of periods, and of words, of a run.
PERIODS, WORDS = 4, 6
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Level:
    """One step of the compression. ``below`` are the symbols that it took, ``first`` the place there of each
    new symbol and of the end, ``parent`` the new symbol at or before each place, with one for the end."""

    blocks: bool
    below: np.ndarray
    first: np.ndarray
    parent: np.ndarray


def _step(symbols: np.ndarray, begins: np.ndarray, blocks: bool, fresh: int) -> tuple[Level, np.ndarray, int]:
    """The level whose symbols begin where ``begins`` is set, its symbols, and the next unused symbol."""
    first = np.append(np.flatnonzero(begins), len(symbols))
    sizes = np.diff(first)
    head = symbols[first[:-1]]
    many = sizes > 1
    tail = sizes[many] if blocks else symbols[first[:-1][many] + 1]
    made, which = np.unique(head[many] * (max(int(tail.max(initial=0)), fresh) + 1) + tail, return_inverse=True)
    head[many] = fresh + which
    parent = np.append(np.cumsum(begins) - 1, len(head))
    return Level(blocks, symbols, first, parent), head, fresh + len(made)


def grammar(symbols: np.ndarray) -> list[Level]:
    """Levels of the recompression of ``symbols`` (whole numbers from 0), down to one symbol."""
    levels, fresh = [], int(symbols.max(initial=0)) + 1
    while len(symbols) > 1:
        begins = np.r_[True, symbols[1:] != symbols[:-1]]
        if not begins.all():
            level, symbols, fresh = _step(symbols, begins, True, fresh)
            levels.append(level)
        odd = ((symbols.astype(np.uint64) + np.uint64(len(levels))) * _MIX >> np.uint64(63)).astype(bool)
        begins = ~np.r_[False, ~odd[:-1] & odd[1:]]
        if begins.all():  # no pair by these hashes: others
            odd = ~odd
            begins = ~np.r_[False, ~odd[:-1] & odd[1:]]
        level, symbols, fresh = _step(symbols, begins, False, fresh)
        levels.append(level)
    return levels


def agree(levels: list[Level], i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
    """How many symbols from the places ``i`` and ``j`` on (before them, if ``back``) are equal. Between two
    different places there must be a symbol that occurs once."""
    a, b = i.copy(), j.copy()
    depth = np.full(len(a), len(levels))
    at, way = (1 if back else 0), (-1 if back else 1)
    open_ = np.arange(len(a))
    for k, level in enumerate(levels):
        x, y = a[open_], b[open_]
        px, py = level.parent[x], level.parent[y]
        up = (level.first[px] == x) & (level.first[py] == y)
        same = up | (level.below[x - at] == level.below[y - at])
        go = same & ~up
        ends = np.zeros(len(x), bool)
        if level.blocks:
            u, v = x[go], y[go]
            far = lambda z: z - level.first[level.parent[z - 1]] if back else level.first[level.parent[z] + 1] - z
            m, n = far(u), far(v)
            step = way * np.minimum(m, n)
            ends[go] = m != n
        else:
            step = way
        x[go] += step
        y[go] += step
        stop = ends | ~same
        depth[open_[stop]] = k
        on = ~stop
        a[open_], b[open_] = np.where(on, level.parent[x], x), np.where(on, level.parent[y], y)
        open_ = open_[on]
    for k in range(len(levels), 0, -1):
        now = np.flatnonzero(depth == k)
        if not len(now):
            continue
        level = levels[k - 1]
        x, y = level.first[a[now]], level.first[b[now]]
        same = level.below[x - at] == level.below[y - at]
        if level.blocks:
            size = np.diff(level.first)
            m = np.minimum(size[a[now] - at], size[b[now] - at])
            step = np.where(same, way * m, 0)
        else:
            step = way * same.astype(np.int64)
        a[now], b[now] = x + step, y + step
        depth[now] = k - 1
    return np.abs(a - i)


def candidates(words: np.ndarray, text: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of grid points in the sequence ``words``, of texts numbered ``text``, that may be in a run."""
    places, periods = [], []
    for q in range(1, longest // PERIODS + 1):
        x = words[::q]
        same = x[1:] == x[:-1]
        hit = np.flatnonzero(same[2:] & same[1:-1] & same[:-2])
        if len(hit):
            places.append(hit * q)
            periods.append(np.full(len(hit), q))
    if not places:
        return (np.empty(0, np.int64),) * 2
    place, period = np.concatenate(places), np.concatenate(periods)
    within = text[place] == text[place + 3 * period]
    return place[within], period[within]


def runs_of(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text, a text being the codes (from 0) of its words, in order
    of start and period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts])
    if not len(texts) or sizes.max() < WORDS:
        return out
    low = len(texts) + 1  # the codes below are separators, before, between and behind the texts
    laid = np.concatenate([part for k, t in enumerate(texts) for part in ([k], t + low)] + [[low - 1]]).astype(np.int64)
    number = np.append(np.repeat(np.arange(len(texts)), sizes + 1), len(texts))
    place, period = candidates(laid, number, int(sizes.max()))
    if not len(place):
        return out
    wanted = np.zeros(len(texts) + 1, bool)
    wanted[number[place]] = True
    inside = wanted[number]
    shift = np.cumsum(inside) - 1  # places among the texts with candidates
    levels = grammar(np.append(laid[inside], low - 1))
    begins = np.cumsum(np.r_[0, sizes + 1])[:-1] + 1
    found: dict[tuple[int, int], int] = {}
    for c in range(0, len(place), WALK):
        p, q = shift[place[c : c + WALK]], period[c : c + WALK]
        ahead, behind = agree(levels, p, p + q), agree(levels, p, p + q, back=True)
        length = behind + ahead + q
        run = length >= np.maximum(WORDS, PERIODS * q)
        start = place[c : c + WALK][run] - behind[run]
        for s, n, k in set(zip(start.tolist(), length[run].tolist(), q[run].tolist(), strict=True)):
            found[s, n] = min(k, found.get((s, n), k))  # a multiple of the smallest period has the same extent
    for (s, n), q in sorted(found.items()):
        k = number[s]
        out[k].append((int(s - begins[k]), n, q))
    for rows in out:
        rows.sort(key=lambda r: (r[0], r[2]))
    return out


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _best(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length / period, then least start, then least period."""
    best = None
    for s, n, q in runs:
        if best is None or n * best[2] > best[1] * q or (n * best[2] == best[1] * q and (s, q) < (best[0], best[2])):
            best = (s, n, q)
    return best


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for s, n, q in runs:
        keep[s + q : s + n] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUNS = "n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, best struct<start:bigint,length:bigint,period:bigint>, collapsed binary"


def _batch(ids: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
    codes = _Codes()
    runs = runs_of([np.fromiter(map(codes.__getitem__, t), np.int64, len(t)) for t in texts])
    as_row = lambda r: None if r is None else dict(zip(("start", "length", "period"), r, strict=True))
    columns = [ids, pa.array([len(t) for t in texts], pa.int64()), pa.array([[as_row(r) for r in rows] for rows in runs], pa.list_(_RUN))]
    columns += [pa.array([as_row(_best(rows)) for rows in runs], _RUN), pa.array([_collapsed(t, rows) for t, rows in zip(texts, runs, strict=True)], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "best", "collapsed"])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        start, held, size = 0, [], 0
        for k, body in enumerate(b.column(1).to_pylist()):
            words = body.split()  # at ASCII white space
            if held and size + len(words) > BATCH_WORDS:
                yield _batch(b.column(0).slice(start, k - start), held)
                start, held, size = k, [], 0
            held.append(words)
            size += len(words)
        if held:
            yield _batch(b.column(0).slice(start), held)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs, best and collapsed of each row of ``docs`` (doc_id, text).

    A run is a maximal stretch of words with smallest period q and at least max(6, 4 q) words;
    ``runs`` holds (start, length, period) by start, then period, and ``best`` that of greatest
    length / period, ties to the least start, then period, or null. ``collapsed`` is the text in
    UTF-8, without the words of each run after its first q, joined by single spaces. Null, empty and
    short texts have no runs; repeated rows are each answered; a null doc_id stays null; other
    columns are not looked at, and an empty table gives none.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("body")).mapInArrow(_find, f"doc_id {kind}, {RUNS}")


def with_planted_period(docs: DataFrame) -> DataFrame:
    """doc_id and text of ``docs``, where in each tenth row, by the CRC-32 of its doc_id (of nothing, if null),
    the words from one place on repeat a few words of the text."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10).cast("long")

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        return let(F.struct(words.alias("w"), a.alias("a"), (1 + F.floor((n - a) / (3 + g % 8))).alias("p")), _from_place)

    def _from_place(x: Column) -> Column:
        i = F.sequence(F.lit(0), F.size(x["w"]) - 1)
        word = lambda k: F.when(k < x["a"], F.get(x["w"], k)).otherwise(F.get(x["w"], (x["a"] + (k - x["a"]) % x["p"]).cast("int")))
        return F.array_join(F.transform(i, word), " ")

    some = F.col("text").rlike(f"[^{WS}]")
    return docs.select("doc_id", F.when((h % 10 == 0) & some, let(words_of(F.col("text")), repeated)).otherwise(F.col("text")).alias("text"))


def run_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the best run's start, length, period and exponent_milli, and SHA-256 of the list of runs
    and of the collapsed text, for each row of ``docs`` with planted periods."""
    found = periodic_runs(with_planted_period(docs))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    best = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")]
    milli = F.expr("1000 * best.length div best.period").alias("exponent_milli")
    runs = F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *best, milli, runs, F.sha2("collapsed", 256).alias("collapsed_sha256"))
