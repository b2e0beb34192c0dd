"""Suffix-array dedup: bytes covered by a string of ``length`` bytes that starts anywhere else as well.

Every window of ``length`` bytes has an anchor: the leftmost of its GRAM-byte strings of least hash.
Equal windows have equal anchors at equal places, so the suffixes that start at anchors, with the
bytes before them, are a sparse suffix array that misses no pair of equal windows. What one anchor
stands for, from its first window's first byte to its last window's last, is its passage.

1. Anchors whose first GRAM bytes occur once have no partner. Of the others, passages that occur
   twice are repeated as a whole, by 128 bits of hashes. Both are counts with map-side sums.
2. One of each distinct passage that is left is a suffix: sampled splitters range-partition them by
   their leading GRAM bytes, and those of which more than HOT_ROWS share these by all their bytes. A
   bucket sorts its suffixes by multikey quicksort, and the bytes before them, read backwards, too.
   Windows are equal where neighbours in both orders agree far enough.
3. Only such frequent ones can go on over a boundary: where they are the first or last of a bucket,
   each of their distinct windows is range-partitioned, sorted and compared with its neighbour in
   the same way, and the first and last of each bucket with those of the other buckets. So a
   passage that a third of all documents hold is spread over as many buckets as it fills.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, written

#: Bytes that two suffixes must share to be compared; bits of a place in a chunk of a column of texts.
GRAM, PLACE_BITS = 40, 17
#: Suffixes and windows to a bucket on average, and suffixes with one gram that stay in one bucket.
BUCKET_ROWS, HOT_ROWS = 100_000, 20_000
ANCHORS = "fp long, ph long, k1 long, k2 long, first int, at int, last int"
SUFFIXES = "k1 long, k2 long, n long, first int, at int, last int, hot boolean, ahead binary, behind binary"
FOUND = "k1 long, k2 long, start int, stop int, win binary, alone boolean"
_U = np.uint64
_STEP = int.from_bytes(hashlib.sha256(b"step").digest()[:8], "little") | 1


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base % 2**64, _U)
    p[0] = 1
    return np.cumprod(p, dtype=_U)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Odd values of the 256 bytes; powers of the base and of its inverse."""
    values = np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:8], "little") | 1 for b in range(256)], _U)
    n = (1 << PLACE_BITS) + 1
    return values, _powers(_STEP, n), _powers(pow(_STEP, -1, 2**64), n)


def anchors(data: np.ndarray, ends: np.ndarray, length: int, tables: tuple) -> Iterator[tuple[np.ndarray, ...]]:
    """(hash of the gram, hash of the passage, text, first window, anchor, last window) of each anchor in
    ``data``, texts back to back that stop at ``ends``, chunk by chunk; places count from the text's first byte."""
    values, power, inverse = tables
    begins, size, reach = np.r_[0, ends[:-1]], 1 << PLACE_BITS, length - GRAM + 1
    for c in range(0, max(1, len(data) - length + 1), size - length + 1):
        chunk = data[c : c + size]
        n = len(chunk)
        if n < length:
            return
        sums = np.zeros(n + 1, _U)
        np.cumsum(values[chunk] * power[:n], out=sums[1:])
        gram = (sums[GRAM:] - sums[:-GRAM]) * inverse[: n - GRAM + 1]
        gram ^= gram >> _U(29)
        low = (gram >> _U(PLACE_BITS) << _U(PLACE_BITS)) | np.arange(len(gram), dtype=_U)
        span = 1
        while 2 * span <= reach:  # least of 2 * span grams from each place on
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < reach:
            low = np.minimum(low[: span - reach], low[reach - span :])
        place = np.arange(c, c + len(low))
        text = np.searchsorted(ends, place, "right")
        fits = np.flatnonzero(place + length <= ends[text])
        if not len(fits):
            continue
        at = (low[fits] & _U(size - 1)).astype(np.int64)
        edge = np.flatnonzero(np.r_[True, at[1:] != at[:-1], True])
        first, last, at = fits[edge[:-1]], fits[edge[1:] - 1], at[edge[:-1]]
        whole = (sums[last + length] - sums[first]) * inverse[first]
        whole = (whole ^ (whole >> _U(31))) * _U(_STEP) + (last - first).astype(_U) * _U(length) + (at - first).astype(_U)
        text, shift = text[first], c - begins[text[first]]
        yield gram[at].view(np.int64), whole.view(np.int64), text, first + shift, at + shift, last + shift


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a column without nulls and where each value ends."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]


def _scan(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    tables = _tables()
    for b in batches:
        if not len(b):
            continue
        k1, k2 = (b.column(k).to_numpy() for k in (0, 1))
        for fp, ph, text, first, at, last in anchors(*_bytes_of(b.column(2)), length, tables):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (fp, ph, k1[text], k2[text], *(x.astype(np.int32) for x in (first, at, last)))], names=["fp", "ph", "k1", "k2", "first", "at", "last"])


def _cut_out(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Suffixes with the bytes ahead of and, backwards, behind their anchors."""
    for b in batches:
        out = []
        for k1, k2, text, wanted in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            for r in wanted:
                first, at, last = r["first"], r["at"], r["last"]
                out.append((k1, k2, r["n"], first, at, last, r["hot"], text[at : last + length], text[first:at][::-1]))
        if out:
            kinds = [pa.int64()] * 3 + [pa.int32()] * 3 + [pa.bool_()] + [pa.binary()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["k1", "k2", "n", "first", "at", "last", "hot", "ahead", "behind"])


def words_of_bytes(strings: list[bytes], width: int) -> np.ndarray:
    """Rows of big-endian words of eight bytes, filled up with zeros to ``width`` words."""
    joined = b"".join(s.ljust(8 * width, b"\0") for s in strings)
    return np.frombuffer(joined, ">u8").reshape(-1, width).astype(_U)


def multikey_quicksort(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of ``words``, and the bytes that each row in that order shares with the row before.

    Each segment of rows that agree so far takes its middle row's next word as pivot and parts into
    less, equal and greater; the equal part goes on with the next word. All segments that are still
    open part at the same time, so a step is a few array operations. The first row shares none.
    """
    n, width = words.shape
    order, shared = np.arange(n), np.zeros(n, np.int64)
    starts, sizes, depth = (np.array([0]), np.array([n]), np.array([0])) if n > 1 else (np.empty(0, int),) * 3
    while len(starts):
        owner = np.repeat(np.arange(len(starts)), sizes)
        place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[owner]
        rows = order[place]
        word = words[rows, depth[owner]]
        pivot = words[order[starts + sizes // 2], depth]
        side = (word > pivot[owner]).astype(np.int8) - (word < pivot[owner])
        part = owner * 3 + side + 1
        by = np.argsort(part, kind="stable")
        order[place] = rows[by]
        count = np.bincount(part, minlength=3 * len(starts))
        begin = (np.cumsum(count.reshape(-1, 3), axis=1) - count.reshape(-1, 3) + starts[:, None]).ravel()
        deeper = np.repeat(depth, 3) + np.tile([0, 1, 0], len(starts))
        open_ = (count > 1) & (deeper < width)
        starts, sizes, depth = begin[open_], count[open_], deeper[open_]
    if n > 1:
        a, b = words[order[:-1]], words[order[1:]]
        differ = a != b
        at = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        pick = np.minimum(at, width - 1)
        x = a[np.arange(n - 1), pick] ^ b[np.arange(n - 1), pick]
        same = np.zeros(n - 1, np.int64)
        for k in range(1, 8):  # leading bytes in common within the word
            same += (x >> _U(64 - 8 * k)) == 0
        shared[1:] = np.where(at == width, 8 * width, 8 * at + same)
    return order, shared


def _stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first column, last column) of each stretch of set flags."""
    wide = np.pad(flags, ((0, 0), (1, 1)))
    rise, fall = wide[:, 1:] & ~wide[:, :-1], ~wide[:, 1:] & wide[:, :-1]
    row, begin = np.nonzero(rise)
    return row, begin, np.nonzero(fall)[1] - 1


def _found(k1, k2, start, stop, win=None, alone=None) -> pa.RecordBatch:
    n = len(k1)
    columns = [pa.array(np.asarray(k1), pa.int64()), pa.array(np.asarray(k2), pa.int64()), pa.array(np.asarray(start), pa.int32()), pa.array(np.asarray(stop), pa.int32())]
    columns += [pa.array(win, pa.binary()) if win is not None else pa.nulls(n, pa.binary()), pa.array(alone, pa.bool_()) if alone is not None else pa.nulls(n, pa.bool_())]
    return pa.RecordBatch.from_arrays(columns, names=["k1", "k2", "start", "stop", "win", "alone"])


def _all_rows(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    held = [b for b in batches if len(b)]
    return pa.Table.from_batches(held) if held else None


def _sort_bucket(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Ranges of repeated windows within a bucket of suffixes, and the distinct windows of its first and
    last groups where these are hot, as they may go on in other buckets."""
    rows = _all_rows(batches)
    if rows is None:
        return
    k1, k2, n, first, at, last, hot = (rows.column(c).to_numpy() for c in range(7))
    ahead, behind = rows.column(7).to_pylist(), rows.column(8).to_pylist()
    m = len(ahead)
    least, most = at - last, at - first  # distances of the anchor from the first byte of its windows
    order, shared = multikey_quicksort(words_of_bytes(ahead, -(-length // 8)))
    back, shared_back = multikey_quicksort(words_of_bytes(behind, max(1, -(-(length - GRAM) // 8))))
    group = np.empty(m, np.int64)
    group[order] = np.cumsum(shared < GRAM)
    border = hot & ((group == 1) | (group == group.max()))
    flags = np.zeros((m, length - GRAM + 1), bool)
    run, run_back = np.empty(m, np.int64), np.empty(m, np.int64)
    wins: dict[bytes, tuple[int, int, bool]] = {}
    for d in range(max(0, least.min()), most.max() + 1):
        here = np.flatnonzero((least <= d) & (d <= most))
        run[order], run_back[back] = np.cumsum(shared < length - d), np.cumsum(shared_back < d)
        _, which, count = np.unique(run[here] * (m + 1) + run_back[here], return_inverse=True, return_counts=True)
        again = count[which] > 1
        flags[here[again], d] = True
        cross = np.flatnonzero(border[here])
        for r, twice in zip(here[cross].tolist(), again[cross].tolist(), strict=True):
            win = behind[r][:d][::-1] + ahead[r][: length - d]
            if win not in wins:
                wins[win] = (r, d, not twice and n[r] == 1)
    flags[n > 1] = False  # flagged as a whole before
    r, low, high = _stretches(flags)
    yield _found(k1[r], k2[r], at[r] - high, at[r] - low + length)
    if wins:
        r, d, alone = (np.array(x) for x in zip(*wins.values(), strict=True))
        yield _found(k1[r], k2[r], at[r] - d, at[r] - d + length, list(wins), alone)


def _sort_windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Windows of a bucket that equal a neighbour, and the first and last window of the bucket."""
    rows = _all_rows(batches)
    if rows is None:
        return
    k1, k2, start, stop = (rows.column(c).to_numpy() for c in range(4))
    win, alone = rows.column(4).to_pylist(), rows.column(5).to_numpy()
    order, shared = multikey_quicksort(words_of_bytes(win, -(-length // 8)))
    same = np.r_[shared[1:] >= length, False]
    again = np.empty(len(order), bool)
    again[order] = same | np.r_[False, same[:-1]]
    now = again & alone
    yield _found(k1[now], k2[now], start[now], stop[now])
    ends = np.unique(order[[0, -1]]) if win[order[0]] != win[order[-1]] else order[:1]
    yield _found(k1[ends], k2[ends], start[ends], stop[ends], [win[e] for e in ends], alone[ends] & ~again[ends])


def _buckets(df: DataFrame, *by: str | Column) -> DataFrame:
    """``df``, a written table, range-partitioned by sampled splitters."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // BUCKET_ROWS))
    return df.repartitionByRange(n, *by)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, the text's bytes, and two hashes that name the row: of the text, and of it with the id."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.cast("binary").alias("body"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("row"), F.col("doc_id").cast("string"), text).alias("k2"))


def repeated_ranges(docs: DataFrame, length: int = 200, hot_rows: int = HOT_ROWS) -> DataFrame:
    """k1, k2, start, stop: ranges of bytes of the rows of ``docs`` (doc_id, text) that cover each byte of a
    window of ``length`` bytes that starts elsewhere too, and no other. Ranges may overlap. ``hot_rows`` is the number of
    suffixes with one gram above which they are dealt over buckets; it does not change the result."""
    keyed = _keyed(docs)
    scan, cut = (lambda it, f=f: f(it, length) for f in (_scan, _cut_out))
    long_enough = keyed.filter(F.octet_length("body") >= length)
    found = written(long_enough.select("k1", "k2", "body").mapInArrow(scan, ANCHORS), "suffix-anchors")
    grams = found.groupBy("fp").agg(F.count("*").alias("n"), (F.min("ph") != F.max("ph")).alias("mixed")).filter("n > 1").select("fp", "mixed")
    hits = written(found.join(small(written(grams, "suffix-grams")), "fp"), "suffix-hits")
    one = [F.first(c).alias(c) for c in ("k1", "k2", "first", "at", "last")]
    passages = written(hits.filter("mixed").groupBy("fp", "ph").agg(F.count("*").alias("n"), *one), "suffix-passages")
    twice = small(written(passages.filter("n > 1").select("fp", "ph"), "suffix-twice"))
    whole = hits.filter("not mixed").unionByName(hits.filter("mixed").join(twice, ["fp", "ph"], "left_semi"))
    often = small(written(passages.groupBy("fp").count().filter(F.col("count") > hot_rows).select("fp", F.lit(True).alias("often")), "suffix-often"))
    marked = passages.join(often, "fp", "left").withColumn("hot", F.col("often").isNotNull())
    wanted = marked.groupBy("k1", "k2").agg(F.collect_list(F.struct("n", "first", "at", "last", "hot")).alias("wanted"))
    suffixes = written(long_enough.join(wanted, ["k1", "k2"]).select("k1", "k2", "body", "wanted").mapInArrow(cut, SUFFIXES), "suffix-suffixes")
    sort, compare = (lambda it, f=f: f(it, length) for f in (_sort_bucket, _sort_windows))
    key = [F.substring("ahead", 1, GRAM), *(F.when(F.col("hot"), F.col(c)) for c in ("ahead", "behind"))]
    inner = written(_buckets(suffixes, *key).mapInArrow(sort, FOUND), "suffix-buckets")
    outer = written(_buckets(inner.filter("win is not null"), "win", "k1", "k2", "start").mapInArrow(compare, FOUND), "suffix-windows")
    met = outer.filter("win is not null").groupBy("win").agg(F.count("*").alias("n"), F.collect_list(F.struct("k1", "k2", "start", "stop", "alone")).alias("rows"))
    last = met.filter("n > 1").select(F.inline("rows")).filter("alone")
    columns = ("k1", "k2", "start", "stop")
    parts = [inner.filter("win is null"), outer.filter("win is null"), last]
    out = whole.select("k1", "k2", F.col("first").alias("start"), (F.col("last") + length).alias("stop"))
    for part in parts:
        out = out.unionByName(part.select(*columns))
    return out


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for body, ranges in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            kept, spans, removed, reach = [], 0, 0, 0
            for r in sorted((r["start"], r["stop"]) for r in ranges or ()):
                if r[0] > reach or not spans:
                    kept.append(body[reach : r[0]])
                    spans += 1
                    reach = r[0]
                if r[1] > reach:
                    removed += r[1] - reach
                    reach = r[1]
            kept.append(body[reach:])
            out.append((len(body), removed, spans, b"".join(kept)))
        n, removed, spans, kept = zip(*out, strict=True) if out else ((),) * 4
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (n, removed, spans)), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def without_repeats(docs: DataFrame, length: int = 200, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept, the bytes that stay, of each row
    of ``docs`` (doc_id, text).

    A byte goes if a string of ``length`` bytes that covers it starts elsewhere too, in the same text or
    another; all strings are those of the input. Null texts are empty; texts shorter than ``length``
    stay whole; copies of a text that long lose all of it. Repeated rows are copies of each other,
    also where the doc_id is null. What stays may begin within a character, so it is given as bytes. Extra
    columns are not looked at, and an empty table gives none.
    """
    if length <= GRAM:
        raise ValueError(f"length must be more than {GRAM}")
    ranges = repeated_ranges(docs, length, hot_rows).groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "stop")).alias("ranges"))
    joined = _keyed(docs).join(written(ranges, "suffix-ranges"), ["k1", "k2"], "left").select("doc_id", "body", "ranges")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(_digests, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
