"""Best-fit packing with Martello-Toth dominance reduction.

Documents become token ids and an end id; longer ones are cut into full pieces behind a shorter
first one. Pieces of one length are interchangeable, so packing works on the counts of the at most
``CAPACITY`` lengths: first sets of pieces that provably dominate every alternative are fixed
(a piece alone if nothing fits beside it; a piece with its exact complement, or with the largest
that fits where no two others do), which shrinks the counts; best-fit decreasing packs the rest,
many equal sequences at a time. The plan has a row for each pattern of lengths, not for each piece;
pieces find their place in it by their number within their length.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import batched

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_ids, slices, written

CAPACITY, END_ID = 1024, 2
SALTS = 64
PIECES = "piece int, start long, length long, ids_crc32 long"
_TOKENIZERS: dict[str, Callable[[list[str]], list[bytes]]] = {}


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary (as code points of Latin-1)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def encoder(path: str, held: int = 250_000) -> Callable[[list[str]], list[bytes]]:
    """Ids of texts (little-endian, 32 bits each) under a byte-level BPE file of ``tokenizers``.

    Such a vocabulary splits before a space that a character other than white space follows, so
    the ids of a text are those of its parts; parts are encoded once and remembered: those of the last
    calls, and as soon as they are more than ``held``, those of the calls before until that happens again.
    A part of letters, or of letters and one mark, skips the pattern.
    """
    if path in _TOKENIZERS:
        return _TOKENIZERS[path]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    model, letters = tokenizer.model, _byte_letters()
    known: dict[str, bytes] = {}
    before: dict[str, bytes] = {}
    marks = {m: array("I", [t.id for t in model.tokenize(m)]).tobytes() for m in ".,;:!?"}
    spaces, spaced = (" \n", "  ", " \t", " \r", " \x0b", " \x0c", " \x1c", " \x1d", " \x1e", " \x1f"), re.compile(r" \s")

    def parts_of(text: str) -> list[str]:
        """Every part but the first stands for itself behind a space; the first has a mark of its own."""
        first, *rest = text.split(" ")
        if any(x in text for x in spaces) if text.isascii() else spaced.search(text):
            glued = [" " + first]
            for p in rest:
                if not p or p[0].isspace():
                    glued[-1] += " " + p
                else:
                    glued.append(p)
            return glued
        if rest and not rest[-1]:  # it ends with one space
            rest.pop()
            if not rest:
                return [" " + first + " "]
            rest[-1] += " "
        return [" " + first, *rest]

    def word(p: str) -> bytes:
        return array("I", [t.id for t in model.tokenize(letters[32] + (p if p.isascii() else p.encode().decode("latin-1").translate(letters)))]).tobytes()

    def learn(new: set[str]) -> None:
        slow = []
        for p in new:
            if p.isalpha():
                known[p] = word(p)
            elif p[-1] in marks and p[:-1].isalpha():
                bare = known.get(p[:-1])
                if bare is None:
                    bare = known[p[:-1]] = word(p[:-1])
                known[p] = bare + marks[p[-1]]
            else:
                slow.append(p)
        for some in batched(slow, 4096):
            for p, e in zip(some, tokenizer.encode_batch_fast([p[1:] if p[0] == " " else " " + p for p in some], add_special_tokens=False), strict=True):
                known[p] = array("I", e.ids).tobytes()

    def encode(texts: list[str]) -> list[bytes]:
        nonlocal known, before
        if len(known) > held:
            known, before = {}, known
        split = [parts_of(t) for t in texts]
        new = set().union(*split).difference(known)
        again = new.intersection(before)
        known.update((p, before[p]) for p in again)
        learn(new - again)
        return [b"".join(map(known.__getitem__, parts)) for parts in split]

    _TOKENIZERS[path] = encode
    return encode


def _cut(path: str, capacity: int, end_id: int) -> Callable:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path), array("I", [end_id]).tobytes()
        for batch in batches:
            for some in slices(batch):
                at, rows = array("q"), [array("q") for _ in range(4)]
                for i, ids in enumerate(encode([t or "" for t in some.column("text").to_pylist()])):
                    ids += end
                    n = len(ids) // 4
                    edges = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                        at.append(i)
                        for column, x in zip(rows, (k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])), strict=True):
                            column.append(x)
                ids_of = [some.column(c).take(pa.array(at, pa.int64())) for c in ("doc_id", "row")]
                yield pa.RecordBatch.from_arrays([*ids_of, *(pa.array(x, t) for x, t in zip(rows, (pa.int32(), *[pa.int64()] * 3), strict=True))], names=["doc_id", "row", "piece", "start", "length", "ids_crc32"])

    return cut


def reduced(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Patterns (lengths, how often) fixed by dominance, and the counts that are left.

    For the longest piece j: if the smallest piece does not fit beside it, {j} dominates. If a
    piece fills the sequence exactly, that pair dominates. If the two smallest do not fit beside
    it together, {j, largest that fits} dominates, as no set with j holds more than two.
    """
    left, fixed = {w: n for w, n in counts.items() if n > 0}, []
    lengths = sorted(left)

    def take(w: int, n: int) -> None:
        left[w] -= n
        if not left[w]:
            del left[w]
            lengths.pop(bisect_left(lengths, w))

    kept: dict[int, int] = {}
    while lengths:
        j = lengths[-1]
        room = capacity - j
        if lengths[0] > room:
            fixed.append(((j,), left[j]))
            take(j, left[j])
            continue
        if room in left:
            n = left[j] // 2 if room == j else min(left[j], left[room])
            if n:
                fixed.append(((j, room), n))
                take(j, n)
                take(room, n)
                continue
        small = 2 * lengths[0] if left[lengths[0]] > 1 else lengths[0] + (lengths[1] if len(lengths) > 1 else capacity)
        i = bisect_left(lengths, room + 1) - 1
        k = lengths[i]
        if small > room and k != j:
            n = min(left[j], left[k])
            fixed.append(((j, k), n))
            take(j, n)
            take(k, n)
            continue
        kept[j] = left[j]  # no criterion holds for this length; smaller ones may still pair up exactly
        take(j, left[j])
        # dominance was shown for the longest piece of what is left; only exact pairs hold beyond it
        for w in [x for x in lengths if 2 * x >= capacity and capacity - x in left][::-1]:
            n = left[w] // 2 if 2 * w == capacity else min(left.get(w, 0), left.get(capacity - w, 0))
            if n:
                fixed.append(((w, capacity - w), n))
                take(w, n)
                take(capacity - w, n)
        break
    for w, n in left.items():
        kept[w] = kept.get(w, 0) + n
    return fixed, kept


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: patterns (lengths, how often), equal sequences together."""
    open_by: dict[int, Counter] = {}
    rooms: list[int] = []  # sorted

    def put(room: int, pattern: tuple[int, ...], n: int) -> None:
        if room not in open_by:
            open_by[room] = Counter()
            insort(rooms, room)
        open_by[room][pattern] += n

    for w in sorted(counts, reverse=True):
        n = counts[w]
        while n:
            i = bisect_left(rooms, w)
            if i == len(rooms):
                each = capacity // w
                whole, rest = divmod(n, each)
                if whole:
                    put(capacity - each * w, (w,) * each, whole)
                if rest:
                    put(capacity - rest * w, (w,) * rest, 1)
                n = 0
                continue
            room = rooms[i]
            pattern, many = next(iter(open_by[room].items()))
            each = room // w
            whole = min(many, n // each)
            some = 0 if whole else n
            used = whole or 1
            open_by[room][pattern] -= used
            if not open_by[room][pattern]:
                del open_by[room][pattern]
            if not open_by[room]:
                del open_by[room]
                rooms.pop(i)
            k = each if whole else some
            put(room - k * w, pattern + (w,) * k, used)
            n -= used * k
    return [(p, n) for c in open_by.values() for p, n in c.items()]


def plan_rows(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first number, last number + 1, per sequence, first sequence, offset of the first) for
    each length in each pattern; the pieces of a length are numbered across patterns."""
    rows, used, sequence = [], Counter(), 0
    for pattern, n in patterns:
        offset = 0
        for w, per in Counter(pattern).items():
            rows.append((w, used[w], used[w] + n * per, per, sequence, offset))
            used[w] += n * per
            offset += w * per
        sequence += n
    return rows


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row for each piece of each row of ``docs`` (doc_id, text): doc_id, piece, start, length,
    ids_crc32, sequence_id and offset.

    ``tokenizer`` is the path of a byte-level BPE file that every worker can read. Null and empty
    texts are the end id alone. Ties between pieces of one length go by a salted hash and then by
    doc_id and piece; repeated rows are packed each. An empty table gives no rows; other columns
    are not looked at. The plan holds one row for each length in each pattern, of which the
    capacity bounds the number.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("row"))
    salt = F.pmod(F.xxhash64("row", "piece"), F.lit(SALTS)).cast("int")
    pieces = written(map_ids(rows, _cut(tokenizer, capacity, end_id), f"row long, {PIECES}", arrow=True).withColumn("salt", salt), "pack-pieces")
    counts = written(pieces.groupBy("length", "salt").agg(F.count("*").alias("n")), "pack-counts")
    by_length = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    fixed, rest = reduced(by_length, capacity)
    plan = spark.createDataFrame(plan_rows(fixed + best_fit(rest, capacity)) or [(0, 0, 0, 1, 0, 0)], "p_length long, lo long, hi long, per long, sequence long, at long")
    before = counts.select("length", "salt", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("length", "salt").orderBy("row", "piece", "ids_crc32"))
    numbered = pieces.withColumn("number", number).join(F.broadcast(before), ["length", "salt"]).withColumn("number", F.col("before") + F.col("number") - 1)
    placed = numbered.join(F.broadcast(plan), (F.col("length") == F.col("p_length")) & (F.col("number") >= F.col("lo")) & (F.col("number") < F.col("hi")))
    k = F.col("number") - F.col("lo")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.floor(k / F.col("per"))).cast("long").alias("sequence_id"), (F.col("at") + (k % F.col("per")) * F.col("length")).cast("long").alias("offset"))
