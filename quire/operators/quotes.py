"""Location of quotes in texts: keys of their first characters, a Bloom filter, a join, a check."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import stored

#: Characters of context on each side that choose among the places of a quote.
CONTEXT = 30
#: Lengths of keys; a quote's key is its first characters, as many as the greatest length that it has.
KEY_SIZES = (16, 8, 4, 2, 1)
#: Bits of the filter: a megabyte, whatever the number of quotes. A full one passes all keys on to the join.
FILTER_BITS = 1 << 23
_DROPPED = re.compile(r"[\s\-‐-―­−]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = {size: np.uint64(pow(int(_BASE), size, 2**64)) for size in KEY_SIZES}
_PLACES = "array<struct<at:int,before:string,behind:string,first_part:int,start:int,last_part:int,end:int>>"


def fold(text: str | None) -> str:
    """A text in NFKC and lower case without white space and hyphens."""
    return _DROPPED.sub("", unicodedata.normalize("NFKC", text or "").lower())


class _Folds(dict):
    """What each character folds to, by code point, each worked out once; None for nothing."""

    def __missing__(self, code: int) -> str | None:
        self[code] = fold(chr(code)) or None
        return self[code]


_FOLDS = _Folds()


def folded_places(parts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The part and the offset that each folded character of the parts comes from."""
    sizes = [np.fromiter((len(_FOLDS[ord(c)] or "") for c in part or ""), np.int64, len(part or "")) for part in parts]
    at = [np.repeat(np.arange(len(n)), n) for n in sizes]
    return np.repeat(np.arange(len(at)), [len(a) for a in at]), np.concatenate(at or [np.zeros(0, np.int64)])


def folded_with_places(parts: list[str | None]) -> tuple[str, list[tuple[int, int]]]:
    """The parts folded one behind the other, character by character, and the part and offset that each folded
    character comes from."""
    return "".join(part or "" for part in parts).translate(_FOLDS), [(int(p), int(a)) for p, a in zip(*folded_places(parts), strict=True)]


def _folded(parts: list[str | None]) -> str:
    return "".join(p or "" for p in parts).translate(_FOLDS)


def key_hashes(text: str, sizes: set[int]) -> Iterator[tuple[int, np.ndarray]]:
    """The size and the hashes of all stretches of ``text`` of each of the ``sizes`` (powers of two)."""
    h = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = 1
    while len(h):
        if size in sizes:
            yield size, (h ^ (h >> np.uint64(31))) * (_POWERS[1] ^ np.uint64(2 * size))
        if 2 * size > max(sizes) or len(h) <= size:
            return
        h = h[:-size] * _POWERS[size] + h[size:]
        size *= 2


def _bit(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(20)) & np.uint64(FILTER_BITS - 1)


def _quote_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        q = b["quote"].map(fold)
        sizes, keys = [], []
        for text in q:
            size = next((s for s in KEY_SIZES if s <= len(text)), 0)
            sizes.append(size)
            keys.append(int(next(key_hashes(text[:size], {size}))[1].view(np.int64)[0]) if size else 0)
        yield pd.DataFrame({"quote_id": b["quote_id"], "folded": q, "before": b["prefix"].map(lambda x: fold(x)[-CONTEXT:]), "behind": b["suffix"].map(lambda x: fold(x)[:CONTEXT]), "key_size": sizes, "key": keys})


def _filter_of(keys: DataFrame) -> tuple[np.ndarray, set[int]]:
    """Bits of the keys' hashes, gathered as at most FILTER_BITS / 64 words, and the sizes of keys that there are."""
    bit = F.shiftrightunsigned("key", 20).bitwiseAND(F.lit(FILTER_BITS - 1))
    words = keys.select("key_size", bit.alias("bit")).distinct().groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"), F.collect_set("key_size").alias("sizes")).toPandas()
    found = np.zeros(FILTER_BITS // 64, np.int64)
    found[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return np.unpackbits(found.view(np.uint8), bitorder="little").astype(bool), {int(s) for sizes in words["sizes"] for s in sizes}


def _candidates(bits: Callable[[], np.ndarray], sizes: set[int]) -> Callable:
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = np.unpackbits(bits(), bitorder="little").view(bool)
        for b in batches:
            rows = []
            for doc, parts in zip(b["doc"], b["parts"], strict=True):
                text = _folded([] if parts is None else list(parts))
                for size, hashes in key_hashes(text, sizes):
                    rows += [(doc, size, k) for k in np.unique(hashes[known[_bit(hashes)]]).view(np.int64).tolist()]
            yield pd.DataFrame(rows, columns=["doc", "key_size", "key"])

    return scan


def _find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All places of the quotes of each row, also overlapping ones, with what stands around them."""
    for b in batches:
        rows = []
        for doc, parts, quotes in zip(b["doc"], b["parts"], b["quotes"], strict=True):
            parts = [] if parts is None else list(parts)
            text, places = _folded(parts), None
            for q in quotes:
                at, found = text.find(q), []
                while at >= 0:
                    places = folded_places(parts) if places is None else places
                    (p0, p1), (a, z) = (x[[at, at + len(q) - 1]].tolist() for x in places)
                    found.append((at, text[max(0, at - CONTEXT) : at], text[at + len(q) : at + len(q) + CONTEXT], p0, a, p1, z + 1))
                    at = text.find(q, at + 1)
                if found:
                    rows.append((doc, q, [dict(zip(("at", "before", "behind", "first_part", "start", "last_part", "end"), f, strict=True)) for f in found]))
        yield pd.DataFrame(rows, columns=["doc", "folded", "places"])


def _agreement(a: Column, b: Column) -> Column:
    """How many first characters of two strings of CONTEXT characters at most are equal."""
    n = F.sequence(F.lit(1), F.lit(CONTEXT))
    return F.size(F.filter(n, lambda k: (k <= F.length(a)) & (k <= F.length(b)) & (F.substr(a, F.lit(1), k) == F.substr(b, F.lit(1), k))))


def locate_quotes(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """Where each quote (quote_id, quote and, if known, prefix and suffix) stands in the texts (doc,
    and text or parts, an array of neighbouring blocks; a quote may span blocks).

    Quotes and texts are folded: NFKC, lower case, no white space, no hyphens. ``starts`` are all
    places in the folded text; the best one agrees with most of the 30 characters before and behind
    the quote, the first one of ties, and is given as offsets from ``start`` in block ``first_part``
    up to ``end`` in block ``last_part``. Quotes of any length are found; those that fold to nothing are not.

    One pass over the texts, for any number of quotes, tests the hashes of all their stretches of a
    key's size against a filter of bounded size. What passes meets the distinct quotes by a join on keys, and
    a text is searched for those that it may hold. Quotes of one wording are looked for once.
    """
    kinds = quotes.schema["quote_id"].dataType, texts.schema["doc"].dataType
    side = [F.col(c) if c in quotes.columns else F.lit(None).cast("string").alias(c) for c in ("prefix", "suffix")]
    t = texts.select(F.col("doc").cast("string").alias("doc"), "parts" if "parts" in texts.columns else F.array("text").alias("parts"))
    q = quotes.select(F.col("quote_id").cast("string").alias("quote_id"), F.coalesce("quote", F.lit("")).alias("quote"), *side).distinct()
    q = stored(q.mapInPandas(_quote_rows, "quote_id string, folded string, before string, behind string, key_size int, key long").filter("key_size > 0"), "quotes")
    known, sizes = _filter_of(q.select("key_size", "key"))
    packed = t.sparkSession.sparkContext.broadcast(np.packbits(known, bitorder="little"))
    met = t.mapInPandas(_candidates(lambda: packed.value, sizes), "doc string, key_size int, key long") if sizes else None
    if met is None:
        met = t.limit(0).select("doc", F.lit(0).alias("key_size"), F.lit(0).cast("long").alias("key"))
    wanted = met.join(q.select("key_size", "key", "folded").distinct(), ["key_size", "key"]).groupBy("doc").agg(F.collect_set("folded").alias("quotes"))
    found = t.join(stored(wanted, "quotes-wanted"), "doc").mapInPandas(_find, f"doc string, folded string, places {_PLACES}")
    each = found.join(q.select("quote_id", "folded", "before", "behind"), "folded")
    score = lambda p: _agreement(F.reverse(F.col("before")), F.reverse(p["before"])) + _agreement(F.col("behind"), p["behind"])
    best = F.array_max(F.transform("places", lambda p: F.struct(score(p).alias("score"), (-p["at"]).alias("first"), p.alias("place"))))["place"]
    return each.select("doc", "quote_id", F.transform("places", lambda p: p["at"]).alias("starts"), best.alias("b")).select(
        F.col("doc").cast(kinds[1]).alias("doc"), F.col("quote_id").cast(kinds[0]).alias("quote_id"), "starts", F.col("b.at").alias("best"), "b.first_part", "b.start", "b.last_part", "b.end"
    )
