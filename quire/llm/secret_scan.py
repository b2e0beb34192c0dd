"""Secret scans: fixed patterns, and password guess cost in credential contexts.

The base finds assignments, access keys and long hexadecimal runs. The method looks at values that
stand in a credential context and estimates how many guesses they take: dynamic programming
segments a value into words, dates, repeats, keyboard walks and brute-force spans at the least cost.
Values that cost more than a threshold are secrets as well. Behind a word for a password the cost
alone decides; behind weaker words, such as "login", values that read as prose are none.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain
from operator import or_

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_ids, slices, written

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: A credential context: a key word, a sign or verb, and a value without white space or quotes.
CONTEXT = re.compile(r"""(?<![a-z0-9])(pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|(?:access|private|secret)[_-]?key|auth(?:orization)?|bearer|credentials?|login)(?:["']?\x20{0,3}[:=]>?\x20{0,3}|\x20is\x20)["']?(?:bearer\x20)?([^\s"'<>]{6,})""", re.I | re.A)
#: How the words for a password begin, behind which any value is one.
PASSWORDS = ("pass", "pwd")
#: A value that stands for one: a variable of a shell, a template or a format.
REFERENCE = re.compile(r"[$%#]?[{(\[]{1,2}[\w.\x20-]+[})\]]{0,2}|\$\w+|%\w+%|__\w+__", re.A)
HINTS = ("pass", "secret", "token", "api", "pwd", "key", "auth", "bearer", "credential", "login")
#: log10 of the guesses from which a value is a secret.
THRESHOLD = 8.0
#: Longest word of a list; shorter repeats and walks within longer ones are tried up to it.
SPAN = 32
#: Cost of a word that no list has and that can be spoken, and of each letter beyond the eighth; of a sign between words.
WORD, LONG_WORD, BETWEEN = 3.3, 0.48, 0.5

# fixed values: common words of passwords by rank
COMMON = (
    "password 123456 qwerty admin letmein welcome login secret master dragon monkey shadow sunshine princess football baseball "
    "iloveyou trustno1 superman batman hello freedom whatever michael jordan harley ranger hunter buster soccer hockey killer "
    "george charlie andrew michelle jessica pepper daniel access joshua maggie starwars silver william dallas yankees ashley "
    "amanda summer winter spring autumn love god ninja mustang computer internet server test demo guest user root default changeme "
    "example sample token key pass temp backup data system network secure service account company home work money monday friday "
    "january february march april may june july august september october november december red blue green black white apple orange "
    "your here my enter insert placeholder"
).split()
RANK = {w: i + 1 for i, w in enumerate(COMMON)}
#: Most words that are learnt from the documents and broadcast with the scan: 1 MB.
LEARNT = 20_000
# fixed values: rows of a keyboard, and letters that signs stand for
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("@4310!5$7+8", "aaeioissttb")
_NEAR = {a: {b for r2, row2 in enumerate(ROWS) for c2, b in enumerate(row2) if abs(r - r2) <= 1 and abs(c - c2) <= 1 and a != b} for r, row in enumerate(ROWS) for c, a in enumerate(row)}
DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d)")


def _char_cost(c: str) -> float:
    return 1.0 if c.isdigit() else 1.2 if c.islower() else 1.3 if c.isupper() else 1.5


def _run_ends(value: str, goes_on: Callable[[str, str], bool]) -> list[int]:
    """For each place the end of the stretch from it in which each character goes on from the one before."""
    ends = [len(value)] * len(value)
    for i in range(len(value) - 2, -1, -1):
        ends[i] = ends[i + 1] if goes_on(value[i], value[i + 1]) else i + 1
    return ends


def guess_cost(value: str, ranks: dict[str, int] = RANK, enough: float = math.inf) -> float:
    """log10 of the guesses of the cheapest segmentation of ``value``; 0 for an empty one. Costs of ``enough``
    or more are not told apart: the program ends where no cheaper segmentation goes on.

    A place has a bounded number of segments: words of the list and shorter repeats and walks up to
    SPAN characters, the whole repeat and walk, a date, and a word that can be spoken.
    """
    n, low = len(value), value.lower()
    plain = low.translate(LEET)
    best = [0.0] + [math.inf] * n
    same, walk = _run_ends(value, str.__eq__), _run_ends(low, lambda a, b: b in _NEAR.get(a, ()))
    words = {m.start(): m.end() for m in PART.finditer(value) if len(m[0]) >= 3 and can_be_spoken(m[0].lower())}
    reached = 0  # the last place that costs less than enough
    i = 0
    while i <= reached and i < n:
        if best[i] >= enough:
            i += 1
            continue
        at = best[i] + (0.3 if i else 0.0)  # another segment

        def reach(j: int, cost: float) -> None:
            nonlocal reached
            if cost < best[j]:
                best[j] = cost
                if cost < enough and j > reached:
                    reached = j

        reach(i + 1, best[i] + _char_cost(value[i]))
        if 0 < i < n - 1 and value[i] in "-_/." and value[i - 1].isalpha() and value[i + 1].isalpha():
            reach(i + 1, best[i] + BETWEEN)
        for j in range(i + 3, min(n, i + SPAN) + 1):
            rank, extra = ranks.get(low[i:j]), 0.0
            if rank is None:
                rank, extra = ranks.get(plain[i:j]), 0.6
            if rank is not None:
                reach(j, at + math.log10(rank + 1) + extra + (0.3 if value[i:j] != low[i:j] else 0.0))
        if i in words:
            j = words[i]
            reach(j, at + WORD + LONG_WORD * max(0, j - i - 8) + (0.3 if value[i:j] != low[i:j] else 0.0))
        for end, cost in ((same[i], lambda k: _char_cost(value[i]) + math.log10(k)), (walk[i], lambda k: math.log10(len(_NEAR)) + 0.5 * math.log10(k) + 0.1 * k)):  # noqa: B023
            if end - i >= 3:
                for j in {end, *range(i + 3, min(end, i + SPAN))}:
                    reach(j, at + cost(j - i))
        m = DATE.match(value, i)
        if m:
            reach(m.end(), at + (math.log10(119) if m.end() - i == 4 else math.log10(365 * 119) + (0.6 if m.end() - i > 8 else 0.0)))
        i += 1
    return min(best[n], enough)


def base_spans(text: str, low: str) -> list[tuple[str, int, int]]:
    """Leftmost matches of each base kind that do not overlap within it, in order of their start."""
    found: list[tuple[str, int, int]] = []
    if "password" in low or "passwd" in low or "secret" in low or "token" in low or "api" in low:
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


#: Words of a value: a run of capitals, or of small letters behind at most one capital.
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+")
SCHEME = re.compile(r"(?:https?|ftp|file|mailto)://|www\.", re.I)
#: What words that can be spoken do not hold.
CLUSTER = re.compile(r"[^aeiouy]{7}|[aeiouy]{5}|[jq][^aeiouys]|v[bcdfghjkmpqtwxz]|x[bdfgjkmnrvz]|[bcdfghjkmpqvwx][qx]")


def can_be_spoken(part: str) -> bool:
    """Whether small letters have a vowel in six and no cluster that words do not have; other scripts always."""
    return not part.isascii() or 6 * sum(c in "aeiouy" for c in part) >= len(part) and not CLUSTER.search(part)


def is_prose(value: str) -> bool:
    """Whether a value without digits reads as words: three quarters of its letters are in parts of three
    letters or more that can be spoken, and at most a quarter of its characters are signs."""
    if any(map(str.isdigit, value)):
        return False
    value = "".join(c for c in unicodedata.normalize("NFKD", SCHEME.sub("", value)) if not unicodedata.combining(c))
    letters = sum(map(str.isalpha, value))
    spoken = sum(len(m[0]) for m in PART.finditer(value) if len(m[0]) >= 3 and can_be_spoken(m[0].lower()))
    return letters > 0 and 4 * spoken >= 3 * letters and 4 * letters >= 3 * len(value)


def added_spans(text: str, low: str, base: list[tuple[str, int, int]], threshold: float, ranks: dict[str, int] = RANK) -> list[tuple[str, int, int]]:
    """Values in credential contexts that no base span holds whole and that are costly to guess; behind a word that
    is none for a password, also no prose."""
    if not any(h in low for h in HINTS):
        return []
    found = []
    for m in CONTEXT.finditer(text):
        a, value = m.start(2), m[2].rstrip(".,;:!?)]}")
        if any(s <= a and a + len(value) <= e for _, s, e in base) or REFERENCE.fullmatch(m[2].rstrip(".,;:!?")):
            continue
        if guess_cost(value, ranks, threshold) >= threshold and (m[1].lower().startswith(PASSWORDS) or not is_prose(value)):
            found.append(("guess", a, a + len(value)))
    return found


def spans_of(text: str | None, threshold: float = THRESHOLD, ranks: dict[str, int] = RANK) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all secrets of a whole text, by start and kind; offsets in code points."""
    if not text:
        return []
    low = text.lower()
    base = base_spans(text, low)
    return sorted(base + added_spans(text, low, base, threshold, ranks), key=lambda s: (s[1], KINDS.index(s[0])))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scan(threshold: float, ranks: dict[str, int]) -> Callable:
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [spans_of(t if isinstance(t, str) else None, threshold, ranks) for t in batch["text"]]
            base = [[s for s in f if s[0] != "guess"] for f in found]
            yield batch.drop(columns="text").assign(
                **{f"n_{k}": [sum(s[0] == k for s in f) for f in found] for k in KINDS},
                base_sha256=[hashlib.sha256(_joined(b).encode()).hexdigest() for b in base],
                spans=[_joined(f) for f in found],
            )

    return scan


def learnt_ranks(docs: DataFrame, most: int = LEARNT) -> dict[str, int]:
    """Ranks of words: the fixed ones first, then the most frequent words of three to ``SPAN`` letters a-z,
    in any case, of all ``docs`` (text) that at least three of them have outside credential contexts, ``most``
    at most. The count
    from which words are taken comes from a histogram, so the driver never sees more than those."""
    low = F.lower("text")
    hinted = reduce(or_, (F.contains(low, F.lit(h)) for h in HINTS))
    prose = F.when(hinted, F.regexp_replace(low, CONTEXT.pattern, " ")).otherwise(low)  # a secret of copied documents is no word
    word = F.explode(F.array_distinct(F.regexp_extract_all(prose, F.lit(r"(?<![^\s(\"'])[a-z]{3,}(?![^\s.,;:!?)\"'])"), F.lit(0)))).alias("word")
    counts = docs.select(word).filter(F.length("word") <= SPAN).groupBy("word").agg(F.count("*").alias("n")).filter("n >= 3")
    counts = written(counts.withColumn("bin", F.floor(64 * F.log2("n")).cast("int")), "secret-words")
    left, least = most, None
    for r in counts.groupBy("bin").agg(F.count("*").alias("words")).orderBy(F.desc("bin")).collect():  # at most 64 rows for each doubling of a count
        left -= r["words"]
        if left < 0:
            break
        least = r["bin"]
    found = [] if least is None else counts.filter(F.col("bin") >= least).orderBy(F.desc("n"), "word").collect()  # at most ``most`` words
    ranks = dict(RANK)
    for r in found:
        ranks.setdefault(r["word"], len(ranks) + 1)
    return ranks


def scan_secrets(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and spans for each row of ``docs`` (doc_id, text).

    Null and empty texts have no spans; repeated rows are scanned each; an empty table gives no
    rows; other columns are not looked at. Spans of one start are in order of their kind.
    """
    return map_ids(docs.select("doc_id", "text"), _scan(threshold, learnt_ranks(docs)), "n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string")


def masked(text: str | None, threshold: float = THRESHOLD, ranks: dict[str, int] = RANK) -> str | None:
    """The text with each run of spans replaced by ``[SECRET]``."""
    spans = spans_of(text, threshold, ranks)
    if not text or not spans:
        return text
    out, at = [], 0
    for _, a, b in spans:
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the secrets of ``text`` masked and ``n_chars`` set to its new length (0 for null).

    Null and empty texts stay as they are; repeated rows are masked each; other columns, whatever
    their names, types and nulls, pass as Arrow columns untouched; an empty table gives none.
    """
    ranks = learnt_ranks(docs)

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(map(slices, batches)):
            texts = [masked(t, threshold, ranks) for t in batch.column("text").to_pylist()]
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            columns["text"] = pa.array(texts, batch.schema.field("text").type)
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([len(t or "") for t in texts], batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), schema=batch.schema)

    return docs.mapInArrow(mask, docs.schema)
