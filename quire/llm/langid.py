"""Language ID: multinomial naive Bayes over hashed character n-grams.

Counts of hashed n-grams are taken over all training documents in Spark. The table of log
probabilities has one column for each language and a fixed number of rows, so it can be broadcast;
batches of texts are scored by gathering and summing its rows in numpy. Beyond TABLE_LANGUAGES languages
there are several tables, one after the other: a row carries its best language so far, and the sum
over those seen, from table to table, so the result is that of one table of all.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_ids, written

#: Hash buckets, lengths of n-grams, and the languages of one broadcast table (64 MB).
BUCKETS, LENGTHS, TABLE_LANGUAGES = 1 << 16, (2, 3), 256
#: Languages whose counts a task holds at once, and whose counts come to the driver at once (1 MB each at most).
HELD_LANGUAGES = 64
UNKNOWN = "und"
#: Characters that are hashed at once, and numbers that are gathered at once from the table.
CHARS, GATHERED = 1 << 20, 1 << 22
#: n-grams beyond which a longer text is no more certain: its score is the posterior at this length.
SCORED = 40


def _ngrams(text: str, chars: int = CHARS) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a text in lower case, padded with a space at both ends; those that
    start in the same ``chars`` characters at a time, so that a text of any length has the same ones."""
    x = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    for at in range(0, len(x), chars):
        out = []
        for n in LENGTHS:
            part = x[at : at + chars + n - 1]
            if len(part) >= n:
                h = np.full(len(part) - n + 1, n, np.uint32)
                for i in range(n):
                    h = (h ^ part[i : len(part) - n + 1 + i]) * np.uint32(0x01000193)
                    h ^= h >> np.uint32(15)
                out.append((h * np.uint32(0x9E3779B1)) >> np.uint32(16))
        if out:
            yield np.concatenate(out)


def _sparse(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of n-grams of each text of a batch as a sparse matrix: row, bucket and count of each
    entry, in order of rows."""
    rows, buckets, counts = [], [], []
    for i, text in enumerate(texts):
        parts = [np.unique(g, return_counts=True) for g in _ngrams(text)]
        for b, c in parts:
            rows.append(np.full(len(b), i, np.int64))
            buckets.append(b)
            counts.append(c)
    return (np.concatenate(rows), np.concatenate(buckets), np.concatenate(counts)) if rows else (np.empty(0, np.int64), np.empty(0, np.uint32), np.empty(0, np.int64))


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, bucket, n) of a task; under bucket -1 the number of texts. Sent on whenever many languages are held."""
    total: dict[str, np.ndarray] = {}
    docs: Counter = Counter()
    held: dict[str, list[np.ndarray]] = {}

    def flush(lang: str) -> None:
        parts = held.pop(lang, None)
        if parts:
            total[lang] += np.bincount(np.concatenate(parts), minlength=BUCKETS)

    def rows() -> Iterator[pd.DataFrame]:
        for lang, sums in total.items():
            flush(lang)
            bucket = np.flatnonzero(sums)
            yield pd.DataFrame({"lang": lang, "bucket": np.r_[bucket, -1].astype(np.int32), "n": np.r_[sums[bucket], docs[lang]]})
        total.clear()
        docs.clear()

    for batch in batches:
        for text, lang in zip(batch["text"], batch["lang"], strict=True):
            if lang not in total:
                if len(total) == HELD_LANGUAGES:
                    yield from rows()
                total[lang] = np.zeros(BUCKETS, np.int64)
            docs[lang] += 1
            for part in _ngrams(text):
                held.setdefault(lang, []).append(part)
                if sum(map(len, held[lang])) > CHARS:
                    flush(lang)
    yield from rows()


def counted(labelled: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all rows (text, lang) of which neither is null, written."""
    rows = labelled.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    return written(rows.mapInPandas(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "language-counts")


def table_of(counts: DataFrame, languages: list[str], docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Log probabilities (BUCKETS x languages) and log priors, by the number ``docs`` of all texts."""
    n, texts = np.zeros((BUCKETS, len(languages))), np.zeros(len(languages))
    for at in range(0, len(languages), HELD_LANGUAGES):
        some = {x: at + i for i, x in enumerate(languages[at : at + HELD_LANGUAGES])}
        rows = counts.filter(F.col("lang").isin(*some)).toPandas()
        place, bucket = rows["lang"].map(some).to_numpy(np.int64), rows["bucket"].to_numpy(np.int64)
        whole = bucket < 0
        texts[place[whole]] = rows["n"].to_numpy()[whole]
        n[bucket[~whole], place[~whole]] = rows["n"].to_numpy()[~whole]
    return np.log(n + 0.5) - np.log((n + 0.5).sum(axis=0)), np.log(np.maximum(texts, 1) / max(docs, 1))


def _bounded(places: list[int], texts: list[str]) -> Iterator[list[int]]:
    """Places of texts, as many at once as have CHARS characters in sum."""
    some, size = [], 0
    for i in places:
        if some and size + len(texts[i]) > CHARS:
            yield some
            some, size = [], 0
        some.append(i)
        size += len(texts[i])
    if some:
        yield some


#: What a row carries from table to table: the best language and its log likelihood, the sum over all languages of
#: exp((likelihood - best) * share), and that share.
STATE = "held_out boolean, text string, lang_pred string, best double, total double, share double"


def _predicting(languages: list[str], model) -> Callable:
    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, prior = model.value
        for batch in batches:
            names, most, total, share = batch["lang_pred"].tolist(), batch["best"].to_numpy(float, copy=True), batch["total"].to_numpy(float, copy=True), batch["share"].to_numpy(float, copy=True)
            texts = batch["text"].tolist()
            known = [i for i, t in enumerate(texts) if isinstance(t, str) and any(map(str.isalpha, t))]
            for some in _bounded(known, texts):
                row, bucket, count = _sparse([texts[i] for i in some])
                first = np.flatnonzero(np.diff(row, prepend=-1))
                found = np.zeros((len(some), len(languages)))
                for at in range(0, len(row), GATHERED // len(languages) + 1):
                    cut = slice(at, at + GATHERED // len(languages) + 1)
                    inside = np.unique(np.r_[at, first[(first >= at) & (first < cut.stop)]]) - at
                    found[row[at + inside]] += np.add.reduceat(table[bucket[cut]].astype(np.float64) * count[cut, None], inside, axis=0)
                size = np.bincount(row, weights=count, minlength=len(some))
                found += prior
                place = found.argmax(axis=1)  # the first of ties
                now = found.max(axis=1)
                part = np.minimum(1.0, SCORED / np.maximum(size, 1))
                here = np.exp((found - now[:, None]) * part[:, None]).sum(axis=1)
                for i, p, b, t, c in zip(some, place, now, here, part, strict=True):
                    if b > most[i]:  # an earlier language keeps ties
                        names[i], most[i], total[i] = languages[p], b, t + total[i] * np.exp((most[i] - b) * c)
                    else:
                        total[i] += t * np.exp((b - most[i]) * c)
                    share[i] = c
            yield batch.assign(lang_pred=names, best=most, total=total, share=share)

    return predict


def identify(docs: DataFrame, labelled: DataFrame, at_once: int = TABLE_LANGUAGES) -> DataFrame:
    """doc_id, held_out, lang_pred and score for each row of ``docs`` (doc_id, held_out, text), learnt
    from ``labelled`` (text, lang). The score is the posterior of the prediction, for texts of more than
    SCORED n-grams that of an average part of them with so many.

    ``und`` with score 0 where a text is null, has no letter, or nothing was learnt. Ties go to the
    language first in order; repeated rows are judged alike; an empty table gives no rows. Other
    columns are not looked at. There may be any number of languages, of which only the names come to
    the driver together; each ``at_once`` of them cost a pass over the texts.
    """
    counts = counted(labelled)
    languages = sorted((r["lang"], r["n"]) for r in counts.filter("bucket < 0").select("lang", "n").collect())
    total = sum(n for _, n in languages)
    start = docs.select("doc_id", "held_out", "text", F.lit(UNKNOWN).alias("lang_pred"), F.lit(float("-inf")).alias("best"), F.lit(0.0).alias("total"), F.lit(1.0).alias("share"))
    state = start
    for at in range(0, len(languages), at_once):
        some = [x for x, _ in languages[at : at + at_once]]
        table, prior = table_of(counts, some, total)
        model = docs.sparkSession.sparkContext.broadcast((table.astype(np.float32), prior))
        state = map_ids(state, _predicting(some, model), STATE)
        if at + at_once < len(languages):
            state = written(state, "language-state")
    return state.select("doc_id", "held_out", "lang_pred", F.when(F.col("total") > 0, 1 / F.col("total")).otherwise(0.0).alias("score"))
