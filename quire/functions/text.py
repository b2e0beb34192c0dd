"""Column expressions and the few functions that Spark lacks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Flags of blocks that are no body text.
NOT_BODY = ("in_figure", "in_table", "math", "page_header", "page_footer", "reference", "side_text")


def not_body(flags: Column) -> Column:
    return F.arrays_overlap(flags, F.array(*map(F.lit, NOT_BODY)))


def collapsed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def nfkc(df: DataFrame, column: str, lower: bool = False) -> DataFrame:
    """``column`` in NFKC, in lower case if asked. Only distinct values outside ASCII go through
    Python; they are joined back."""
    ascii_only = F.col(column).rlike(r"^\p{ASCII}*$") | F.col(column).isNull()

    def fold(values: pd.Series) -> pd.Series:
        return values.map(lambda x: unicodedata.normalize("NFKC", x))

    other = df.filter(~ascii_only).select(F.col(column).alias("_raw")).distinct().withColumn("_nfkc", F.pandas_udf(fold, "string")("_raw"))
    out = df.join(other, df[column] == other["_raw"], "left").withColumn(column, F.coalesce("_nfkc", column)).drop("_raw", "_nfkc")
    return out.withColumn(column, F.lower(column)) if lower else out


# fixed values: suffixes and what becomes of them in the published 1980 stemmer, by step
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _kinds(stem: str) -> str:
    """The letters of ``stem`` as v and c; y is a vowel behind a consonant."""
    out = ""
    for c in stem:
        out += "v" if c in "aeiou" or (c == "y" and out.endswith("c")) else "c"
    return out


def _measure(stem: str) -> int:
    """How many times vowels are followed by consonants."""
    return _kinds(stem).count("vc")


def _ends_short(stem: str) -> bool:
    """Whether ``stem`` ends with consonant, vowel and a consonant other than w, x and y."""
    return _kinds(stem).endswith("cvc") and stem[-1] not in "wxy"


def porter_step1(word: str) -> str:
    """Plurals and participles of the published 1980 stemmer (its steps 1a to 1c)."""
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    else:
        cut = next((word[: -len(end)] for end in ("ed", "ing") if word.endswith(end) and "v" in _kinds(word[: -len(end)])), None)
        if cut is not None:
            double = len(cut) > 1 and cut[-1] == cut[-2] and _kinds(cut)[-1] == "c" and cut[-1] not in "lsz"
            word = cut + "e" if cut.endswith(("at", "bl", "iz")) else cut[:-1] if double else cut + "e" if _measure(cut) == 1 and _ends_short(cut) else cut
    return word[:-1] + "i" if word.endswith("y") and "v" in _kinds(word[:-1]) else word


def porter_stem(word: str) -> str:
    """The stem of a lower-case word by the published 1980 rules; words of one or two letters are their own."""
    if len(word) < 3:
        return word
    word = porter_step1(word)
    for rules in (STEP2, STEP3):  # the longest suffix decides, whether or not its stem is long enough
        rule = max((r for r in rules if word.endswith(r[0])), key=lambda r: len(r[0]), default=None)
        if rule and _measure(word[: -len(rule[0])]) > 0:
            word = word[: -len(rule[0])] + rule[1]
    end = max((s for s in STEP4 if word.endswith(s)), key=len, default="")
    stem = word[: len(word) - len(end)]
    if end and _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
        word = stem
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _ends_short(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


def stemmed(terms: DataFrame, column: str = "term") -> DataFrame:
    """``terms`` with ``column`` stemmed; each distinct term goes through Python once."""

    def stem(values: pd.Series) -> pd.Series:
        return values.map(porter_stem)

    vocabulary = terms.select(F.col(column).alias("_term")).distinct().withColumn("_stem", F.pandas_udf(stem, "string")("_term"))
    return terms.join(vocabulary, terms[column] == vocabulary["_term"]).withColumn(column, F.col("_stem")).drop("_term", "_stem")


def folded_terms(terms: DataFrame, column: str, stem: bool, all_ascii: bool = False) -> DataFrame:
    """``terms`` with ``column``_folded, NFKC in lower case without diacritics, and ``column``_stem, which
    is the stem of that if asked. Meant for tables of distinct words or of query terms; without stems, those
    that are ``all_ascii`` need no Python."""

    def fold(values: pd.Series) -> pd.Series:
        bare = values.map(lambda x: "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).lower())
        return bare

    def stem_of(values: pd.Series) -> pd.Series:
        return values.map(porter_stem)

    ascii_only = F.col(column).rlike(r"^\p{ASCII}*$")
    folded = F.lower(column) if all_ascii else F.when(ascii_only, F.lower(column)).otherwise(F.pandas_udf(fold, "string")(column))
    out = terms.withColumn(f"{column}_folded", folded)
    return out.withColumn(f"{column}_stem", F.pandas_udf(stem_of, "string")(f"{column}_folded") if stem else F.col(f"{column}_folded"))
