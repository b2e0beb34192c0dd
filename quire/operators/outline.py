"""The outline of a version: which blocks are headings, and of which level."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: headings without a number, and the words that begin an appendix
NAMES = (
    "abstract", "introduction", "related work", "background", "conclusion", "conclusions", "discussion", "references", "bibliography",
    "acknowledgment", "acknowledgments", "acknowledgement", "acknowledgements", "초록", "요약", "서론", "결론", "참고문헌", "참고 문헌",
)
APPENDIX_WORDS = ("appendix", "appendices")
#: Most words and characters of a heading, and by how much a number may jump beyond the next one.
MOST_WORDS, MOST_CHARS, JUMP = 12, 120, 2
#: Roman numbers from 1 to 39, by rule.
ROMANS = [t * "X" + o for t in range(4) for o in ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX")][1:]


def _heads(x: Column) -> Column:
    """Whether ``x`` can be a heading's title: short, begun by a letter that is no small one, with two letters, not a sentence."""
    words = F.split(x, r"\s+")
    letters = F.length(F.regexp_replace(x, r"\P{L}", ""))
    return (F.length(x) <= MOST_CHARS) & (F.size(words) <= MOST_WORDS) & x.rlike(r"^\p{L}") & ~x.rlike(r"^\p{Ll}") & (letters > 1) & ~x.endswith(".")


def _capitalised(x: Column) -> Column:
    """Whether all words of more than three characters that begin with a letter begin with a capital."""
    return ~F.exists(F.split(x, r"\s+"), lambda w: (F.length(w) > 3) & w.rlike(r"^\p{L}") & ~w.rlike(r"^\p{Lu}"))


def _once(b: DataFrame, *columns: Column | str) -> DataFrame:
    """``b`` with more columns that are evaluated once a row: as fields of one exploded struct, they are not copied into the
    filters and columns that use them."""
    kept = [c for c in b.columns if c not in [x for x in columns if isinstance(x, str)]]
    return b.select(*kept, F.explode(F.array(F.struct(*columns))).alias("_made")).select(*kept, "_made.*")


def candidates(blocks: DataFrame) -> DataFrame:
    """(version_id, p, page_index, title, number, section, fixed, letter): blocks that may be headings.

    The first word is split off; what it is made of tells the kind, and the rest is tested as a title.
    One of the last four is set: the parts of a decimal number, a Roman number, the level of a heading that
    stands by itself, or the place of a letter in the alphabet.
    """
    col = F.col
    one_line = (F.coalesce("lines", F.lit(1)) if "lines" in blocks.columns else F.lit(1)) == 1
    b = blocks.select("version_id", "p", "page_index", F.trim("text").alias("text"), one_line.alias("one_line"))
    # all kinds but the numbered ones are short
    b = _once(b.filter(col("text").rlike(r"^\d{1,2}(?:\.\d{1,2}){0,3}\.?\s") | (F.length("text") <= MOST_CHARS)), "text", F.regexp_extract("text", r"^\S+", 0).alias("first"))
    b = _once(b, F.regexp_replace(F.expr("substr(text, length(first) + 1)"), r"^\s+", "").alias("rest"), col("first").endswith(".").alias("dotted"), F.split(F.regexp_replace("first", r"\.$", ""), r"\.").alias("pieces"))
    size, head = F.size("pieces"), F.get("pieces", F.lit(0))
    small_number = lambda x: x.rlike("^[0-9]{1,2}$")
    is_number = (size <= 4) & F.forall("pieces", small_number) & (col("rest") != "")
    is_letter = head.rlike("^[A-Z]$")
    is_appended = is_letter & size.between(2, 4) & F.forall(F.slice("pieces", 2, 4), small_number) & (col("rest") != "")
    roman = F.array_position(F.array(*map(F.lit, ROMANS)), head)
    before_mark = F.split("rest", r"[.:]\s", 2)
    short = (F.length("text") <= MOST_CHARS) & (F.size(F.split("text", r"\s+")) <= MOST_WORDS)
    head_text = F.when(col("one_line") | (short & _heads(col("rest")) & _capitalised(col("rest"))), col("rest")).when((F.size(before_mark) > 1) & _capitalised(before_mark[0]), before_mark[0])
    b = _once(b, is_number.alias("is_number"), short.alias("short"), F.when(is_number, head_text).alias("title"), F.lower(F.regexp_replace(F.regexp_replace("text", r"\s*:\s*$", ""), r"\s+", " ")).alias("bare"))
    is_number, short, title, bare = col("is_number"), col("short"), col("title"), col("bare")
    alone = ~is_number & col("one_line") & short
    word = lambda i: F.regexp_extract(F.coalesce(F.get(F.split(bare, " "), F.lit(i)), F.lit("")), r"^\w*", 0)
    lone_letter = F.get(F.split(bare, " "), F.lit(0)).rlike(r"^[a-z]\.?$")
    is_named = bare.isin(*NAMES) | word(0).isin(*APPENDIX_WORDS) | (lone_letter & word(1).isin(*APPENDIX_WORDS))
    number = F.when(is_number & (title != "") & _heads(title), F.transform("pieces", lambda x: x.cast("int")))
    section = F.when(alone & col("dotted") & (size == 1) & (roman > 0) & _heads(col("rest")) & (col("rest") == F.upper("rest")), roman.cast("int"))
    fixed = F.when(alone & is_appended, F.when(_heads(col("rest")), F.length(F.regexp_replace("first", "[^.]", "")) + 1)).when(alone & is_named, 1)
    letter = F.when(alone & ~is_appended & ~is_named & is_letter & (size == 1) & col("dotted") & _heads(col("rest")), F.ascii("first") - 64)
    shown = F.when(is_number, F.concat(F.expr("substr(text, 1, length(text) - length(rest))"), title)).otherwise(col("text"))
    kinds = _once(b, number.alias("number"), section.alias("section"), fixed.cast("int").alias("fixed"), letter.cast("int").alias("letter"))
    out = kinds.filter("number is not null or section is not null or fixed is not null or letter is not null")
    return out.select("version_id", "p", "page_index", F.regexp_replace(shown, r":*\s*$", "").alias("title"), "number", "section", "fixed", "letter")


def _accepted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The headings among the candidates, which come by version and place, each judged by the last accepted one of
    its version. Only the state of the version at hand is kept, also from batch to batch."""
    version = object()
    number, section, letter = [0], 0, 0
    follows = lambda x, last: x is not None and last < x <= last + JUMP
    for batch in batches:
        levels = []
        for v, n, s, f, x in zip(*(batch.column(c).to_pylist() for c in ("version_id", "number", "section", "fixed", "letter")), strict=True):
            if v != version:
                version, number, section, letter = v, [0], 0, 0
            level = 0
            if n is not None:
                if n > number and n[0] <= number[0] + JUMP:
                    number, level = n, len(n)
            elif follows(s, section):
                section, letter, level = s, 0, 1
            elif f is not None:
                level = f
            elif section and follows(x, letter):
                letter, level = x, 2
            levels.append(level)
        out = batch.select(["version_id", "p", "page_index", "title"]).append_column("level", pa.array(levels, pa.int32()))
        yield out.filter(pa.array([x > 0 for x in levels], pa.bool_()))


def outline(blocks: DataFrame) -> DataFrame:
    """Headings of all kinds in order: (version_id, p, page_index, title, level).

    Numbered ones (also wrapped over lines, or run in before a paragraph) rise above the last accepted
    number, with a jump of at most two in its first part; sections with Roman numbers in capitals and
    their lettered subsections follow one another likewise; numbered appendices and named headings
    stand by themselves. All but numbered ones are one short line; a column ``lines`` tells the lines of a
    block, one if it is absent. The candidates of a version pass one by one, in order.
    """
    kind = blocks.schema["version_id"].dataType.simpleString()
    ordered = candidates(blocks).repartition("version_id").sortWithinPartitions("version_id", "p")
    return ordered.mapInArrow(_accepted, f"version_id {kind}, p int, page_index int, title string, level int")
