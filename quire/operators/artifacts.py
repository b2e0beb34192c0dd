"""Artifacts of answers: fenced blocks that can be opened on their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: kinds of artifacts and the titles of those that have none
TITLES = {"html": "HTML 페이지", "svg": "그림", "mermaid": "다이어그램", "react": "React 화면", "markdown": "문서", "code": "코드"}
#: At most three spaces, three or more of one sign, and the rest of the line.
MARK = r"^( {0,3})(`{3,}|~{3,})(.*)$"


def _lines(markdown: Column) -> Column:
    return F.split(F.regexp_replace(F.coalesce(markdown, F.lit("")), r"\n\z", ""), "\n")


def fences(answers: DataFrame) -> DataFrame:
    """(answer_id, number, first, last, info, content): fenced blocks by the rules of CommonMark.

    ``first`` is the line that opens a block and ``last`` the one that closes it, or the number of lines if none does. A
    block is closed by as many of its sign or more, with nothing behind them; the information behind backticks has none.
    Lines lose as many spaces as the opening one has. The fold over the lines of an answer holds where a block was
    opened, and no lines.
    """
    opens = lambda x: (F.regexp_extract(x, MARK, 2) != "") & ~(F.regexp_extract(x, MARK, 2).startswith("`") & F.regexp_extract(x, MARK, 3).contains("`"))
    closes = lambda x: F.regexp_extract(x, r"^ {0,3}(`{3,}|~{3,})[ \t]*$", 1)
    marks = F.transform(F.col("lines"), lambda x, i: F.struct(i.alias("i"), F.when(opens(x), F.regexp_extract(x, MARK, 2)).otherwise("").alias("mark"), closes(x).alias("end")))
    marks = F.filter(marks, lambda m: (m["mark"] != "") | (m["end"] != ""))
    zero = F.struct(F.lit(-1).alias("at"), F.lit("").alias("mark"), F.array().cast("array<struct<first:int,last:int>>").alias("done"))

    def step(a: Column, m: Column) -> Column:
        shut = F.concat(a["done"], F.array(F.struct(a["at"].alias("first"), m["i"].alias("last"))))
        return (
            F.when((a["at"] < 0) & (m["mark"] != ""), F.struct(m["i"].alias("at"), m["mark"].alias("mark"), a["done"].alias("done")))
            .when((a["at"] >= 0) & m["end"].startswith(a["mark"]), F.struct(F.lit(-1).alias("at"), F.lit("").alias("mark"), shut.alias("done")))
            .otherwise(a)
        )

    open_end = lambda a: F.when(a["at"] < 0, a["done"]).otherwise(F.concat(a["done"], F.array(F.struct(a["at"].alias("first"), F.size("lines").alias("last")))))
    a = answers.select("answer_id", _lines(F.col("markdown")).alias("lines"))
    f = a.select("answer_id", "lines", F.posexplode(F.aggregate(marks, zero, step, open_end)).alias("number", "f")).select("answer_id", "lines", "number", "f.*")
    head = F.get("lines", F.col("first"))
    spaces = F.concat(F.lit("^ {0,"), F.length(F.regexp_extract(head, MARK, 1)).cast("string"), F.lit("}"))
    body = F.transform(F.slice("lines", F.col("first") + 2, F.greatest(F.col("last") - F.col("first") - 1, F.lit(0))), lambda x: F.regexp_replace(x, spaces, F.lit("")))
    return f.select("answer_id", "number", "first", "last", F.trim(F.regexp_extract(head, MARK, 3)).alias("info"), F.array_join(body, "\n").alias("content"))


def artifacts(answers: DataFrame) -> DataFrame:
    """(answer_id, number, kind, title, language, content, first, last): the artifacts of each answer in order.

    A block whose language is ``artifact`` has its kind, title and, for code, language in fields behind it; without a
    known kind it is none. Of other blocks, whole html documents, svg elements and mermaid diagrams are artifacts. A
    missing title is that of its kind, for html documents first that of the document.
    """
    field = lambda name: F.trim(F.regexp_extract("meta", rf'(?<![A-Za-z0-9_]){name}="([^"]*)"', 1))
    b = fences(answers).withColumn("word", F.regexp_extract("info", r"^[^ \t]*", 0)).withColumn("meta", F.expr("substr(info, length(word) + 1)"))
    b = b.withColumn("start", F.lower(F.substring(F.regexp_replace("content", r"^\s+", ""), 1, 32)))
    given, low = F.col("word") == "artifact", F.lower("word")
    plain = (
        F.when((low == "html") & F.col("start").rlike(r"^(?:<!doctype html|<html[\s>])"), "html").when((low == "svg") & F.col("start").rlike(r"^<svg[\s>]"), "svg")
        .when((low == "mermaid") & F.col("content").rlike(r"\S"), "mermaid")
    )
    kind = F.when(given, F.when(field("type").isin(*TITLES), field("type"))).otherwise(plain)
    b = b.withColumn("kind", kind).filter("kind is not null")
    own = F.when(given, field("title")).when(F.col("kind") == "html", F.trim(F.regexp_extract("content", r"(?is)<title[^>]*>([^<]*)</title>", 1)))
    usual = F.element_at(F.create_map(*[F.lit(x) for pair in TITLES.items() for x in pair]), F.col("kind"))
    language = F.when(given & (F.col("kind") == "code"), F.nullif(field("language"), F.lit("")))
    order = F.row_number().over(Window.partitionBy("answer_id").orderBy("first")) - 1
    return b.select("answer_id", order.alias("number"), "kind", F.coalesce(F.nullif(own, F.lit("")), usual).alias("title"), language.alias("language"), "content", "first", "last")


def without_artifacts(answers: DataFrame) -> DataFrame:
    """(answer_id, markdown): answers with each artifact as one line that names it; other blocks stay."""
    spans = artifacts(answers).groupBy("answer_id").agg(F.collect_list(F.struct("first", "last", "title")).alias("spans"))
    a = answers.select("answer_id", "markdown", _lines(F.col("markdown")).alias("lines")).join(spans, "answer_id", "left")

    def shown(x: Column, i: Column) -> Column:
        here = F.get(F.filter("spans", lambda s: (s["first"] <= i) & (i <= s["last"])), F.lit(0))
        return F.when(here.isNull(), x).when(here["first"] == i, F.concat(F.lit("[artifact: "), here["title"], F.lit("]")))

    text = F.array_join(F.filter(F.transform("lines", shown), lambda x: x.isNotNull()), "\n")
    return a.select("answer_id", F.when(F.col("spans").isNull(), F.col("markdown")).otherwise(text).alias("markdown"))
