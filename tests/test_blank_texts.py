"""Documents without a line have no title, and queries over titles keep them."""

from __future__ import annotations

import pytest

from quire.plans import registry
from quire.sources import adapters as A

TEXTS = {
    0: None, 1: "", 2: " \n\u00a0\n", 3: "\n The small word and \nsecond line", 4: "\n\n", 5: "\u00a0\u3000The art with\u2003\nmore", 7: "", 10: None, 13: "Of Art",
}
TITLES = {i: None for i in TEXTS} | {3: "The small word and", 5: "The art with", 13: "<b>Of Art</b>"}


@pytest.fixture(scope="module")
def blank(spark, sf, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("blank"))
    spark.createDataFrame([(i, t, "en", "web") for i, t in TEXTS.items()], "doc_id long, text string, lang string, source string").write.parquet(f"{d}/documents.parquet")
    for name in ("labels", "events", "conversations"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{d}/{name}.parquet")
    return d


def rows(spark, d, name, *columns):
    return [tuple(r) for r in registry.queries()[name](spark, d).select(*columns).collect()]


def test_titles_of_texts_without_lines(spark, blank):
    assert {r.paper_id: r.title for r in A.papers(spark, blank).collect()} == TITLES
    assert {(r.version_id, r.p) for r in A.blocks(spark, blank).collect()} == {(3, 0), (3, 1), (5, 0), (5, 1), (13, 0)}


def test_apply_metadata(spark, blank):
    want = TITLES | {4: "New", 10: "New"}
    assert sorted(rows(spark, blank, "apply_metadata", "paper_id", "title")) == sorted(want.items())


def test_build_index(spark, blank):
    want = [("and", 1, 1), ("art", 2, 2), ("b", 1, 2), ("of", 1, 1), ("small", 1, 1), ("the", 2, 2), ("with", 1, 1), ("word", 1, 1)]
    assert sorted(rows(spark, blank, "build_index", "term", "docs", "tf")) == want


def test_clean_titles(spark, blank):
    want = {i: (t, False) for i, t in TITLES.items()} | {13: ("Of Art", True)}
    assert {i: (t, c) for i, t, c in rows(spark, blank, "clean_titles", "paper_id", "title", "changed")} == want


def test_highlight(spark, blank):
    want = [(3, 1, True, "The"), (3, 2, False, "small word"), (3, 3, True, "and"), (5, 1, True, "The"), (5, 2, False, "art with"), (13, 1, False, "<b>Of Art</b>")]
    assert sorted(rows(spark, blank, "highlight", "doc", "run", "match", "part")) == want


def test_index_positions(spark, blank):
    words = {3: ["the", "small", "word", "and"], 5: ["the", "art", "with"], 13: ["b", "of", "art", "b"]}
    want = sorted((w, doc, len(ws), k) for doc, ws in words.items() for k, w in enumerate(ws))
    assert sorted(rows(spark, blank, "index_positions", "term", "doc", "len", "pos")) == want


def test_index_terms(spark, blank):
    want = [("and", 1), ("art", 2), ("b", 1), ("of", 1), ("small", 1), ("the", 2), ("with", 1), ("word", 1)]
    assert sorted(rows(spark, blank, "index_terms", "word", "df")) == want


def test_list_papers(spark, blank):
    assert rows(spark, blank, "list_papers", "paper_id", "title") == [(i, TITLES[i]) for i in (4, 13, 10, 7, 5, 3, 2, 1)]


def test_repair_titles(spark, blank):
    want = TITLES | {0: "paper_final.pdf"}
    assert sorted(rows(spark, blank, "repair_titles", "paper_id", "title")) == sorted(want.items())


def test_search_phrases(spark, blank):
    assert rows(spark, blank, "search_phrases", "query_id", "rank", "doc") == [("a", 1, 3)]


def test_search_titles(spark, blank):
    assert rows(spark, blank, "search_titles", "query_id", "rank", "doc") == [("q1", 1, 5)]


def test_validate_metadata(spark, blank):
    want = {0: "title,year", 1: "doi", 2: "doi", 3: "", 4: "doi", 5: "", 7: "doi", 10: "title", 13: "doi"}
    assert dict(rows(spark, blank, "validate_metadata", "paper_id", "errors")) == want
