"""Languages in several tables, and many of them."""


def test_several_tables_are_one(spark, sf):
    from quire.llm.langid import identify

    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "doc_id % 3 = 1 as held_out", "text", "lang")
    whole, parts = ({r.doc_id: r for r in identify(docs, docs.filter("not held_out"), n).collect()} for n in (256, 1))
    assert {k: r.lang_pred for k, r in whole.items()} == {k: r.lang_pred for k, r in parts.items()}
    assert all(abs(r.score - parts[k].score) < 1e-9 and 0 <= r.score <= 1 for k, r in whole.items())


def test_more_languages_than_a_table_holds(spark):
    from quire.llm.langid import identify

    word = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3))
    rows = [(i, False, f"{word(i * 37)} " * 8, f"l{i:03}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, held_out boolean, text string, lang string").repartition(2)
    out = identify(df, df).collect()
    assert len(out) == 300 and sum(r.lang_pred == f"l{r.doc_id:03}" for r in out) == 300
    assert [r.lang_pred for r in identify(df.limit(1), df.limit(0)).collect()] == ["und"] and identify(df.limit(0), df).count() == 0
