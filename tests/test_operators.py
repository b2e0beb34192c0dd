"""Golden rows and invariants of the operators outside the training-data subpackage."""

import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from quire.functions.canonical import canonical_json
from quire.functions.scratch import scratch_dir
from quire.functions.text import folded_terms, nfkc, porter_stem, porter_step1, stemmed
from quire.operators import answers as N
from quire.operators import artifacts as AR
from quire.operators import bundles as E
from quire.operators import cascade as C
from quire.operators import glyphs as G
from quire.operators import layout as Y
from quire.operators import library as L
from quire.operators import packets as K
from quire.operators import quotes as Q
from quire.operators import search as R
from quire.operators import search_index as X
from quire.operators import structure as S
from quire.operators import threads as H
from quire.operators import translation as T
from quire.operators.outline import outline
from quire.plans import registry
from quire.sources import adapters as A
from quire.sources import bundle_store as P
from quire.sources import library as SRC
from quire.sources import snapshots as SN
from quire.streaming import jobs

BLOCK = "version_id long, p int, page_index int, reading_order int, text string, x0 double, y0 double, x1 double, y1 double, font_size double, quality_flags array<string>"


def blocks(spark, texts, page=lambda p: p // 5, size=lambda p: 10.0, flags=lambda p: []):
    return spark.createDataFrame([(1, p, page(p), p % 5, t, 0.1, 0.2 + 0.1 * (p % 5), 0.9, 0.25 + 0.1 * (p % 5), size(p), flags(p)) for p, t in enumerate(texts)], BLOCK)


def sentences(spark, text):
    return [r.sentence for r in T.sentences(blocks(spark, [text])).orderBy("sentence_no").collect()]


def test_sentences(spark):
    assert len(sentences(spark, "As shown in Fig. 6 and Eq. 3, e.g. the delay of tasks, i.e. the WCET, grows. J. Xiao et al. proposed it. It is fast vs. slow.")) == 3
    assert len(sentences(spark, 'The ratio is 0.5 (see Sec. 2). He said "done." Then it ended [12]. Next one')) == 4
    assert sentences(spark, "  ") == [] and sentences(spark, "no end") == ["no end"]


def test_headings_and_paths(spark):
    titles = ["Abstract", "1 Introduction", "2 System Model", "2.1 Tasks", "2.1.1 Periods", "body", "2.2 Caches", "3 RESULTS", "10 Conclusion"]
    b = blocks(spark, titles)
    h = S.headings(b)
    assert [(r.title, r.level) for r in h.orderBy("p").collect()] == [("1 Introduction", 1), ("2 System Model", 1), ("2.1 Tasks", 2), ("2.1.1 Periods", 3), ("2.2 Caches", 2), ("3 RESULTS", 1)]
    paths = {r.p: r.section for r in S.section_paths(b, h).collect()}
    assert paths[0] is None and paths[5] == "2 System Model › 2.1 Tasks › 2.1.1 Periods" and paths[6] == "2 System Model › 2.2 Caches"


def test_references_and_citations(spark):
    b = blocks(spark, ["text [1, 2] see", "References", "[1] A. One", "[2] B. Two", "Appendix", "more"])
    assert sorted(r.p for r in S.reference_blocks(b).collect()) == [1, 2, 3]
    assert {(r.n, r.entry_p) for r in S.link_citations(b).collect()} == {(1, 2), (2, 3)}


def test_figures_and_dois(spark):
    b = blocks(spark, ["see doi 10.1000/ab(c)).", "Fig. 2. A plot", "Fig. 2. Again", "Fig. 3. " + "x" * 400])
    assert S.find_dois(b).first().doi == "10.1000/ab(c)"
    f = {r.label: r.caption for r in S.numbered_figures(b).collect()}
    assert f[2] == "Fig. 2. A plot" and len(f[3]) == 300 and f[3].endswith("…")


def test_title(spark):
    b = blocks(spark, ["Two words", "body of the paper " * 9], size=lambda p: 14.0 if p == 0 else 10.0)
    assert S.title_from_blocks(b).first().title == "Two words"


def test_page_and_document_status(spark):
    rows = [(1, 0, 500, 0, 0.1), (1, 1, 500, 20, 0.1), (2, 0, 5, 0, 0.9), (3, 0, 100, 60, 0.1), (4, 0, 500, 0, 0.1)]
    pages = S.classify_pages(spark.createDataFrame(rows, "version_id long, page_index int, chars long, unmapped long, coverage double"))
    assert [r.text_status for r in pages.orderBy("version_id", "page_index").collect()] == ["usable", "partial", "image_only", "unreadable", "usable"]
    assert {r.version_id: (r.status, r.reason) for r in S.document_status(pages).collect()} == {1: ("PARTIAL", "UNMAPPED_CHARS"), 2: ("FAILED", "NO_TEXT_LAYER"), 3: ("FAILED", "UNREADABLE_TEXT"), 4: ("INDEXED", None)}


def test_citations_of_answers(spark):
    a = spark.createDataFrame([(1, "[cite 22¶3] x [cite 22] y [cite 20¶1, 22¶3, 5] [12] [cite 7 ¶ 2]")], "answer_id long, markdown string")
    got = [(r.number, r.paragraph) for r in N.extract_citations(a).orderBy("pos").collect()]
    assert got == [(22, 3), (22, None), (20, 1), (5, None), (7, 2)]
    e = spark.createDataFrame([(1, 22, 2), (1, 7, 2)], "answer_id long, number int, paragraphs int")
    out = {(r.number, r.resolved, r.paragraph) for r in N.resolve_citations(N.extract_citations(a), e).collect()}
    assert (22, True, None) in out and (7, True, 2) in out and (5, False, None) in out


def test_artifacts(spark):
    text = "x\n```html A title\n<p>\n</p>\n```\ny\n  ```mermaid\ng"
    a = spark.createDataFrame([(1, text), (2, None), (3, "none")], "answer_id long, markdown string")
    got = [(r.language, r.title, r.content) for r in N.extract_artifacts(a).orderBy("answer_id", "number").collect()]
    assert got == [("html", "A title", "<p>\n</p>"), ("mermaid", "", "g")]
    assert N.strip_artifacts(a.filter("answer_id = 1")).first().markdown == "x\n[artifact: A title]\ny\n  ```mermaid\ng"


def test_query_parsing(spark):
    q = spark.createDataFrame([(1, '"cache affinity" EDF'), (2, "alphaword OR betaword"), (3, "  -- !! ")], "query_id int, query string")
    got = [(r.query_id, r.tokens, r.is_prefix) for r in R.parse_queries(q).orderBy("query_id", "term_no").collect()]
    assert got == [(1, ["cache", "affinity"], False), (1, ["edf"], True), (2, ["alphaword"], True), (2, ["or"], True), (2, ["betaword"], True)]


def test_highlight(spark):
    hits = spark.createDataFrame([(1, "Cache Partitioning for Systems")], "doc long, text string")
    got = [(r.part, r.match) for r in R.highlight(hits, "text", ["partitioning", "systems"]).orderBy("run").collect()]
    assert got == [("Cache", False), ("Partitioning", True), ("for", False), ("Systems", True)]


def test_budgets(spark):
    items = spark.createDataFrame([(1, 0, 1, "a" * 50), (1, 1, 2, "b" * 60), (1, 2, 1, "c"), (1, 3, 3, "d" * 50)], "packet_id long, rank int, block_id long, text string")
    assert [(r.kept, r.reason) for r in K.apply_budget(items, 100).orderBy("rank").collect()] == [(True, None), (False, "text_budget"), (False, "repeated"), (True, None)]
    b = blocks(spark, ["x" * 10, "y" * 10, "z" * 10, "w" * 10], page=lambda p: p)
    got = [(r.page_index, r.text, r.truncated, r.excluded) for r in K.page_text_evidence(b, 15).orderBy("page_index").collect()]
    assert got == [(0, "x" * 10, False, False), (1, "y" * 5, True, False), (2, None, False, True)]


@pytest.mark.parametrize("sizes", [[700, 800, 10, 900, 1200, 40], [100], [2073, 300, 1900, 992], [500, 500, 500, 500, 500], [99, 377, 241, 306, 1173], [1173, 10, 20]])
def test_batches(spark, sizes):
    from itertools import combinations

    got = T.translation_batches(blocks(spark, ["x" * n for n in sizes], page=lambda p: 0)).orderBy("p").collect()
    k = max(1, min(4, sum(sizes) // 600, len(sizes)))
    largest = lambda cuts: max(sum(sizes[a:b]) for a, b in zip((0, *cuts), (*cuts, len(sizes)), strict=True))
    want = min((largest(c), c) for c in combinations(range(1, len(sizes)), k - 1))
    assert got[0].largest == want[0] and [r.batch for r in got] == [sum(i >= c for c in want[1]) for i in range(len(sizes))]


def test_page_runs_and_ranges(spark):
    pages = spark.createDataFrame([(1, p - 1) for p in (3, 4, 5, 27, 28, 29)], "version_id long, page_index int")
    assert L.page_runs(pages).first().pages == "3–5, 27–29"
    specs = spark.createDataFrame([(1, "1-4, 27", 40)], "version_id long, spec string, page_count int")
    assert sorted(r.page_index for r in L.filter_page_ranges(pages, specs).collect()) == [2, 3, 26]
    for bad in ("0-2", "5-3", "1-99", "x", ""):
        assert L.filter_page_ranges(pages, specs.withColumn("spec", F.lit(bad))).count() == 0


def test_text_functions(spark):
    df = spark.createDataFrame([("ﬁne",), ("plain",), (None,), ("Ａ",)], "t string")
    assert sorted(r.t or "" for r in nfkc(df, "t", lower=True).collect()) == ["", "a", "fine", "plain"]
    assert [porter_step1(w) for w in ("caresses", "ponies", "cats", "plastered", "motoring", "hopping", "sized", "happy", "sky")] == ["caress", "poni", "cat", "plaster", "motor", "hop", "size", "happi", "sky"]
    words = "relational conditional rational valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll feed agreed fizzed filing failing generalizations oscillators"
    stems = "relat condit ration valenc hesit digit conform radic differ vile analog vietnam predic oper feudal decis hope callous formal sensit sensibl triplic form formal electr electr hope good reviv allow infer airlin gyroscop adjust defens irrit replac adjust depend adopt homolog commun activ angular homolog effect bowdler probat rate ceas control roll feed agre fizz file fail gener oscil"
    assert [porter_stem(w) for w in words.split()] == stems.split()
    assert sorted(r.term for r in stemmed(spark.createDataFrame([("cats",), ("cats",), ("dog",)], "term string")).collect()) == ["cat", "cat", "dog"]


def test_layout(spark):
    g = [(1, 0, i, c, 10.0 + 6 * i, 100.0, 15.0 + 6 * i, 110.0) for i, c in enumerate("ab")] + [(1, 0, 5, "c", 40.0, 100.0, 45.0, 110.0), (1, 0, 6, "d", 10.0, 80.0, 15.0, 90.0)]
    lines = Y.build_lines(spark.createDataFrame(g, "version_id long, page_index int, seq int, text string, l double, b double, r double, t double"))
    assert [r.text for r in lines.orderBy("line").collect()] == ["ab", "c", "d"]
    assert Y.build_blocks(lines).count() == 3
    kinds = "version_id long, page_index int, kind string, l double, b double, r double, t double, filled boolean, stroked boolean, width double, height double"
    rows = [("image", 0, 0, 50, 50), ("image", 52, 0, 100, 50), ("path", 300, 300, 400, 301), ("path", 0, 0, 600, 800), ("form", 200, 500, 260, 515), ("path", 10, 700, 400, 701), ("path", 12, 600, 402, 601), ("path", 10, 650, 200, 651)]
    df = spark.createDataFrame([(1, 0, k, float(a), float(b), float(c), float(d), False, k == "path", 600.0, 800.0) for k, a, b, c, d in rows], kinds)
    assert [(r.l, r.r, r.source) for r in Y.figure_candidates(df).collect()] == [(200.0, 260.0, "form"), (0.0, 100.0, "image")]
    assert [(r.rule_group, r.l) for r in Y.horizontal_rules(df).filter("t > 500").orderBy(F.desc("t")).collect()] == [(0, 10.0), (1, 10.0), (0, 12.0)]


def test_intake_and_bibliography(spark):
    files = spark.createDataFrame([("a", bytearray(b"%PDF-1.7"), 3), ("b", bytearray(b"hello"), 3), ("c", bytearray(b"x%PDF-"), 900), ("d", bytearray(b"%PDF-"), None)], "path string, content binary, page_count int")
    assert [r.reject_code for r in SRC.screen_intake(files).orderBy("path").collect()] == [None, "NOT_PDF", "RESOURCE_LIMIT", "MALFORMED_PDF"]
    doi = '{"message":{"author":[{"given":"Ada","family":"L  ace"},{"name":"Team"}],"issued":{"date-parts":[[null]]},"published":{"date-parts":[[2019,4]]}}}'
    atom = "<feed><entry><id>http://x/1</id><title>T</title><published>2021-02-03</published><author><name>B C</name></author></entry></feed>"
    bad = "<feed><entry><id>http://x/api/errors#1</id><title>Error</title><published>2021</published></entry></feed>"
    out = [(r.authors, r.year) for r in SRC.decode_bibliography(spark.createDataFrame([("doi", "1", doi), ("arxiv", "2", atom), ("arxiv", "3", bad)], "kind string, value string, body string")).orderBy("value").collect()]
    assert out == [(["Ada L ace", "Team"], 2019), (["B C"], 2021), (None, None)]


def test_library_changes(spark, tmp_path):
    t = spark.createDataFrame([("a", 0, "en", "old"), ("b", 0, "en", "keep")], "version_id string, page_index int, language string, text string")
    u = spark.createDataFrame([("a", 0, "en", "new")], t.schema)
    assert {r.version_id: r.text for r in SRC.upsert_translations(t, u).collect()} == {"a": "new", "b": "keep"}
    ids = spark.createDataFrame([("1",), ("2",)], "paper_id string")
    versions, runs = spark.createDataFrame([("v1", "1"), ("v2", "2")], "version_id string, paper_id string"), spark.createDataFrame([("v1", "FAILED"), ("v2", "RUNNING")], "version_id string, status string")
    left, refused = C.delete_papers({"papers": spark.createDataFrame([("1",), ("2",), ("3",)], "paper_id string"), "source_versions": versions, "parse_runs": runs}, ids)
    assert [r.version_id for r in left["parse_runs"].collect()] == ["v2"] == [r.version_id for r in left["source_versions"].collect()]
    assert {r.paper_id for r in left["papers"].collect()} == {"2", "3"} and [r.paper_id for r in refused.collect()] == ["2"]
    spark.createDataFrame([("1", "Tag")], SRC.SCHEMAS["paper_tags"]).write.parquet(f"{tmp_path}/paper_tags.parquet")
    assert SRC.read_library(spark, str(tmp_path), ["paper_tags"])["paper_tags"].first().tag == "Tag"
    j = spark.createDataFrame([('[{"start":0,"end":2,"mark":"b"}]',), (None,)], "styles string")
    assert [len(r.styles) for r in SRC.decode_json(j, {"styles": "array<struct<start:int,end:int,mark:string>>"}, ("styles",)).collect()] == [1, 0]


def test_bundle_files(spark, tmp_path):
    files = spark.createDataFrame([(1, "texts/a.md", "abc"), (2, "texts/b.md", "d")], "bundle_id long, path string, content string")
    root = f"file://{tmp_path}/out"
    assert P.read_bundles(spark, root).count() == 0 == P.read_manifests(spark, root).count()
    broken = files.withColumn("content", F.when(F.col("bundle_id") == 2, F.raise_error(F.lit("killed"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="killed"):
        P.publish_bundles(broken.repartition(4), root, "a")
    assert P.published_batches(spark, root) == [] and P.read_bundles(spark, root).count() == 0
    # all is written, and the process ends before the marker
    create = P._store
    with pytest.MonkeyPatch.context() as m:
        m.setattr(P, "_store", lambda s, r: NoMarker(create(s, r)))
        with pytest.raises(RuntimeError):
            P.publish_bundles(files, root, "a")
    assert P.read_bundles(spark, root).count() == 0 and P.published_batches(spark, root) == []
    assert P.publish_bundles(files, root, "a") == "a" == P.publish_bundles(files, root, "a")
    assert sorted((r.bundle_id, r.path, bytes(r.content)) for r in P.read_bundles(spark, root).collect()) == [("1", "texts/a.md", b"abc"), ("2", "texts/b.md", b"d")]
    assert P.publish_bundles(files, root, "b") is None and P.broken_files(spark, root).count() == 0
    P.publish_bundles(spark.createDataFrame([(3, "x", "y"), (1, "later", "z")], files.schema), root, "c")
    assert {r.path for r in P.read_manifests(spark, root).collect()} == {"texts/a.md", "texts/b.md", "x"}
    with pytest.MonkeyPatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(P, "_store", lambda s, r: NoMarker(create(s, r)))
        P.publish_bundles(files.withColumn("bundle_id", F.col("bundle_id") + 7), root, "d")
    assert P.clean_up(spark, root) == ["d"] and P.read_bundles(spark, root).count() == 3
    assert {r.size_bytes for r in E.bundle_manifest(files).collect()} == {3, 1}


class NoMarker:
    """A file system whose process ends when a marker is to be made."""

    def __init__(self, store):
        self.store = store

    def create(self, *_):
        raise RuntimeError("killed")

    def __getattr__(self, name):
        return getattr(self.store, name)


def _stream(spark, df, folder):
    df.repartition(2).write.parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _drained(spark, df, mode, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_streams(spark, sf, tmp_path):
    e = A.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    files = e.select("ts", F.sha2((F.col("event_id") % 40).cast("string"), 256).alias("sha256"))
    assert _drained(spark, jobs.stream_dedupe(_stream(spark, files, f"{tmp_path}/a"), late="90 days"), "append", "deduped").count() == 40
    a = A.answers(spark, sf).select("session", "created_at")
    out = _drained(spark, jobs.stream_conversations(_stream(spark, a, f"{tmp_path}/b")), "complete", "talks")
    assert {(r.session, r.answers) for r in out.collect()} == {(r.session, r["count"]) for r in a.groupBy("session").count().collect()}
    w = _drained(spark, jobs.stream_windows(_stream(spark, e, f"{tmp_path}/c"), late="90 days"), "complete", "windows")
    assert w.agg(F.sum("n")).first()[0] == e.count()


def test_stream_latest_matches_batch(spark, sf, tmp_path):
    e = A.table(spark, sf, "events").select("user_id", "event_id", "event_type")
    log = {}
    q = SN.stream_snapshot(_stream(spark, e, f"{tmp_path}/in"), f"{tmp_path}/snapshot", ["user_id"], "event_id", f"{tmp_path}/ck", parts=8, log=log.__setitem__)
    q.awaitTermination(120)
    read = lambda: SN.read_snapshot(spark, f"{tmp_path}/snapshot").drop("part")
    assert len(log) == 2
    want = L.latest_rows(e, e.limit(0), ["user_id"], "event_id")
    assert {tuple(r) for r in read().collect()} == {tuple(r) for r in want.collect()}


def test_expired_runs(spark):
    t = dt.datetime(2024, 1, 1)
    runs = spark.createDataFrame([(1, "RUNNING", 1, t), (2, "RUNNING", 2, t), (3, "RUNNING", 1, dt.datetime(2025, 1, 1)), (4, "DONE", 2, t)], "run_id int, status string, attempts int, lease_expires_at timestamp")
    assert [r.status for r in jobs.expire_runs(runs, "2024-06-01").orderBy("run_id").collect()] == ["QUEUED", "FAILED", "RUNNING", "DONE"]


@pytest.mark.parametrize("name", ["search_blocks", "list_papers", "section_paths", "packet_status", "apply_budget", "sentence_groups", "bundle_refs"])
def test_queries_match_sql(spark, sf, name):
    import duckdb

    c = duckdb.connect()
    for t in ("events", "documents", "pages", "benchmark", "labels", "conversations"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = registry.queries()[name](spark, sf)
    columns = sorted(got.columns)
    want = c.execute(registry.oracle_sql()[name]).df()
    assert sorted(want.columns) == columns
    key = lambda rows: sorted(tuple(str(v) for v in r) for r in rows)
    assert key(got.select(columns).collect()) == key(c.execute("select " + ", ".join(f'"{x}"' for x in columns) + f" from ({registry.oracle_sql()[name]})").fetchall())


def test_forks(spark):
    from quire.operators.threads import conversation_turns

    t = lambda n: dt.datetime(2024, 1, 1, 0, n)
    a = spark.createDataFrame([("a", 1, t(1)), ("a", 2, t(2)), ("a", 3, t(5)), ("b", 4, t(4)), ("c", 5, t(6)), ("x", 6, t(1)), ("y", 7, t(2))], "session string, answer_id long, created_at timestamp")
    f = spark.createDataFrame([("b", "a", 2), ("c", "b", None), ("x", "y", None), ("y", "x", None)], "session string, parent string, at long")
    out = {}
    for r in conversation_turns(a, f).orderBy("position").collect():
        out.setdefault(r.session, []).append((r.answer_id, r.inherited))
    assert out["b"] == [(1, True), (2, True), (4, False)] and out["c"] == [(1, True), (2, True), (4, True), (5, False)]
    assert out["a"] == [(1, False), (2, False), (3, False)] and out["x"] == [(6, False)] and out["y"] == [(7, False)]


def test_styled_sentences(spark):
    from quire.operators.threads import styled_sentences

    b = spark.createDataFrame([(1, 0, "One bold word. Two more.", [(4, 8, "b"), (12, 18, "i")])], "version_id long, p int, text string, styles array<struct<start:int,end:int,mark:string>>")
    assert [r.markup for r in styled_sentences(b).orderBy("n").collect()] == ["One <b>bold</b> wor<i>d.</i>", "<i>Two</i> more."]


def test_enrichment(spark):
    from quire.operators.threads import enrich

    p = spark.createDataFrame([(1, [], None), (2, ["A"], 1999), (3, [], None)], "paper_id long, authors array<string>, year int")
    i = spark.createDataFrame([(1, 0, "doi:x"), (1, 1, "arxiv:y"), (2, 0, "doi:z")], "paper_id long, ordinal int, identifier string")
    r = spark.createDataFrame([("arxiv:y", ["B"], 2001), ("doi:z", ["C"], 2002)], "identifier string, authors array<string>, year int")
    assert {x.paper_id: (x.authors, x.year, x.asked) for x in enrich(p, i, r).collect()} == {1: (["B"], 2001, "arxiv:y"), 2: (["A"], 1999, "doi:z"), 3: ([], None, "none")}


def test_stateful_streams(spark, sf, tmp_path):
    e = A.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).orderBy("ts").coalesce(1)
    changes = e.filter("event_type = 'click'").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts", (F.get_json_object("props", "$.k").cast("int") % 3).alias("expected"))
    changes.write.parquet(f"{tmp_path}/r")
    got = _drained(spark, jobs.stream_revisions(spark.readStream.schema(changes.schema).parquet(f"{tmp_path}/r")), "append", "revisions")
    want = {(r.key, r.revision, r.conflicts) for r in L.apply_revisions(changes).collect()}
    assert {(r.key, r.a, r.c) for r in got.groupBy("key").agg(F.max("revision").alias("a"), F.count_if(~F.col("accepted")).alias("c")).collect()} == want
    kind = F.when(F.col("event_type") == "purchase", "HANDED_OFF").when(F.col("event_type") == "signup", "IMPORTED").when(F.col("event_type") == "error", "CANCELLED")
    moves = e.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts", kind.alias("kind")).filter("kind is not null")
    moves.write.parquet(f"{tmp_path}/m")
    got = _drained(spark, jobs.stream_packets(spark.readStream.schema(moves.schema).parquet(f"{tmp_path}/m")), "append", "moves")
    want = {(r.key, r.status, r.illegal) for r in L.packet_status(moves).collect()}
    assert {(r.key, r.s, r.c) for r in got.groupBy("key").agg(F.max_by("status", "id").alias("s"), F.count_if(~F.col("legal")).alias("c")).collect()} == want
    rows = [("s", "k", 1, "a", "r1", 1), ("s", "k", 2, "a", "r2", 2), ("s", "k", 3, "b", "r3", 3), ("s", "j", 4, "b", "r4", 4)]
    q = spark.createDataFrame(rows, "scope string, key string, request_id long, body string, response string, ts long")
    q.coalesce(1).write.parquet(f"{tmp_path}/q")
    got = _drained(spark, jobs.stream_idempotent(spark.readStream.schema(q.schema).parquet(f"{tmp_path}/q")), "append", "requests")
    assert {(r.request_id, r.response, r.conflict) for r in got.collect()} == {(1, "r1", False), (2, "r1", False), (3, None, True), (4, "r4", False)}


def test_tables_layout_and_figures(spark):
    rules = spark.createDataFrame([(1, 0, 0, 10.0, 700.0, 400.0, 701.0), (1, 0, 0, 10.0, 600.0, 400.0, 601.0), (1, 0, 0, 10.0, 400.0, 400.0, 401.0)], "version_id long, page_index int, rule_group int, l double, b double, r double, t double")
    rows = [(0, "cell", 20, 650, 60, 660, 1), (1, "Table 1. Caption", 20, 660, 90, 670, 1), (2, "body " * 50, 10, 500, 390, 540, 4), (3, "outside", 20, 300, 60, 310, 1)]
    b = spark.createDataFrame([(1, 0, p, t, float(a), float(c), float(d), float(e), n) for p, t, a, c, d, e, n in rows], "version_id long, page_index int, p int, text string, l double, b double, r double, t double, n_lines int")
    assert [r.p for r in Y.flag_tables(b, rules).collect()] == [0]
    box = spark.createDataFrame([(1, 0, p, t, 0.1, y, 0.9, y + 0.05) for p, t, y in [(0, "x", 0.1), (1, "Fig. 1. c", 0.3), (2, "9", 0.94)]], "version_id long, page_index int, p int, text string, x0 double, y0 double, x1 double, y1 double")
    regions = spark.createDataFrame([(1, 0, "table", 0.5, 0.0, 0.0, 1.0, 0.4), (1, 0, "chart", 0.9, 0.0, 0.0, 1.0, 0.4), (1, 0, "number", 0.9, 0.0, 0.9, 1.0, 1.0)], "version_id long, page_index int, label string, score double, x0 double, y0 double, x1 double, y1 double")
    assert {r.p: r.flag for r in Y.apply_layout(box, regions).collect()} == {0: "in_figure", 1: None, 2: "page_footer"}
    captions = spark.createDataFrame([(1, 0, 7, 0.1, 0.5, 0.9, 0.55)], "version_id long, page_index int, p int, c0 double, c1 double, c2 double, c3 double")
    parts = spark.createDataFrame([(1, 0, 0.2, 0.4, 0.5, 0.48), (1, 0, 0.51, 0.3, 0.6, 0.41), (1, 0, 0.2, 0.05, 0.3, 0.1), (1, 0, 0.2, 0.6, 0.3, 0.7)], "version_id long, page_index int, x0 double, y0 double, x1 double, y1 double")
    r = Y.figure_boxes(captions, parts).first()
    assert [round(v, 3) for v in (r.x0, r.y0, r.x1, r.y1)] == [0.195, 0.295, 0.605, 0.485]


def test_tags_and_packets(spark):
    t = spark.createDataFrame([(1, "Tag"), (2, "tag"), (2, "other")], "paper_id long, tag string")
    assert [r.tag for r in L.delete_tag(t, "TAG").collect()] == ["other"]
    p = spark.createDataFrame([(1, [(5,)]), (2, [(6,), (7,)])], "packet_id long, sources array<struct<paper_id:long>>")
    assert [r.packet_id for r in L.packets_of_paper(p, 7).collect()] == [2]


def test_quotes_over_blocks(spark):
    """Short quotes, quotes over two blocks, folded signs, all places and the choice by context."""
    texts = spark.createDataFrame([(1, ["The ﬁrst half of a sen-", "tence ends here. It ends."]), (2, ["ends, ends and ENDS"]), (3, None)], "doc long, parts array<string>")
    quotes = spark.createDataFrame([(1, "a sentence  ends", None, None), (2, "ends", "and ", None), (3, "first", None, None), (4, "absent", None, None), (5, " - ", None, None)], "quote_id long, quote string, prefix string, suffix string")
    got = {(r.doc, r.quote_id): (len(r.starts), r.first_part, r.start, r.last_part, r.end) for r in Q.locate_quotes(quotes, texts).collect()}
    assert got == {(1, 1): (1, 0, 17, 1, 10), (1, 2): (2, 1, 6, 1, 10), (1, 3): (1, 0, 4, 0, 8), (2, 2): (3, 0, 15, 0, 19)}
    assert Q.locate_quotes(quotes.limit(0), texts).count() == 0 == Q.locate_quotes(quotes, texts.limit(0)).count()


def test_quotes_of_any_length_without_a_driver_loop(spark):
    """Every stretch of a text is found, at all its places; the plan has neither a nested loop nor a loop over quotes."""
    text = "abcabcabdabcabcabdxyabcab"
    stretches = sorted({text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1)})
    quotes = spark.createDataFrame([(i, q) for i, q in enumerate(stretches)] + [(-1, "zz"), (-2, "abcabcabdabcabcabe")], "quote_id long, quote string")
    found = Q.locate_quotes(quotes, spark.createDataFrame([(1, text), (2, "nothing")], "doc long, text string"))
    assert {(r.doc, stretches[r.quote_id]): r.starts for r in found.collect()} == {(1, q): [i for i in range(len(text)) if text.startswith(q, i)] for q in stretches}
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_terms_fold_and_stem(spark):
    docs = spark.createDataFrame([(1, "Les élèves running fast"), (2, "eleve runs"), (3, "run ran"), (4, ""), (5, None)], "id long, text string")

    def find(terms, stem=False):
        index = X.write_index(docs, f"{scratch_dir(spark)}/{uuid.uuid4().hex}", "id", "text", ascii_only=False, stem=stem)
        found = X.search_index(index, spark.createDataFrame(terms, "query_id string, term_no int, tokens array<string>, is_prefix boolean"))
        assert "NestedLoop" not in found._jdf.queryExecution().toString()
        return sorted(r.doc for r in found.collect())

    assert find([("q", 0, ["élève"], True)]) == [1, 2] and find([("q", 0, ["run"], False)]) == [3]
    assert find([("q", 0, ["running"], False)], stem=True) == [1, 2, 3]
    assert find([("q", 0, ["running", "fast"], False)]) == [1] and find([("q", 0, ["fast", "running"], False)]) == []


def test_slices_left_out_of_a_search(spark, monkeypatch):
    """The same hits whether all slices are scored or only those that can reach the k best."""
    monkeypatch.setattr(X, "SLICE_DOCS", 20)
    rnd = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(rnd.choice(["a", "b", "c", "dd", "ee"]) for _ in range(rnd.randint(0, 40))), i % 7) for i in range(400)], "id long, text string, page int")
    index = X.write_index(docs, f"{scratch_dir(spark)}/{uuid.uuid4().hex}", "id", "text", ("page",))
    assert index.table("docs").select("slice").distinct().count() > 10
    terms = spark.createDataFrame([("q", 0, ["a"], False), ("q", 1, ["dd"], False), ("r", 0, ["ee"], False), ("s", 0, ["none"], False), ("t", 0, ["d"], True), ("u", 0, ["a", "b"], False)], "query_id string, term_no int, tokens array<string>, is_prefix boolean")
    few = [tuple(r) for r in X.search_index(index, terms, 5).orderBy("query_id", "rank").collect()]
    monkeypatch.setattr(X, "FIRST_SLICES", 10_000)
    assert few == [tuple(r) for r in X.search_index(index, terms, 5).orderBy("query_id", "rank").collect()]
    assert [r[0] for r in few] == ["q"] * 5 + ["r"] * 5 + ["t"] * 5 + ["u"] * 5 and all(r[4] == r[2] % 7 for r in few)


def test_queries_in_nfkc_and_without_terms(spark):
    q = spark.createDataFrame([(1, "ﬁeld １２"), (2, " -- "), (3, None)], "query_id int, query string")
    assert sorted((r.query_id, r.tokens) for r in R.parse_queries(q).collect()) == [(1, ["12"]), (1, ["field"])]
    assert sorted((r.query_id, r.code) for r in R.invalid_queries(q).collect()) == [(2, "INVALID_QUERY"), (3, "INVALID_QUERY")]


def test_fences(spark):
    text = "````md Title\n```\ninner\n```\n````\n~~~\na\n~~\n~~~~\n```x`y\nno\n    ```\n```py\nopen"
    got = [(r.language, r.title, r.content) for r in N.extract_artifacts(spark.createDataFrame([(1, text)], "answer_id long, markdown string")).orderBy("number").collect()]
    assert got == [("md", "Title", "```\ninner\n```"), ("", "", "a\n~~"), ("py", "", "open")]


def test_figure_lists(spark):
    rows = [(1, "see Figs. 3, 4 and s1; figure 3"), (2, "Fig 2–9 and configure 5"), (3, "fig. 7-3"), (4, None), (5, "그림 3, 4와 Figure 5a; a fig. or 6, figures 1, 2, and 4"), (6, "fig 1234, Fig. S2–S4")]
    a = spark.createDataFrame(rows, "answer_id long, markdown string")
    got = {r.answer_id: r.x for r in a.select("answer_id", N.figure_numbers(F.col("markdown")).alias("x")).collect()}
    assert got == {1: ["3", "4", "S1"], 2: ["2", "3", "4", "5", "6"], 3: ["7", "3"], 4: None, 5: ["3", "4", "5", "1", "2"], 6: ["S2", "S4"]}


def test_budget_of_roles(spark):
    rows = [(1, 0, "selection", [1], "x" * 8), (1, 1, "selection", [2], "x" * 5), (1, 2, "following_paragraph", [7], "xx"), (1, 3, "caption", [5], "x" * 3), (1, 4, "previous_paragraph", [5], "x"), (1, 5, "containing_paragraph", [6], "x" * 9)]
    items = spark.createDataFrame(rows, "packet_id long, rank int, role string, block_ids array<int>, text string")
    got = {r["rank"]: (r.chars, r.kept, r.reason) for r in K.apply_role_budget(items, 17).collect()}
    assert got == {0: (8, True, None), 1: (5, True, None), 3: (3, True, None), 5: (0, False, "text_budget"), 4: (0, False, None), 2: (0, False, "text_budget")}
    assert {r["rank"]: r.chars for r in K.apply_role_budget(items, 10).collect()}[1] == 2


def test_outline(spark):
    texts = ["Abstract", "I. INTRODUCTION", "A. First Part", "C. Third Part", "F. too far", "III. LATE", "B. Again", "VI. TOO LATE", "1 One", "4 Jumps", "3.2 Fine:", "2 Falls", "A.1 Extra", "A.2 no title.", "Appendix B", "no heading", "3.3 Run In Title. And the text goes on"]
    b = blocks(spark, texts).withColumn("lines", F.when(F.col("text").startswith("3.3"), 4).otherwise(1))
    got = [(r.title, r.level) for r in outline(b).orderBy("p").collect()]
    assert got == [("Abstract", 1), ("I. INTRODUCTION", 1), ("A. First Part", 2), ("C. Third Part", 2), ("III. LATE", 1), ("B. Again", 2), ("1 One", 1), ("3.2 Fine", 2), ("A.1 Extra", 2), ("Appendix B", 1), ("3.3 Run In Title", 2)]
    assert outline(b.limit(0)).count() == 0


def test_unreadable_selections(spark):
    b = blocks(spark, ["alpha β gamma", "plain text", "more"])
    b = b.withColumn("quality_flags", F.when(F.col("p") == 2, F.array(F.lit("unmapped_chars"))).otherwise(F.array().cast("array<string>")))
    rows = [(1, 0, "alpha β"), (2, 1, "plain ð"), (3, 2, "more"), (4, 1, "plain"), (5, 0, None)]
    box = b.select(F.col("p").alias("of"), "version_id", "page_index", F.col("x0").alias("a0"), F.col("y0").alias("b0"), F.col("x1").alias("a1"), F.col("y1").alias("b1"))
    anchors = spark.createDataFrame(rows, "anchor_id long, of int, quote string").join(box, "of").drop("of")
    got = {r.anchor_id: r.unreadable for r in H.unreadable(anchors, b).collect()}
    assert got[1] is False and got[2] is True and got[3] is True and got[4] is False and not got[5]


def test_page_references(spark):
    a = spark.createDataFrame([(1, "see p.19, pp. 20–22 and 7쪽, 9-12 쪽; p. 19"), (2, "page 5"), (3, None), (4, "p. 99999999999")], "answer_id long, markdown string")
    assert sorted((r.answer_id, r.page) for r in N.page_refs(a).collect()) == [(1, 7), (1, 9), (1, 19), (1, 20)]


def test_style_runs_over_spaces(spark):
    marks = {"a b": ["b", None, "b"], "a  c": ["b", None, None, "b"], " a i ": [None, "b", None, "i", None]}
    rows = [(k, i, c, m) for k, (text, ms) in enumerate(marks.items()) for i, (c, m) in enumerate(zip(text, ms, strict=True))]
    got = sorted((r.k, r.start, r.end, r.mark) for r in S.style_runs(spark.createDataFrame(rows, "k int, position int, char string, mark string"), ["k"]).collect())
    assert got == [(0, 0, 3, "b"), (1, 0, 4, "b"), (2, 1, 2, "b"), (2, 3, 4, "i")]


def test_paragraph_text_in_nfkc(spark):
    lines = spark.createDataFrame([(1, 0, "ef\ufb01cient\u0007 so-"), (1, 1, "lution \ue001 of the"), (1, 2, "Pre-"), (1, 3, "Fix"), (2, 0, "soft\u00adware")], "block int, line int, text string")
    assert {r.block: r.text for r in S.block_text(lines, ["block"], "line").collect()} == {1: "efficient solution of the Pre- Fix", 2: "software"}


def test_crossing_quads(spark):
    quads = [[0.0, 0.0, 1.0, 0.0, 1.0, 1.0, 0.0, 1.0], [0.0, 0.0, 1.0, 1.0, 1.0, 0.2, 0.0, 1.0], [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]]
    a = spark.createDataFrame([(i, 1, 0, "region", None, [q]) for i, q in enumerate(quads)], "anchor_id int, version_id long, page_index int, kind string, quote string, quads array<array<double>>")
    got = {r.anchor_id: r.reason for r in S.validate_anchors(a, spark.createDataFrame([(1, 1)], "version_id long, page_count int")).collect()}
    assert got == {0: None, 1: "crossing", 2: "area"}


def test_reference_section_ends_at_a_lettered_title(spark):
    texts = ["Text", "References", "[1] A. Author, Title.", "A. Author and B. Writer wrote, at length", "B Proof of the Main Lemma", "more"]
    assert [r.p for r in S.reference_blocks(blocks(spark, texts)).orderBy("p").collect()] == [1, 2, 3]
    small = blocks(spark, texts, size=lambda p: 8.0 if p == 4 else 10.0)
    assert [r.p for r in S.reference_blocks(small).orderBy("p").collect()] == [1, 2, 3, 4, 5]
    unknown = small.withColumn("font_size", F.when(F.col("p") != 4, F.col("font_size")))
    assert [r.p for r in S.reference_blocks(unknown).orderBy("p").collect()] == [1, 2, 3]
    assert [r.p for r in S.reference_blocks(small.withColumn("font_size", F.lit(9.0)).withColumn("lines", F.when(F.col("p") == 4, 2).otherwise(1))).orderBy("p").collect()] == [1, 2, 3, 4, 5]


def test_captions_of_figures(spark):
    texts = ["Fig. 1. A plan", "Figure 2: Another", "그림 3 Overview", "Fig. 4 shows that", "Figure 5 Title Case", "Fig. 6 ........ 12", "FIG. 1. again"]
    assert sorted((r.label, r.p) for r in S.numbered_figures(blocks(spark, texts)).collect()) == [(1, 0), (2, 1), (3, 2), (5, 4)]


def test_running_heads_of_two_lines_at_most(spark):
    rows = [(1, p, p, 0, "Head 1", 0.1, 0.02, 0.9, 0.05, 10.0, [], n) for p, n in enumerate([1, 2, 3, 1])]
    b = spark.createDataFrame(rows, BLOCK + ", lines int")
    assert sorted(r.p for r in S.running_lines(b).collect()) == [0, 1, 3]


def test_snapshot_writes_touched_parts_only(spark, tmp_path):
    import pathlib

    rows = lambda *r: spark.createDataFrame(r, "k long, at long, v string")
    path = f"{tmp_path}/s"
    SN.merge_snapshot(path, rows(*[(k, 1, "a") for k in range(40)], (None, 1, "n")), ["k"], "at", 8)
    files = lambda: {str(p) for p in pathlib.Path(f"{path}/rows").rglob("*.parquet")}
    before = files()
    touched = SN.merge_snapshot(path, rows((3, 2, "b"), (4, 0, "old"), (5, 1, "tie")), ["k"], "at", 8)
    assert len(touched) <= 3 and {f for f in before - files()} == {f for f in before if int(f.split("part=")[1].split("/")[0]) in touched}
    got = {r.k: (r["at"], r.v) for r in SN.read_snapshot(spark, path).collect()}
    assert len(got) == 41 and got[3] == (2, "b") and got[4] == (1, "a") and got[5] == (1, "tie") and got[None] == (1, "n")
    SN.merge_snapshot(path, rows((3, 2, "b"), (4, 0, "old"), (5, 1, "tie")), ["k"], "at", 8)
    assert got == {r.k: (r["at"], r.v) for r in SN.read_snapshot(spark, path).collect()}
    assert SN.merge_snapshot(path, rows().limit(0), ["k"], "at", 8) == []


def test_extraction_keeps_ids_and_failed_runs_clear(spark):
    t = "version_id string, page_index int, p int, text string, block_id string"
    current = spark.createDataFrame([("a", 0, 0, "x", "i1"), ("a", 0, 1, "x", "i2"), ("a", 0, 2, "y", "i3"), ("b", 0, 0, "keep", "i4"), ("c", 0, 0, "gone", "i5")], t)
    new = spark.createDataFrame([("a", 0, 0, "new", None), ("a", 0, 1, "x", None), ("a", 0, 2, "x", None)], t)
    runs = spark.createDataFrame([("a", "SUCCEEDED"), ("c", "FAILED")], "version_id string, status string")
    got = sorted((r.version_id, r.p, r.block_id) for r in SN.replace_extraction(current, new, runs).collect())
    assert got == [("a", 0, "new-a-0"), ("a", 1, "i1"), ("a", 2, "i2"), ("b", 0, "i4")]
    assert sorted(r.version_id for r in SN.replace_extraction(current, new.limit(0)).collect()) == ["a", "a", "a", "b", "c"]


def test_deletion_over_the_graph(spark):
    frame = lambda schema, *rows: spark.createDataFrame(rows, schema)
    tables = {
        "papers": frame("paper_id string", ("1",), ("2",)), "source_versions": frame("version_id string, paper_id string", ("v1", "1"), ("v2", "2")),
        "anchors": frame("anchor_id string, version_id string", ("a1", "v1"), ("a2", "v2"), ("a3", None)), "annotations": frame("annotation_id string, anchor_id string", ("n1", "a1"), ("n2", "a2")),
        "context_packets": frame("packet_id string, sources array<struct<paper_id:string>>", ("p1", [("1",)]), ("p2", [("2",)]), ("p12", [("2",), ("1",)]), ("p0", [])),
        "answers": frame("answer_id string, packet_id string, session string", ("r1", "p12", "s1"), ("r2", "p2", "s2")), "answer_images": frame("answer_id string, position int", ("r1", 0), ("r2", 0)),
        "chat_threads": frame("session string", ("s1",), ("s2",)), "paper_tags": frame("paper_id string, tag string", ("1", "Only"), ("1", "both"), ("2", "BOTH")), "tags": frame("name string", ("only",), ("both",), ("unused",)),
    }
    left, refused = C.delete_papers(tables, frame("paper_id string", ("1",), ("9",)))
    rows = {n: sorted(tuple(r)[0] for r in df.collect()) for n, df in left.items()}
    assert rows == {"papers": ["2"], "source_versions": ["v2"], "anchors": ["a2", "a3"], "annotations": ["n2"], "context_packets": ["p0", "p2"], "answers": ["r2"], "answer_images": ["r2"], "chat_threads": ["s2"], "paper_tags": ["2"], "tags": ["both", "unused"]}
    assert refused.count() == 0


def test_canonical_json(spark):
    import json

    df = spark.sql("""SELECT named_struct('b', 1, 'a', array(named_struct('z', 1.50D, 'y', map('k2', true, 'k1', false)))) AS x, named_struct('a', array(named_struct('y', map('k1', false, 'k2', true), 'z', 1.5BD)), 'b', 1L) AS y""")
    texts = df.select(canonical_json(F.col("x"), df.schema["x"].dataType).alias("x"), canonical_json(F.col("y"), df.schema["y"].dataType).alias("y")).first()
    assert texts.x == texts.y == '{"a":[{"y":{"k1":false,"k2":true},"z":1.5}],"b":1}'
    odd = spark.createDataFrame([("q\"\\\n☃é", 1e-5, -0.0, float("nan"), None, b"\x00", [None, 2])], "s string, small double, zero double, nan double, none string, bin binary, ns array<int>")
    row = odd.select(canonical_json(F.struct("*"), odd.schema).alias("j")).first().j
    assert json.loads(row) == {"s": "q\"\\\n☃é", "small": 0.00001, "zero": 0, "nan": "NaN", "none": None, "bin": "AA==", "ns": [None, 2]} and "e-" not in row.lower()
    a = K.content_sha256(df.select(F.col("x").alias("c")), ["c"]).first().content_sha256
    assert a == K.content_sha256(df.select(F.col("y").alias("c")), ["c"]).first().content_sha256


def test_union_of_clips(spark):
    rnd = random.Random(8)
    rows = []
    for i in range(60):
        clips = [(float(a), float(b), float(a + rnd.randint(0, 6)), float(b + rnd.randint(0, 6))) for a, b in ((rnd.randint(-2, 10), rnd.randint(-2, 10)) for _ in range(rnd.randint(0, 5)))]
        rows.append((i, 0.0, 0.0, 10.0, 8.0, clips))
    rows += [(60, 0.0, 0.0, 10.0, 8.0, None), (61, 1.0, 1.0, 1.0, 5.0, [(0.0, 0.0, 9.0, 9.0)])]
    rect = "array<struct<l:double,b:double,r:double,t:double>>"
    got = {r.i: r.visible for r in G.visible_share(spark.createDataFrame(rows, f"i int, l double, b double, r double, t double, clips {rect}")).collect()}
    for i, *_, clips in rows[:60]:
        assert got[i] == pytest.approx(sum(any(a <= x < c and b <= y < d for a, b, c, d in clips) for x in range(10) for y in range(8)) / 80)
    assert got[60] == 1.0 and got[61] == 0.0
    graphics = spark.createDataFrame([(1, 0, "image", 0.0, 0.0, 100.0, 100.0, True, True, 600.0, 800.0, c) for c in (None, [(0.0, 0.0, 100.0, 40.0)])], f"version_id long, page_index int, kind string, l double, b double, r double, t double, filled boolean, stroked boolean, width double, height double, clips {rect}")
    assert Y.figure_candidates(graphics).count() == 1 and Y.figure_candidates(graphics.filter("clips is not null")).count() == 0


def test_recovered_glyphs(spark):
    rows = [("num", i, None, "?") for i in range(10)] + [("bad", i, None, "?") for i in range(4)] + [("std", 0, n, "#") for n in ("a", "b", "c", "d", "zz")] + [("odd", 0, n, "#") for n in ("a", "y", "z")] + [("odd", 0, None, "\ue001"), ("odd", 0, None, None)]
    g = spark.createDataFrame(rows, "font string, code int, name string, text string")
    numbers = spark.createDataFrame([(i, c) for i, c in enumerate("readableio")], "code int, mapped string")
    names = spark.createDataFrame([(n, n.upper()) for n in "abcd"], "name string, mapped string")
    private = spark.createDataFrame([(0xE001, "fi")], "code int, mapped string")
    got = {}
    for r in G.recover_glyphs(g, numbers, names, private).collect():
        got.setdefault(r.font, []).append((r.code, r.name, r.text, r.source))
    assert "".join(t for _, _, t, _ in sorted(got["num"])) == "readableio" and {s for *_, s in got["num"]} == {"number"}
    assert {t for *_, t, _ in got["bad"]} == {"?"} and sorted(t for _, _, t, _ in got["std"]) == ["#", "A", "B", "C", "D"]
    assert sorted(str(t) for _, _, t, _ in got["odd"]) == ["#", "#", "#", "None", "fi"]


def test_line_of_a_joined_entry(spark):
    b = blocks(spark, ["see [2] and [9]", "[1] One. [2] Two.", "[2] again"]).withColumn("regions", F.when(F.col("p") == 1, F.array(F.array(F.lit(0.0), F.lit(0.1)), F.array(F.lit(0.0), F.lit(0.2)))).otherwise(F.array(F.array(F.lit(0.0), F.lit(0.5)))))
    got = {r.n: (r.entry_p, r.line) for r in S.link_citations(b).collect()}
    assert got == {2: (2, [0.0, 0.5]), 9: (None, None)}
    got = {r.n: (r.entry_p, r.line) for r in S.link_citations(b.filter("p < 2")).collect()}
    assert got == {2: (1, [0.0, 0.2]), 9: (None, None)}


def test_paper_artifacts_of_each_paper(spark):
    """Two papers of 250 answers each have the artifacts of 200; the registered query has those of all papers."""
    rows = [(1000 * p + i, p, f"2024-0{p}-01 00:{i // 60:02}:{i % 60:02}", "2024-05-01" if i == 249 else None, "x\n```html t\nb\n```") for p in (1, 2) for i in range(250)]
    a = spark.createDataFrame(rows, "answer_id long, packet_id long, created_at string, discarded_at string, markdown string")
    got = sorted((r.packet_id, r.answer_id) for r in N.paper_artifacts(a).collect())
    assert got == [(p, 1000 * p + i) for p in (1, 2) for i in range(49, 249)]
    sf = "/root/testdata/sf0.1"
    live = {r.answer_id for r in A.answers(spark, sf).filter("discarded_at is null").collect()}
    assert {r.answer_id for r in registry.queries()["paper_artifacts"](spark, sf).collect()} == live and len(live) > 200


def test_artifacts_of_answers(spark):
    text = 'a\n```artifact type="react" title=""\n<A/>\n```\n~~~artifact title="x" type="markdown"\n# t\n~~\n~~~\n```python\np\n```\n  ```html\n   <html><title></title>\n'
    a = spark.createDataFrame([(1, text), (2, None), (3, "```svg\n<svgx>\n```\n```mermaid\n \n```"), (4, "```mermaid\ng\n```\n")], "answer_id long, markdown string")
    got = [(r.answer_id, r.number, r.kind, r.title, r.language, r.content) for r in AR.artifacts(a).orderBy("answer_id", "number").collect()]
    assert got == [(1, 0, "react", "React 화면", None, "<A/>"), (1, 1, "markdown", "x", None, "# t\n~~"), (1, 2, "html", "HTML 페이지", None, " <html><title></title>"), (4, 0, "mermaid", "다이어그램", None, "g")]
    out = {r.answer_id: r.markdown for r in AR.without_artifacts(a).collect()}
    assert out[1] == "a\n[artifact: React 화면]\n[artifact: x]\n```python\np\n```\n[artifact: HTML 페이지]" and out[2] is None and out[4] == "[artifact: 다이어그램]"


def test_renames_and_deleted_sessions(spark):
    frame = lambda schema, *rows: spark.createDataFrame(rows, schema)
    titles = frame("session string, title string", ("s1", "old"), ("s3", "keep"))
    threads = frame("session string, title string, deleted_at timestamp", ("s2", "t", None), ("s1", "gone", dt.datetime(2024, 1, 1)))
    t, h = N.apply_renames(titles, threads, frame("session string, title string", ("s1", "new"), ("s2", "live"), ("s4", "first")))
    assert sorted(map(tuple, t.collect())) == [("s1", "new"), ("s3", "keep"), ("s4", "first")]
    assert {r.session: r.title for r in h.collect()} == {"s1": "gone", "s2": "live"}
    answers = frame("session string, answer_id long, discarded_at timestamp", ("s1", 1, None), ("s2", 2, None))
    a, t, h = N.discard_sessions(answers, titles, threads, frame("session string", ("s1",), ("s2",)), "2024-06-01 00:00:00")
    assert a.filter("discarded_at is null").count() == 0 and [r.session for r in t.collect()] == ["s3"]
    assert {r.session: r.deleted_at.month for r in h.collect()} == {"s1": 1, "s2": 6}


def test_sentence_offsets(spark):
    text = "  One  two.\tThree e.g. four!  五。 Last "
    got = [(r.start, r.end, r.sentence) for r in T.sentence_spans(spark.createDataFrame([(1, 0, text), (1, 1, " "), (1, 2, None)], "version_id long, p int, text string")).orderBy("sentence_no").collect()]
    assert [(text[a:b].split(), s.split()) for a, b, s in got] == [(s.split(), s.split()) for _, _, s in got] and len(got) == 4


def test_selection_context_with_reasons(spark):
    b = blocks(spark, ["one two three four", "more text here", "end of it"], page=lambda p: p)
    box = lambda p: (0.1, 0.2 + 0.1 * (p % 5), 0.9, 0.25 + 0.1 * (p % 5))
    rows = [(1, 1, 1, "more", *box(1)), (2, 1, 1, "more text here", *box(1)), (3, 1, 0, "x", 0.1, 0.9, 0.2, 0.95), (4, 2, 0, "x", *box(0))]
    a = spark.createDataFrame(rows, "anchor_id int, version_id long, page_index int, quote string, a0 double, b0 double, a1 double, b1 double")
    got = sorted((r.anchor_id, r.role, r.p, r.reason) for r in H.text_selection_context(a, b, S.neighbours(b)).collect())
    assert got == [(1, "containing_paragraph", 1, None), (1, "following_paragraph", 2, None), (1, "previous_paragraph", 0, None), (2, "following_paragraph", 2, None), (2, "previous_paragraph", 0, None), (3, "context", None, "no_extracted_text"), (4, "context", None, "text_not_extracted")]


def test_neighbours_within_two_pages(spark):
    b = blocks(spark, ["a", "b", "c"], page=lambda p: 3 * p)
    assert [(r.before, r.after) for r in S.neighbours(b).orderBy("p").collect()] == [(None, None)] * 3
    assert [(r.before, r.after) for r in S.neighbours(b, 3).orderBy("p").collect()] == [(None, 1), (0, 2), (1, None)]


def test_neighbours_on_any_page(spark):
    b = blocks(spark, ["a", "b", "c"], page=lambda p: 9 * p)
    assert [(r.before, r.after) for r in S.neighbours(b, None).orderBy("p").collect()] == [(None, 1), (0, 2), (1, None)]


def test_sentences_of_a_long_block(spark):
    """Sentences are cut by patterns, without folding the tokens of a block into growing arrays, and lie where a scan finds them."""
    hard = ["A dr. Smith came. ", "See (e.g. This) or Fig. 3.\u3000", "“J. Doe?”\t", "No.) Yes! ", "x.y.z. And. ", "Well.. so? no. It ends.\"  ", "İ. A ", "ET AL. B.\n"]
    text = " " + "".join(hard) * 500
    b = spark.createDataFrame([(1, 0, text), (1, 1, "\u3000"), (1, 2, "Only. one")], "version_id long, p int, text string")
    spans = T.sentence_spans(b)
    assert "aggregate(" not in T.sentences(b)._jdf.queryExecution().toString()
    got = spans.orderBy("p", "sentence_no").collect()
    assert [r.sentence for r in got if r.p] == ["Only. one"]
    long = [r for r in got if not r.p]
    assert all(" ".join(text[r.start : r.end].split()) == r.sentence for r in long)
    assert " ".join(r.sentence for r in long) == " ".join(text.split())
    assert [r.sentence for r in long[:8]] == ["A dr. Smith came.", "See (e.g. This) or Fig. 3.", "“J. Doe?”", "No.) Yes! x.y.z.", "And.", "Well.. so? no. It ends.\"", "İ.", "A ET AL. B. A dr. Smith came."]


def test_outline_passes_candidates_one_by_one(spark):
    b = blocks(spark, ["1 One", "Conclusion", "2 Two"]).unionByName(blocks(spark, ["2 Two", "9 Nine"]).withColumn("version_id", F.lit(7).cast("long")))
    found = outline(b)
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
    assert sorted((r.version_id, r.p, r.level) for r in found.collect()) == [(1, 0, 1), (1, 1, 1), (1, 2, 1), (7, 0, 1)]


def test_ascii_dictionary_needs_no_python(spark):
    words = folded_terms(spark.createDataFrame([("a1",), ("b",)], "word string"), "word", False, True)
    assert "Python" not in words._jdf.queryExecution().toString()
    assert sorted(map(tuple, words.collect())) == [("a1", "a1", "a1"), ("b", "b", "b")]
