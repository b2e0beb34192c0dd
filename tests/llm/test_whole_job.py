"""Cases in which an operator once did less than the whole job."""

import random

DOCS = "doc_id long, text string, lang string, source string"


def prose(r, n):
    return " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 8))) for _ in range(n))


def symbols(r, n, share):
    return " ".join("".join(r.choice("#*$%&|") if r.random() < share else r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(n))


def test_quality_rejects_many_outliers(spark):
    """Two fifths of a group are junk; another group is clean."""
    from quire.llm.quality_mcd import keep_good

    r = random.Random(2)
    rows = [(i, prose(r, r.randint(30, 300)), "en", "hot") for i in range(120)]
    rows += [(1000 + i, symbols(r, r.randint(60, 300), r.uniform(0.2, 0.4)), "en", "hot") for i in range(80)]
    rows += [(2000 + i, prose(r, r.randint(30, 300)), "en", "clean") for i in range(60)]
    kept = {x.doc_id for x in keep_good(spark.createDataFrame(rows, DOCS)).select("doc_id").collect()}
    assert kept == {i for i, *_ in rows if not 1000 <= i < 2000}


def test_quality_rejects_repeated_lines(spark):
    """Nearly half the lines of a long text are repeats, against one repeated line of five."""
    from quire.llm.quality_mcd import quality_verdicts

    r = random.Random(3)
    rows = [(i, "\n".join(prose(r, 12) for _ in range(r.randint(3, 20))), "en", "s") for i in range(120)]
    for i in range(3):
        x, y = prose(r, 3), prose(r, 9)
        rows.append((1000 + i, "\n".join(f"{x}\n{prose(r, 12)}" for _ in range(20)), "en", "s"))
        rows.append((2000 + i, "\n".join([prose(r, 20), y, prose(r, 20), y, prose(r, 20)]), "en", "s"))
    out = {v.doc_id: v for v in quality_verdicts(spark.createDataFrame(rows, DOCS)).collect()}
    assert not any(v.base_failed for v in out.values())
    assert [i for i, v in out.items() if v.kept != (not 1000 <= i < 2000)] == []


def test_secret_values_reach_the_cost(spark):
    """Values that go on behind a base span, and values without digits; words are left alone."""
    from quire.llm.secret_scan import base_spans, mask_secrets, masked, spans_of

    text = "password: hunter2x$Tr0ub4dor&3zQ"
    assert spans_of(text) == [("assign", 0, 18), ("guess", 10, 32)] and base_spans(text, text) == [("assign", 0, 18)]
    texts = [text, "pwd: XkQzPwLmNtRvBsDfGh", "pwd = kJ#vQ!mZ@wXrTy", "passphrase is zQvKpLmXwRtYbNdF", "pwd: 8492716305"]
    out = mask_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r.text for r in sorted(out)] == ["[SECRET]", "pwd: [SECRET]", "pwd = [SECRET]", "passphrase is [SECRET]", "pwd: [SECRET]"]
    prose = "The secret is Constantinople. Login: https://example.com/reset/page or user.name@company.org. The login is straightforward/easy. Auth: BasicAuthentication. Authorization: application/json. Bearer: Donaudampfschifffahrt. Pwd: ${DB_PASSWORD}, pwd: ********, passphrase: your_password_here, login = getCurrentUser()"
    assert masked(prose) == prose


def test_host_consensus_keeps_the_article(spark):
    """Title and lead beside nested sections, and wrappers whose names only mention furniture."""
    from quire.llm.host_consensus import extract, extract_pages

    body = "<p>" + "long, main text. " * 20 + "</p>"
    article = f"<h1>T</h1><p>lead</p><section>{body}</section><section>{body}</section>"
    want = "\n".join(["T", "lead", *[("long, main text. " * 20).strip()] * 2])
    nav = '<div class="nav"><a href="x">Home</a></div><div class="site-footer"><p>foot</p></div>'
    shapes = [
        f"<body>{nav}<article>{article}</article></body>",
        f"<body>{nav}<article><h1>T</h1><p>lead</p><div class=content>{body}{body}</div></article></body>",
        f"<body>{nav}<div class=page><h1>T</h1><p>lead</p><div class=content>{body}{body}</div></div></body>",
        f"<body>{nav}<div class='layout has-sidebar'><article>{article}</article></div></body>",
        f"<body>{nav}<div class='post no-comments'>{article}</div></body>",
        f"<body>{nav}<div class='page-header-wrap'>{article}</div></body>",
    ]
    for page in shapes:
        assert extract(page, []) == want
    rows = [(10 * i + j, f"http://h{i}.example/{j}", page) for i, page in enumerate(shapes) for j in range(3)]
    out = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(out) == 18 and all(r.text == want for r in out)
