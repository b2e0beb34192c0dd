"""Pages of unusual shape: without body, with main around article, marked code, deep and broken ones."""

import time

import pytest

BODY = "Long, main text. " * 20


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<h1>Head</h1><p>{BODY}<p>{BODY}<div class=x><p>short</div>", ["Head", BODY.strip(), BODY.strip(), "short"]),
        (f"<title>t</title><p>{BODY}", [BODY.strip()]),
        (f"<head><title>t</title><meta charset=x><p>{BODY}</p>", [BODY.strip()]),
        (f"<body><main><h1>T</h1><p>lead</p><article><p>{BODY}</p></article></main></body>", ["T", "lead", BODY.strip()]),
        (f"<body><main><p><a href=x>Home page of all</a></p><article><p>{BODY}</p></article></main></body>", [BODY.strip()]),
        (f'<article><p>{BODY}</p><pre><code>x = 1 <span class="hljs-comment"># why</span></code></pre></article>', [BODY.strip(), "x = 1 # why"]),
        (f'<article><p>{BODY}</p><p>the <code class="header">a</code>, <span class="form">b</span>, <em class="comment">c</em> and <span class="ad">buy</span></p></article>', [BODY.strip(), "the a, b, c and"]),
        (f"<body><form action=x><div><h1>T</h1><p>{BODY}</p></div></form></body>", ["T", BODY.strip()]),
        (f"<body><p>{BODY}</p><form><p>Your mail</p></form></body>", [BODY.strip()]),
        (f"<p title='a>b' class=it's>{BODY}</p>", [BODY.strip()]),
        (f'<p class="a>b">{BODY}</p><!-- open', [BODY.strip()]),
        (f'<p>{BODY}</p><p title="open>{BODY}</p>', [BODY.strip(), BODY.strip()]),
        ("3 < 4 and <5 <", ["3 < 4 and <5 <"]),
    ],
)
def test_shapes(page, want):
    from quire.llm.host_consensus import extract

    assert extract(page, []).split("\n") == want


@pytest.mark.parametrize(
    ("page", "lines"),
    [
        ("".join(f"<div>line {i}, of text." for i in range(20_000)), 20_000),
        ("<a " * 50_000, 1),
        ('<a "' * 50_000, 1),
        ("<a title='" * 20_000 + "<p>x", 1),
        ("<b>" * 20_000 + "<li>x" * 20_000, 20_000),
        ("<div class='a-form'>" * 5_000 + f"<h1>T</h1><p>{BODY}", 2),
        ("</i>" * 50_000 + "<p>t", 1),
    ],
)
def test_linear_time(page, lines):
    from quire.llm.host_consensus import extract

    began = time.process_time()
    assert len(extract(page, ["html>body>main", "html>body>div"]).split("\n")) <= lines
    assert time.process_time() - began < 3


def test_deep_page_keeps_its_lines():
    from quire.llm.host_consensus import extract

    page = "<body>" + "".join(f"<div>line {i}, with text." for i in range(1000))
    assert len(extract(page, []).split("\n")) >= 999
