"""Main text of pages: templates by host, landmarks, broken markup, odd rows."""

import time

import pytest

from codeloom.llm import extraction

PAGE = "page_id long, url string, html string, host string, text int"


def texts(spark, rows, **named):
    df = spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], PAGE)
    return {r.page_id: r for r in extraction.main_texts(df, **named).collect()}


def only(html, *templates):
    return extraction.extract(html, set(templates))[0]


@pytest.mark.parametrize(("html", "want"), [
    ("<article><h1>T</h1><p>a&amp;b &copy 1<br>c</p><p><b>d<p>e</article>", "T\n\na&b © 1 c\n\nd\n\ne"),
    ("<body><nav>menu</nav><header>top</header><main><h1>T</h1><p>x</p><form>f</form></main><footer>f</footer>", "T\n\nx"),
    ("<body><div class='ad box'>buy</div><div><p>x</p></div><div id=comments><p>first!</p></div>", "x"),
    ("<div class='page sidebar'><article><p>x</article><aside>y</aside></div>", "x"),
    ("<article><p>x</p><section class=comments><article><p>nice</p></article></section></article>", "x"),
    ("<article><header><h1>T</h1></header><p>x</p><footer>by me</footer></article>", "T\n\nx"),
    ("<title>t</title><script>var t='</p>';</script><style>p{}</style><p>x &lt;b&gt;</p><!-- c -->", "x <b>"),
    ("plain  text\n only", "plain text only"),
    ("<ul><li>a<li>b<ul><li>c</ul></ul>", "a\n\nb\n\nc"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\n\nb\n\nc"),
    ("<p>a <i>b</i>c<span class=cookie>no</span></p>", "a bc"),
    ("<article><p>one</p></article><article><p>two</p></article>", "one\n\ntwo"),
    ("<article><p>x</p></article><div><p>outside</p></div>", "x"),
    ("<div hidden>no</div><div style='display: none'>no</div><p>yes", "yes"),
    ("<ul><li><a href=/>one</a><li><a href=/>two</a></ul><p>a <a href=/>link</a>", "a link"),
    ("<head><meta charset=x><title>t</title><body><p>x<button>ok</button> y", "x y"), ("<head><title>t</title><p>x", "x"),
    ("<article></article><p>x", "x"), ("", ""), ("<", "<"), ("</p></div><p", ""), ("<article><p>&nbsp;a&nbsp;&nbsp;b</p></article>", "a b"),
])
def test_pages(html, want):
    assert only(html) == want


def test_templates_of_a_host_go(spark):
    """A host without landmarks: what recurs with other contents goes, copies and shared passages of articles stay."""
    soup = lambda k, body: f"<body><div class=x1><p>Welcome to the site</p><p>of all</p></div><div class=x2>{body}</div><div class=x3>All rights <p>reserved</div>"
    rows = [(k, "http://A.example.com:80/p", soup(k, f"<p>text {k}</p><p>shared passage</p>")) for k in range(8)]
    rows += [(100 + k, "https://b.example.com/", soup(1, "<p>copy</p>")) for k in range(9)]  # one content only: nothing is known to be a template
    rows += [(200 + k, "https://c.example.com/", f"<article><p>the same passage</p><div><p>{k}</p></div><div><p>shared box</p></div><div><a href=/x>Share</a></div></article>") for k in range(6)]
    for named in ({}, {"broadcast_bytes": 0}):
        got = texts(spark, rows, **named)
        assert [got[k].text for k in range(8)] == [f"text {k}\n\nshared passage" for k in range(8)]
        assert {got[100 + k].text for k in range(9)} == {"Welcome to the site\n\nof all\n\ncopy\n\nAll rights\n\nreserved"}
        assert [got[200 + k].text for k in range(6)] == [f"the same passage\n\n{k}\n\nshared box" for k in range(6)]
        assert got[0].n_templates == 2 and got[0].n_chars == len(got[0].text)


def brute_templates(rows, least, share):
    seen = {}
    for h, html in rows:
        content, subtrees = extraction.hashed(html)
        seen.setdefault(h, []).append((content, subtrees))
    out = {}
    for h, pages in seen.items():
        contents, by = {c for c, _ in pages}, {}
        for c, subtrees in pages:
            for s in subtrees:
                by.setdefault(s, set()).add(c)
        got = sorted(s for s, cs in by.items() if len(cs) >= least and len(cs) * share >= len(contents))
        if got:
            out[h] = got
    return out


def test_counts_by_host(spark):
    rows = [(f"h{k % 3}.example.com", f"<body><div>menu {k % 4}</div><div><div>{'odd' if k % 2 else 'even'}</div><p>{k % 17}</p></div>") for k in range(90)]
    df = spark.createDataFrame([(i, f"http://{h}/x", t, "x", 1) for i, (h, t) in enumerate(rows)], PAGE)
    for least, share in ((4, 10), (3, 2), (1, 1000)):
        assert {r.host: r.templates for r in extraction.templates(df, least, share).collect()} == brute_templates(rows, least, share)


def test_odd_rows(spark):
    got = texts(spark, [(1, None, None), (2, "no url", ""), (3, "http://x.org", "<p>a"), (3, "http://x.org", "<p>a"), (None, "http://x.org", "<p>b ퟿</p>")])
    assert (got[1].text, got[1].n_chars, got[1].url) == ("", 0, None) and got[2].text == "" and got[3].text == "a" and got[None].text == "b ퟿"
    assert texts(spark, []) == {}


def test_time_follows_the_length_of_a_page():
    def took(n):
        html = "<div>" * n + "<p><b>a <i>b" * n + "</article>" * n
        begun = time.perf_counter()
        extraction.extract(html, set())
        return time.perf_counter() - begun

    took(1_000)
    assert took(16_000) < 8 * max(took(4_000), 0.05)
