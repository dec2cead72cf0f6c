"""Article extraction: templates, odd markup, odd rows, the registered query against the documents the pages show."""

import html
import random
import re

import pytest

from foldmeter.llm.pagetext import article_text, class_orders, host_templates, main_text, page_tokens
from foldmeter.llm.queries import QUERIES

CASES = [
    ("", ""),
    ("plain &amp; bare\n text", "plain & bare text"),
    ("<p>a < b &#8364; &nbsp;x", "a < b € x"),
    ("<", "<"),
    ('<a "', ""),
    ("<!-- never closed <p>x</p>", ""),
    ("<script>if (a < b) '</p>'</script><p>yes</p><style>p{}", "yes"),
    ("<P CLASS='Side-Bar nav'>menu</P><p>t<b>wo</b> x<br>y</p>", "two x y"),
    ("<div class=cookieNotice>we <b>use</b></div><p>text</p><form>name <input></form>", "text"),
    ("<header>Site</header><article><header><h1>Title</h1></header><p>one<p>two<aside>no</aside></article><footer>f", "Title one two"),
    ("<article><p>kept<section id=comments><article class=comment>bad</article></section></article>", "kept"),
    ("<nav><ul><li>never closed<article>found</article>", "found"),
    ("<main><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></main><p>outside</p>", "a b c d"),
    ("<div id='content'>body <span class='ad'>buy</span>text</div><div>other</div>", "body text"),
]


@pytest.mark.parametrize(("source", "want"), CASES)
def test_elements(source, want):
    assert article_text(source) == want


def test_class_orders():
    classes = {1: 0, 2: 1, 3: 1, 9: 0}
    assert class_orders([1, 2, 3, 2, 3, 9], classes) == {0: ([1, 9], -1, 0), 1: ([2, 3], 0, 0)}
    assert class_orders([1, 2, 9, 3], classes)[1][1] == -2  # brackets cross
    assert class_orders([1, 2, 3, 3, 2, 9], classes)[1][1] == -2  # not one order


def page(i, rng):
    words = lambda n: " ".join(f"w{rng.randrange(999)}" for _ in range(n))
    items = "".join(f"<li><div><a href='/{k}'>{words(2)}</a></div></li>" for k in range(rng.randrange(2, 6)))
    text = words(40)
    source = f"<html><body><div>Daily Herald</div><ul>{items}</ul><div>Best news since 1901</div><div><p>{text}</p></div><div>All rights kept</div></body></html>"
    return source, text


def test_slots_of_a_template(spark):
    """No article element: constant text is template, the list of links is mostly links, the other slot is the article."""
    rng = random.Random(4)
    made = [page(i, rng) for i in range(12)]
    rows = [(i, f"http://Herald.example/{i}", h) for i, (h, _) in enumerate(made)]
    rows += [(100 + i, f"http://small{i}.example/", made[0][0]) for i in range(2)]
    pages = spark.createDataFrame([(*r, "m", "h", "t") for r in rows], "page_id long, url string, html string, members string, host string, text string")
    got = {r.page_id: r.text for r in main_text(pages).collect()}
    assert all(got[i] == text for i, (_, text) in enumerate(made))
    assert "Daily Herald" in got[100] and made[0][1] in got[100]  # one page alone has no template
    hosted = pages.selectExpr("'x' AS host", "html").union(pages.selectExpr("'copies' AS host", "(SELECT first(html) FROM VALUES ('<p>a</p>') t(html)) AS html"))
    found = {r.host: r for r in host_templates(hosted).collect()}
    assert set(found) == {"x"}  # copies are one page
    tokens = [set(page_tokens(h)) for h, _ in made]
    assert set(found["x"].members) <= set.intersection(*tokens)
    assert any(p >= 0 for p in [c.parent for c in found["x"].nesting])  # the list items nest in the page's own class


def test_odd_rows(spark):
    long = "<article>" + "<p>word " * 30_000 + "</article>"
    rows = [(1, None, None), (2, "no host", ""), (3, "http://a.b/", long), (3, "http://a.b/", long), (None, None, "<b>x"), (4, "http://a.b/", "<div>" * 5000 + "deep")]
    pages = spark.createDataFrame([(*r, 1, "c", [1]) for r in rows], "page_id long, url string, html string, page long, token string, tokens array<int>")
    got = main_text(pages).collect()
    assert sorted((r.page_id or 0, len(r.text)) for r in got) == [(0, 1), (1, 0), (2, 0), (3, 149_999), (3, 149_999), (4, 4)]
    assert main_text(pages.limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.page_id: r for r in QUERIES["op12_html_extraction"](spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        inner = re.search("<article>(.*?)</article>", r.html, re.S).group(1)
        text = " ".join(html.unescape(re.sub("<[^>]*>", " ", inner)).split())
        assert got[r.page_id].text == text and got[r.page_id].n_chars == len(text) and got[r.page_id].url == r.url
