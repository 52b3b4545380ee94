"""Main text of pages: hand-made pages, and the test tables against a split at tags."""

import html as H
import re
import time
from pathlib import Path

import pytest

from tracewell.llm import html

SF_DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("source,text", [
    (None, ""), ("", ""), ("<p>a<p>b", "a\nb"), ("<article><p>un<b>clo", "unclo"), ("a < b <3", "a < b <3"),
    ("<!-- x", ""), ("<script>var t='</p>'", ""), ("<body>plain &lt; text <b>bold</b>er", "plain < text bolder"),
    ("<article><p>A &amp; B<br>c &eacute;&#233;&nbsp; x</p></article>", "A & B c éé x"),
    ("<div>x</div><article><h1>T</h1><p>a</p><aside>s</aside><ul><li>1<li>2</ul></article>", "T\na\n1\n2"),
    ("<article><p>a</p><section class='comments'><article><p>no</p></article></section></article>", "a"),
    ("<main><header>h</header><p>a<form><p>f</form><p>b</main><footer>f</footer>", "a\nb"),
    ("<article><p>a<span class=x>b</span>c</p><div class='cookie-notice'>n</div>d</article>", "abc\nd"),
    ("<article><table><tr><td>1<td>2<tr><td>3</table></article>", "1\n2\n3"),
    ("<body><nav>m</nav><div class='ad'>x</div><p>header of loads</p></body>", "header of loads"),
    ("<article class='loaded'><p title='a > b'>q</p><P>w</P></article>", "q\nw"),
])
def test_main_text(source, text):
    assert html.main_text(source) == text


@pytest.mark.parametrize("source,text", [
    ("<body class='single has-sidebar'><article><p>a</p></article><div class='sidebar'>s</div></body>", "a"),
    ("<article class='hentry comments-open'><header class='entry-header'><h1>T</h1></header><p>a</p></article>", "T\na"),
    ("<article><div class='post-header'><h1>T</h1></div><p>a</p><footer>f</footer></article>", "T\na"),
    ("<body><form id='aspnet'><nav>m</nav><p>long text</p><div class='ad'>x</div></form><p>b</p></body>", "long text\nb"),
    ("<div class='with-sidebar'><article>a</article><div class='related'><article>teaser, longer</article></div></div>", "a"),
    ("<div class='search-results'><article>1</article><article>2</article></div><p>x</p>", "1\n2"),
    ("<main><h1>T</h1><div class='no-sidebar'><article>abc</article></div><p>x</p></main>", "T\nabc\nx"),
    ("<main><p>long text</p><div class='related'><article>teaser</article></div></main>", "long text"),
    ("<article>post</article><div class='comments-area'><article>a long comment</article></div>", "post"),
    ("<div>post</div><div id='comments' class='x'><p>a long comment</p></div>", "post"),
    ("<div id='comments'><article>a comment</article></div>", "a comment"),
    ("<main><form><p>all of it</p></form></main><div class='menu'>a very long menu of many words</div>", "all of it"),
    ("<article><p>a<svg width='1'/>b</p><svg><text>no</text></svg><p>c</p></article>", "ab\nc"),
    ("<p>so <math><mi>x</mi><mo>=</mo><mspace width='1'/><mn>1</mn></math> holds<math/>.</p>", "so x=1 holds."),
    ("<head><meta charset=x><title>t</title><body><p>a</p>", "a"),
])
def test_names_do_not_hide_the_page(source, text):
    assert html.main_text(source) == text


def pages():
    def page(i, notice="Please agree.", body=None):
        return (f"<body><section class='info'>{notice}</section><div class='text'><p>{body or f'Story {i} of many words.'}</p>"
                "<p>Shared last line.</p></div></body>")

    rows = [(i, f"https://user@News.example.org:80/{i}?x#y", page(i)) for i in range(6)]
    rows += [(10 + i, "https://copies.example.org/", page(0, notice=f"n{i}", body="The same story for all pages of this site."))
             for i in range(4)]
    return [*rows, (20, "https://one.example.org/", page(20)), (21, None, page(21)), (22, "https://x.example.org/", None)]


def test_style_tree_removes_what_repeats(spark):
    df = spark.createDataFrame([(*r, "old", 1) for r in pages()], "page_id long, url string, html string, text string, host int")
    got = html.extracted(df)
    assert set(got.columns) == {"page_id", "url", "html", "text", "host"}
    texts = {r.page_id: r.text for r in got.collect()}
    assert all(texts[i] == f"Story {i} of many words.\nShared last line." for i in range(6))
    # The greater part of a page stays though all pages have it; a site of one page has nothing to compare.
    assert all("The same story" in texts[10 + i] for i in range(4))
    assert texts[20].startswith("Please agree.") and texts[22] == ""
    assert html.extracted(df.limit(0)).collect() == []
    repeated = html.extracted(df.where("page_id = 3").unionByName(df.where("page_id = 3")))
    assert [r.text for r in repeated.collect()] == [texts[20].replace("Story 20", "Story 3")] * 2


def test_article_stays_whole(spark):
    def article(i, end):
        return f"<article><h1>T{i}</h1><p>One of the two.</p><p class='lead'>And {i}.</p><ul><li>a<li>b</ul>{end}</article>"

    def plain(i, times):
        return f"<div class='note'>Agree to it.</div><div class='text'><p>Text {i} of the page, and more.</p></div><i>{i}</i>", times

    rows = [("https://a.example.org", article(0, ""))] * 3
    rows += [("https://b.example.org", article(i, "<section>x</section><div class='y'>y</div>")) for i in range(4)]
    rows += [("https://c.example.org", html_) for html_, times in (plain(1, 9), plain(2, 1)) for _ in range(times)]
    got = html.extracted(spark.createDataFrame(rows, "url string, html string"))
    want = [("T0\nOne of the two.\nAnd 0.\na\nb")] * 3
    want += [f"T{i}\nOne of the two.\nAnd {i}.\na\nb\nx\ny" for i in range(4)]
    # Two distinct pages, one of them copied nine times, say too little of what repeats.
    want += [f"Agree to it.\nText {i} of the page, and more.\n{i}" for i in [1] * 9 + [2]]
    assert sorted(r.text for r in got.collect()) == sorted(want)


def test_templates_of_a_large_host(spark):
    def page(i, notice):
        return f"<body>{notice}<div class='text'><p>Text {i} of the page, and more.</p></div></body>"

    rows = [(i, "https://a.example.org", page(i, "<div class='x7'>Agree to it.</div>" * (i < 3))) for i in range(60)]
    got = html.extracted(spark.createDataFrame(rows, "_page int, url string, html string"))
    assert {r["_page"]: r.text for r in got.collect()} == {i: f"Text {i} of the page, and more." for i in range(60)}


def test_half_of_what_is_left():
    page = "<div class='a'>first</div><div class='b'>other</div><div class='c'>third</div>"
    assert html.main_text(page, {">div.a", ">div.b", ">div.c"}) == "other\nthird"


def test_entropies(spark):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string")
    tree = {(r.host, r.path): r for r in html.style_tree(df).collect()}
    notice, text = (tree["news.example.org", f">body>{s}"] for s in ("section.info", "div.text"))
    assert notice.pages == text.pages == 6 and notice.importance == pytest.approx(0)
    assert text.content == pytest.approx(1) and text.presentation == pytest.approx(0)


@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")
def test_tables(spark):
    from tracewell.llm.queries import op5_html

    def plain(source):
        body = source[source.index("<article>") + 9:source.rindex("</article>")]
        blocks = (" ".join(H.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", body))
        return "\n".join(filter(None, blocks))

    sources = {r.page_id: r.html for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    got = op5_html(spark, SF_DIR).collect()
    assert {r.page_id: (r.text, r.n_chars) for r in got} == {i: (plain(s), len(plain(s))) for i, s in sources.items()}


@pytest.mark.parametrize("source,text", [
    ("<article><p class='related-work'>kept</p><div class='search-theory'>too</div><p id='share-of-votes'>yes</p></article>", "kept\ntoo\nyes"),
    ("<article><p>a</p><div class='related-posts'>r</div><div class='ads'>x</div><ul class='share buttons'><li>s</ul></article>", "a"),
    ("<article><p>a</p><p hidden>h</p><div style='color:red; display: none'>n</div><p data-hidden=1>d</p></article>", "a\nd"),
    ("<article><p title='<p>'>a<br/>b</p><img alt=\"x > y\">c <a href='u>d</article>", "a b\nc <a href='u>d"),
])
def test_names_inside_the_article(source, text):
    assert html.main_text(source) == text


@pytest.mark.parametrize("source,size", [
    ("<a " * 350_000, 1_049_999), ("<a '\"<b \"' " * 100_000, 1_099_999), ("<" * 1_000_000, 1_000_000), ("<a <b " * 200_000 + "'", 1_200_001),
    ("<div>" * 100_000 + "x" + "</div>" * 100_000, 1), ("<div class=abcdef1>" * 100_000 + "y", 1), ("<b>" * 50_000 + "<li>" * 50_000 + "z", 1),
    ("<main>" * 30_000 + "q", 1), ("<!--" * 300_000, 0), ("<p>" + "word " * 400_000, 1_999_999)])
def test_very_long_and_deep_pages(source, size):
    began = time.time()
    assert len(html.main_text(source)) == size and time.time() - began < 30


def test_style_tree_alone(spark):
    """Pages without articles and telling names: only what repeats on a host tells its boilerplate."""
    rows, expected = [], {}
    for site in range(3):
        for i in range(6):
            body = [f"Story {site} {i} {w} of its own with some more words" for w in ("begins", "goes on", "ends")]
            rows.append((10 * site + i, f"https://h{site}.org/{i}", "".join([
                f"<div class=q{site}><p>All pages</p><p>Contact {site}</p></div>", "<div class=w>", *(f"<p>{b}</p>" for b in body), "</div>",
                "<section><div class=z><p>Printed on paper</p></div></section>"])))
            expected[10 * site + i] = "\n".join(body)
    rows += [(50, "https://lone.org/", "<div class=z><p>Printed on paper</p></div>")]
    expected[50] = "Printed on paper"
    got = html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.page_id: r.text for r in got.collect()} == expected
    assert html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string").limit(0)).collect() == []
