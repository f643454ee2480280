import time

import pytest

from cradlemart.llm.html_text import extract_main_text, main_text, page_hashes

CASES = [
    (None, ""), ("", ""), ("plain  text", "plain text"), ("<p>a<p>b</p>c", "a b c"),
    ("<article><h1>T</h1><p><b>x<br><p>y &amp; z&lt;</p></article><footer>f</footer>", "T x y & z<"),
    ('<script>var t="</p>";</script><nav><a>m</a></nav><div class="ad">buy</div><article>a<i>b</i>c</article>', "abc"),
    ("<article><p>one\n\t two</p><form>f</form><aside>s</aside></article>", "one two"),
    ("<main><section class='comments'><article>long comment text here</article></section><article>short</article></main>", "short"),
    ("<ul><li>a<li>b</ul>", "a b"), ("<table><tr><td>1<td>2<tr><td>3</table>", "1 2 3"),
    ("<article>text <a href='x", "text"), ("<article>x<!-- y --> z <!-- w", "x z"),
    ("<article>a &#233; &eacute; &copy</article>", "a é é ©"), ("<ARTICLE>Up</ARTICLE>", "Up"),
    ("<article><header><h1>Title</h1></header><p>body</p></article><header>top</header>", "Title body"),
    ("<article>" + "<div>" * 5000 + "deep" + "</div>" * 5000 + "</article>", "deep"),
    ("<article>" + "word " * 50_000 + "</article>", ("word " * 50_000).strip()),
    ("<article><p hidden>no</p><p style='display:none'>no</p><p>yes</p></article>", "yes"),
    ('<article>a < b and c > d <p title="x>y">q</p></article>', "a < b and c > d q"),
    ("<article><style>p{}</style><p>s</p><noscript>n</noscript></article>", "s"),
    ('<div class="layout no-sidebar"><p>the text</p></div><div class="sidebar">s</div>', "the text"),
    ('<div id="content" class="post has-share"><p>the text</p><div class="share">s</div></div>', "the text"),
    ('<div class="page with-sidebar"><article><p>the text</p></article><div class="sidebar">s</div></div>', "the text"),
    ('<div class="sidebar-right"><article><p>the text</p></article></div>', "the text"),
    ('<form action="/"><article><p>the text</p><form>f</form></article></form>', "the text"),
    ('<article><p>one</p><p class="promotion">two</p><div class="promotion">buy</div></article>', "one two"),
    ("<div><article>first story</article><article>second</article></div><aside><article>teaser</article></aside>", "first story second"),
    ("<article><p>story</p><section class='comments'><article>a very long comment indeed</article></section></article>", "story"),
    ("<div class='widget'><p>only this</p></div>", "only this"),
]


@pytest.mark.parametrize(("source", "text"), CASES)
def test_main_text(source, text):
    assert main_text(source) == text


def test_site_template_goes(spark):
    rows = [(i, f"http://a.example/{i}", f"<article><div>Follow our daily letter</div><p>story {i}</p><p>{'shared' if i < 4 else i}</p></article>") for i in range(10)]
    rows += [(100 + i, f"http://b.example/{i}", "<article><div>Follow our daily letter</div><p>other</p></article>") for i in range(2)]
    rows += [(200, None, None), (201, "", "<p>x</p>"), (None, "no host", "<p>y</p>"), (0, "http://a.example/0", rows[0][2])]
    pages = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, html string, host string")
    got = {(r.id, r.url): r.text for r in extract_main_text(pages).collect()}
    assert extract_main_text(pages).count() == len(rows)
    assert got[0, "http://a.example/0"] == "story 0 shared" and got[9, "http://a.example/9"] == "story 9 9"
    assert got[100, "http://b.example/0"] == "Follow our daily letter other"
    assert got[200, None] == "" and got[201, ""] == "x" and got[None, "no host"] == "y"
    assert extract_main_text(pages.limit(0)).count() == 0


def test_copies_of_an_article_are_one_page(spark):
    story = "<article><h1>Big</h1><div>Follow our daily letter</div><p>the whole story</p></article>"
    rows = [(i, f"http://a.example/big?utm_source={i}", story + f"<div>{i}</div>") for i in range(12)]
    rows += [(50 + i, f"http://a.example/{i}", f"<article><div>Follow our daily letter</div><p>story {i}</p></article>") for i in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.id: r.text for r in extract_main_text(pages).collect()}
    assert {got[i] for i in range(12)} == {"Big the whole story"} and got[53] == "story 3"


def test_text_that_other_articles_share_stays(spark):
    page = "<article><h1>T{0}</h1><p>c{0} item {0}</p><table><tr><td>Colour<td>c{0}<tr><td>Washable<td>Yes</table><p>Free returns</p></article>"
    pages = spark.createDataFrame([(i, f"http://s.example/{i}", page.format(i)) for i in range(10)], "page_id long, url string, html string")
    got = {r.id: r.text for r in extract_main_text(pages).collect()}
    assert got[1] == "T1 c1 item 1 Colour c1 Washable Yes Free returns"


def test_templates_as_counted_one_by_one(spark):
    parts = [f"<div>part {k} of the site</div>" for k in range(6)]
    rows = [(i, f"http://h{i % 2}.example/{i}", f"<article><p>story {i}</p>{''.join(parts[k] for k in range(6) if (i // 2) % (k + 1) == 0)}</article>") for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.id: r.text for r in extract_main_text(pages).collect()}
    for i, _, _ in rows:
        shown = [k for k in range(6) if (i // 2) % (k + 1) == 0]
        often = [k for k in range(6) if sum((j // 2) % (k + 1) == 0 for j in range(i % 2, 40, 2)) >= 10]
        assert got[i] == " ".join([f"story {i}"] + [f"part {k} of the site" for k in shown if k not in often])


@pytest.mark.parametrize("page", ["<div>" * 40_000 + "x", "<b>" * 40_000 + "x", "<b>x<p>" * 40_000, "<article>x<div>" * 20_000, "<li>x" * 60_000])
def test_time_in_proportion_to_the_page(page):
    begin = time.process_time()
    page_hashes(page)
    main_text(page, frozenset({1}))
    assert time.process_time() - begin < 10
