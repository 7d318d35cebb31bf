import html as H
import re

from twinledger.llm import templates
from twinledger.llm.templates import Page, extract

SCHEMA = "page_id long, url string, html string, n_chars string"


def text(page, template=()):
    return Page(page).main_text(set(template))


def test_blocks_and_references():
    assert text("<p>a &amp;amp; b&nbsp;c &#233;&eacute;</p><p>\n d\t e <b>f</b>g<i>h</i></p>") == "a &amp; b c éé\nd e fgh"
    assert text("x<br>y<p>z<p>w") == "x y\nz\nw"
    assert text("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>") == "a\nb\nc\nd\ne"
    assert text("a < b and c > d & e <3") == "a < b and c > d & e <3"
    assert text('<p title="a>b">t</p>') == "t" and text("<p title=\"open>t</p>") == "t"
    assert text("") == "" and text("<") == "<" and text("plain") == "plain" and text("<p>cut off <b>he") == "cut off he"


def test_what_is_left_out():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header>H</header><nav>N</nav><div class="cookie-notice">C</div>
    <script>var t="</p><p>no";</script><!-- <p>no</p> --><main><article><header><h1>Title</h1></header><p>One</p><div class="ad">AD</div>
    <form><p>F</p></form><section class="share">S</section><p>Two</p><aside>A</aside></article><section id="comments"><article><p>Me first</p></article></section></main>
    <div class="sidebar">side</div><footer>&copy; F</footer></body></html>"""
    assert text(page) == "Title\nOne\nTwo"
    assert text("<body><div class=menu>M</div><div><p>Body text</p></div><div hidden>x</div></body>") == "Body text"
    assert text("<main><p>M</p></main><p>outside</p>") == "M"
    assert text("<div class='adorable'>kept</div>") == "kept" and text("<div class='page no-sidebar has_ads'>kept</div>") == "kept"


def test_inline_and_form_elements():
    assert text("<article><p>x</p><button>Subscribe</button></article>") == "x"
    assert text("<p>a <span class='ad'>AD <span>in</span> ad</span>b<label>L</label> <span hidden>h</span>c <a class='share'>S</a><ins class=adsbygoogle>G</ins>d</p>") == "a b c d"
    assert text("<div class='adbox'>AD</div><p>t <b class='note'>kept</b></p><datalist><option>o</datalist>") == "t kept"
    assert text("<div>a <span class=ad><div>x</div>y</span>b</div>") == "a\nb"
    assert text("<p>a<span class=ad>AD</p><p>b</p>") == "a\nb" and text("<p><span class=ad><i>x</i><br>y</span>z</p>") == "z"


def test_articles_are_never_lost():
    for page in ("<article class='post ad-free'><p>x</p></article>", "<article class='post comments-open'><p>x</p></article>", "<div class='social-science'><article><p>x</p></article></div>",
                 "<div id='widget-area'><article><p>x</p></article></div>", "<div id='widget-area'><main><p>x</p></main></div>", "<div class='widgetArea'><div><article><p>x</p><div class='share-bar'>s</div></article></div></div>"):
        assert text(page) == "x", page
    assert text("<article><p>x</p></article><div id='widget-area'><article><p>teaser</p></article></div>") == "x"
    assert text("<p>x</p><div class='comment-list'><article><p>Me first</p></article></div>") == "x"


def test_headers_of_articles():
    page = "<article><header><h1>Title</h1><p>By A. Writer</p><nav>n</nav><hgroup><h2>Sub</h2></hgroup></header><p>x</p></article>"
    assert text(page) == "Title\nSub\nx"


def test_long_and_hostile_pages():
    for page in ("<p>" * 50000 + "x", "<div>" * 3000 + "x", '<a "' * 3000, "<" * 100000, "<!--" * 20000, "<p>" + "word " * 200000, "<li>" * 3000 + "y", "<svg>" * 100000, "<script>a</script>" * 3000):
        text(page)


def test_extract(spark):
    cookie, menu = "<section><p>We use biscuits, please agree</p></section>", "<table><tr><td>Home</td><td>News</td></tr></table>"
    rows = [(i, f"http://A.example.com/{i}", f"<body>{menu}<div><p>Story {i}</p><p>same line everywhere</p></div>{cookie}</body>", "x") for i in range(30)]
    rows += [(100 + i, f"http://b.example.com/{i}", f"<body><article><div><p>Copy</p></div><p>same line everywhere</p></article></body>", "x") for i in range(30)]
    rows += [(200, None, None, None), (None, "no host", "", "x"), (201, "http://c.org", f"<body>{menu}<p>x</p></body>", "x")] + rows[:1]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(str, extract(df, small=0).collect())) == sorted(map(str, extract(df).collect()))
    out = extract(df)
    assert out.columns == ["page_id", "url", "html", "text", "n_chars"]
    got = {r.page_id: r for r in out.collect()}
    assert out.count() == len(rows)
    # a paragraph that recurs outside an article is template too, the story's own paragraph is not
    assert all(got[i].text == f"Story {i}" for i in range(30))
    # copies of one page count once, so nothing of theirs is template
    assert all(got[100 + i].text == "Copy\nsame line everywhere" for i in range(30))
    assert got[200].text == "" and got[None].text == "" and got[200].n_chars == 0 and got[201].text == "Home\nNews\nx"
    assert extract(df.limit(0)).count() == 0


def test_pages_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in extract(pages).collect():
        body = re.search("<article>(.*?)</article>", r.html, re.S).group(1)
        want = [" ".join(H.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"<p>|</p>|<h1>|</h1>", body)]
        assert r.text == "\n".join(b for b in want if b) and r.n_chars == len(r.text)


def test_large_host_with_many_layouts(spark):
    # eight layouts, each with its own menu on an eighth of the host's pages, and no article
    rows = [(i, f"http://a.example.com/{i}", f"<body><div><p>Menu {i % 8}</p></div><div><p>Story {i}</p></div></body>", "x") for i in range(960)]
    assert all(r.text == f"Story {r.page_id}" for r in extract(spark.createDataFrame(rows, SCHEMA)).collect())


def test_weak_marks_and_counted_blocks(spark):
    for mark in "reader-comments userComments comment_thread cookie-law-info ad-label subscribe-now share-this author-sidebar mobile-menu-toggle related-stories".split():
        page = templates.Page(f'<article><h1>Title here</h1><p>Some text.</p><div class="{mark}"><p>BAD</p></div></article>')
        assert page.main_text(set()) == "Title here\nSome text."
    for mark in ("has-comments", "no-sidebar", "story-share-body", "content-with-sidebar"):
        # a box around the article, and one that holds most of it
        assert templates.Page(f'<div class="{mark}"><article><p>The text of this page.</p></article></div>').main_text(set()) == "The text of this page."
        assert templates.Page(f'<article><div class="{mark}"><p>The text of this page.</p></div><p>end</p></article>').main_text(set()) == "The text of this page.\nend"
    # no name and no mark tells these blocks apart: only how often they occur on the host
    page = lambda i: f"<article><p>Own text {i}.</p><div><p>Read more on our site.</p></div><p>Printed with care.</p><p>Rare {i % 9}.</p></article>"
    rows = [(i, f"http://a.net/{i}", page(i)) for i in range(30)] + [(100 + i, f"http://b.net/{i}", page(i)) for i in range(8)]
    got = {r.page_id: r.text for r in templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Own text {i}.\nRare {i % 9}." for i in range(30))
    # few pages: the container goes, the article's own text blocks stay
    assert all(got[100 + i] == f"Own text {i}.\nPrinted with care.\nRare {i % 9}." for i in range(8))
