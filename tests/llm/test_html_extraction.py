import html
import random
import re
import time
import tracemalloc

import pytest

from bitloom.llm import html_extraction as H

PAGE = """<html><body class="has-sidebar"><div id="header">Top</div><div class="menu"><a href=x>Home</a></div><div class="layout with-sidebar"><div class="post-12 content"><h2>T&eacute;st &amp; more</h2>
<p>Some <b>bold</b>ly long text with enough words to be counted as main&nbsp; text.<p>Second para<br>line two<ul><li>one<li>two</ul><form>Search <input></form><div class="share-buttons">Share!</div></div>
<aside>Side text</aside><div id="comments"><p>I like this long comment very much, it is long indeed. Yes it is long.</p></div></div><footer>F</footer>"""


def test_main_text():
    assert H.extract(PAGE, None) == "Tést & more Some boldly long text with enough words to be counted as main text. Second para line two one two"
    assert H.votes(H.Page(PAGE)).most_common(1)[0][0] == ">body.has-sidebar>div.layout.with-sidebar>div.content.post"


@pytest.mark.parametrize(("source", "want"), [
    ("", ""), ("plain text only", "plain text only"), ("<p>unclosed <b>x", "unclosed x"), ("<!-- c", ""), ("<script>x", ""), ("a<![CDATA[b<c]]>d", "ab<cd"), ("<p>a</p><p>b</p>", "a b"),
    ("<p>1 < 2 &lt; 3</p>", "1 < 2 < 3"), ("<article><h1>T</h1><div class='body'><p>words and words and words</p></div><section class='comments'><p>no</p></section></article>", "T words and words and words"),
    ("<nav>n</nav><article><p>x</p></article><div class='cookie-notice'>c</div>", "x"), ("</div></p>text<p>more", "text more"), ("<style>p{}</style><p hidden>h</p><p>v</p>", "v"), ("<div hidden>h</div><p>v</p>", "v"),
    ("<p>a<script>var t='</p>';</script>b</p>", "ab"), ("\U0001F600<br>x", "\U0001F600 x"),
])
def test_fragments(source, want):
    assert H.extract(source, None) == want


def test_whole_table(spark):
    """All pages of the table keep their text in one article element, which a plain expression can cut out."""
    d = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {}
    for r in d.collect():
        inner = re.search(r"(?s)<article>(.*)</article>", r.html)[1]
        want[r.page_id] = " ".join(html.unescape(re.sub(r"<(?:p|br|h1|/p|/h1|b|/b)>", lambda t: "" if t[0] in ("<b>", "</b>") else " ", inner)).split())
    for limit in (200_000, 0):  # winners broadcast, or joined by host
        got = {r.page_id: r for r in H.extract_main_text(d, broadcast_hosts=limit).collect()}
        assert {k: v.text for k, v in got.items()} == want and all(v.n_chars == len(v.text) for v in got.values())


def test_hosts_agree(spark):
    """A page whose own best container is another follows its host; a page without the path uses its own."""
    page = "<body><div class='story'><p>{}</p></div><div class='box'><p>{}</p></div></body>"
    rows = [(i, "http://h.example/a", page.format("long enough story text " * 5, "short")) for i in range(5)]
    rows += [(10, "http://h.example/b", page.format("tiny", "a box that is longer than the story")), (11, "http://h.example/c", "<body><div class='else'><p>other layout text</p></div></body>"), (12, None, None), (12, None, None), (None, "::bad::", "<p>x</p>")]
    d = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, path string")
    got = sorted((-1 if r.page_id is None else r.page_id, r.text) for r in H.extract_main_text(d).collect())
    assert [t for i, t in got if i == 10] == ["tiny"] and [t for i, t in got if i == 11] == ["other layout text"] and [t for i, t in got if i == 12] == ["", ""] and got[0] == (-1, "x")
    assert H.extract_main_text(d.where("false")).count() == 0


def test_odd_urls_have_one_host(spark):
    """Hosts with an underscore or brackets and urls that strict parsers refuse follow their host in both ways."""
    page = "<body><div class='story'><p>{}</p></div><div class='box'><p>{}</p></div></body>"
    odd = ["http://my_host.example/{}", "http://a.example/{} b", "http://b.example/{}|x", "http://c.example/{}[", "http://d.example/{}%", "http://[::1]/{}", "http://E.Example:80/{}"]
    rows = [(100 * k + i, u.format(i), page.format("long enough story text " * 5, "short")) for k, u in enumerate(odd) for i in range(5)]
    rows += [(100 * k + 50, u.format("z"), page.format("tiny", "a box that is longer than the story")) for k, u in enumerate(odd)]
    rows += [(999, "::bad::", "<p>x</p>"), (998, None, "<p>y</p>")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    sent, joined, bounded = ({r.page_id: r.text for r in H.extract_main_text(d, broadcast_hosts=limit, broadcast_bytes=size).collect()} for limit, size in ((200_000, 1 << 20), (0, 1 << 20), (200_000, 50)))
    assert sent == joined == bounded and len(sent) == len(rows) and [joined[100 * k + 50] for k in range(len(odd))] == ["tiny"] * len(odd)


@pytest.mark.parametrize(("source", "want"), [
    ("<article><p>one</p><video src=x><p>two</p><p>three</p></article><p>four", "one two three"),
    ("<article><p>one<object data=x> and</p><p>two</p></article>", "one and two"),
    ("<article><p>a<video src=1></p><p>b</p><p>c<video src=2>no</video>d</p></article>", "a b cd"),
    ("<article><p>a</p><div><audio src=1></div><p>b</p></audio><p>c</p></article>", "a b c"),
    ("<article><p>a<svg><svg>no</svg>no</svg>b</p><template><p>no</p></template><canvas>no</canvas></article>", "ab"),
    ("<article><p>a<svg><title>no</svg>b</p><p>c<svg><title>no</title></svg>d</p></article>", "ab cd"),
    ("<article><p>a</p><math/><p>b</p></article>", "a b"),
])
def test_unclosed_embedded_elements_cut_nothing(source, want):
    assert H.extract(source, None) == want


def test_many_unclosed_elements_stay_linear():
    assert H.extract("<article>" + "<p>a<video src=x>" * 20_000, None) == " ".join("a" * 20_000)


@pytest.mark.parametrize("source", [
    "<a " * 330_000, '<a ">" ' * 150_000, '<a x=">" ' * 110_000, "<div>" * 100_000, "<div>" * 50_000 + "</p></span><li></li>" * 30_000, "<div class=abc><video>" * 45_000, "<!--" * 250_000, "</" * 500_000, "&#" * 500_000,
    "<div " + "class " * 160_000 + ">x", "<script>" + "</script  " * 100_000, "<a x='\"" * 120_000,
], ids=range(12))
def test_hostile_pages_take_linear_time(source):
    start = time.process_time()
    H.extract(source, None)
    assert time.process_time() - start < 15


def test_deep_pages_take_linear_memory():
    used = []  # from 4,000 on, as single growths of a dictionary weigh too much on small pages
    for n in (4_000, 8_000, 16_000):
        tracemalloc.start()
        H.votes(H.Page("<div class='some-name'>" * n + "text here"))
        used.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert used[2] < 5 * used[0] and used[2] < 16_000 << 10


@pytest.mark.parametrize(("source", "want"), [
    ("<p>a&#" + "9" * 10_000 + ";b &#x" + "f" * 10_000 + "; &#0000000000000000065;</p>", "a�b � A"),
    ('<p title="a > b">x</p><p title="a" > b">y</p>', 'x b">y'),
    ('<div class="a>b"><p>x</p></div>', "x"),
    ("<p>1 <2 and 3> 2 <a href='x'>l</a", "1 <2 and 3> 2 l</a"),
    ('<p><i title="x>one</i> two <b class="c">three</b></p>', 'three'),
    ("<p>it's <b title=\"it's\">b</b></p>", "it's b"),
])
def test_quotes_and_references(source, want):
    assert H.extract(source, None) == want


@pytest.mark.parametrize("name", ["commentlist", "comment-list", "commentsection", "comments", "userComments", "CommentThread", "post-comments", "fb-comments", "comment_body"])
def test_reader_comments_are_no_main_text(name):
    page = f"<div class='story'><p>The article is short.</p></div><ol class='{name}'><li>{'a comment that is much longer than the article ' * 20}</li></ol>"
    assert H.extract(page, None) == "The article is short."


TEMPLATES = {
    "divs": "<div id=top class=site-header>{n}</div><div class='wrap'><div class='post post-{i}'><h1>{t}</h1>{p}</div><div class=sidebar><p>{n} {n}</p></div></div><ul class=commentlist>{c}</ul><div class=footer>{n}</div>",
    "table": "<table><tr><td class=menu>{n}</td><td class=text{i}><h2>{t}</h2>{p}</td></tr></table><p class=copyright>{n}</p><form><p>{n}</p><input></form>",
    "main": "<nav>{n}</nav><main><header><h1>{t}</h1></header>{p}<section class=comments>{c}</section></main><aside><p>{n}</p></aside><script>var a = '<p>{n}</p>';</script>",
    "plain": "<div class=cookie-banner><p>{n}</p></div><div class='cols'><div class='col-main'>{p}</div><div class='col-ads ads'>{n}</div></div><!-- {n} --><style>p {{ }}</style><div class='note'><p>{s}</p></div>",
    "broken": "<body><div class=nav><a href='/'>{n}</a></div><div class=entry><h3>{t}</h3>{p}<div class=share>{n}</div><video src=x></div><div class=related><p>{n}</p></div>",
}


def test_templates_by_host(spark):
    """Five templates on two hosts each; the text that was put in comes out, whatever is longer around it on single pages."""
    rng = random.Random(4)
    text = lambda k: " ".join(rng.choice(["river", "stone", "&amp;", "caf&eacute;", "of", "moun<b>tain</b>", "don't", "1 &lt; 2"]) for _ in range(k))
    plain = lambda x: " ".join(html.unescape(re.sub("<[^>]*>", "", x)).split())
    rows, want = [], {}
    for k, (name, template) in enumerate(TEMPLATES.items()):
        for i in range(60):
            title, parts = text(4), [text(rng.choice([2, 3, 12, 40])) for _ in range(rng.choice([1, 2, 6]))]
            noise, comment = text(3), "".join(f"<li>{text(60)}</li>" for _ in range(rng.choice([0, 1, 5])))
            body = "".join(f"<p class=p{j}>{x}</p>\n" if name != "broken" else f"<p>{x}" for j, x in enumerate(parts))
            page = template.format(n=noise, i=i, t=title, p=body, c=comment, s=text(rng.choice([1, 1, 1, 200])))
            rows.append((k * 100 + i, f"https://{name}{i % 2}.example/{i}", page))
            want[k * 100 + i] = " ".join([plain(title)] * (name != "plain") + [plain(x) for x in parts])
    got = {r.page_id: r.text for r in H.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    wrong = [k for k in want if got[k] != want[k]]
    assert not wrong, [(k, got[k][:200], want[k][:200]) for k in wrong[:3]]


STORY = "<h1>Title here</h1><p>" + "The story of the river goes on. " * 8 + "</p><p>It ends well.</p>"
WANT = " ".join(["Title here", ("The story of the river goes on. " * 8).strip(), "It ends well."])
FRAME = "<div class='menu'><a href=x>Home</a> and more menu words</div>{}<div class='footer'>Foot words</div>"


@pytest.mark.parametrize("page", [
    "<div id='wrapper' class='sidebar-right'>" + FRAME.format("<div class='inner'>" + STORY + "</div>") + "</div>",
    "<article class='post comments-open hentry'>" + STORY + "</article><aside>side</aside>",
    "<article class='post tag-ads'>" + STORY + "</article>",
    "<div id='search-page'>" + FRAME.format("<div class='content'>" + STORY + "</div>") + "</div>",
    "<form action='x'>" + FRAME.format("<div class='box'>" + STORY + "</div>") + "<input></form>",
    "<div class='page-header-hidden widget-area'>" + STORY + "</div>",
    "<div class='nav-open'><div class='modal-free login'>" + FRAME.format("<div>" + STORY + "</div>") + "</div></div>",
    "<div class='comments-open single'>" + STORY + "<ol class='commentlist'><li>" + "a comment that is long. " * 40 + "</li></ol></div>",
])
def test_names_alone_lose_no_page(page):
    got = H.extract(f"<html><body>{page}</body></html>", None)
    assert got == WANT, got


def test_words_in_controls():
    assert H.extract("<article><p>Mix the <label>red</label> paint and <button>press</button> it.</p><button>Share</button><form><p>Your <label>name</label></p></form></article>", None) == "Mix the red paint and press it."


def test_short_article_with_long_comments():
    for name in ("comments", "reader-comments", "related-posts"):
        page = f"<body><div class='story'><h2>T</h2><p>The article is short.</p></div><div class='{name}'><div class='text'>{'a remark that is longer than the article ' * 20}</div><form>Reply</form></div></body>"
        assert H.extract(page, None) == "T The article is short."


def test_a_page_of_doubtful_names_only():
    assert H.extract("<div class='notice'><p>All there is.</p></div>", None) == "All there is."
