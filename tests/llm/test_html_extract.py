import pytest

from tablewright.llm import html_extract
from tablewright.llm.html_extract import align, extract, extract_pages, parse, text_of

from .conftest import prose

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header class="top"><h1>Site</h1></header><nav><ul><li><a href=x>Home</a><li><a>News</a></ul></nav><!-- note <p>x</p> -->
<div class="ad">Buy</div><div id="cookie-notice">We use</div><article><h1>Title {i}</h1><p><b>Bold {i}.<br><p>Two &lt;b&gt;
   lines &eacute;&#x41; {body}<aside>see also</aside><form><input><button>Go</button></form><ul><li>one<li>two</ul>
<section class="comments"><p>nice</p></section><footer>by me</footer></article><div class="sidebar"><p>more</p></div>
<footer>&copy; host {i}</footer></body>"""


def page(i, body=""):
    return PAGE.replace("{i}", str(i)).replace("{body}", body)


def test_article_text():
    want = "Title 1\nBold 1.\nTwo <b> lines éA\none\ntwo"
    assert extract(parse(page(1)), parse(page(2)), frozenset()) == want
    assert extract(parse(page(1)), None, frozenset()) == want


@pytest.mark.parametrize("bad,want", [
    ("", ""), ("just text", "just text"), ("a < b & c <3", "a < b & c <3"), ("<p>x<p>y</div></p>z", "x\ny\nz"), ("<p>unclosed <b>b", "unclosed b"),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"), ("<script>x", ""), ("<!-- x", ""), ("<p a='>' b=\"<p>\">q</p>", "q"), ("<p>&amp;amp; &#0; &nope;</p>", "&amp; \ufffd &nope;"),
    ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"), ("<p>a<br>b</p>", "a\nb"), ("x<textarea>no</textarea>y", "xy"), ("<P CLASS=Ad>no</P><p>yes", "yes"),
    ("<div class='topAdSlot'>no</div><div class='headline loaded'>yes</div><div role=dialog>no</div>", "yes"),
])
def test_bad_markup(bad, want):
    assert extract(parse(bad), None, frozenset()) == want


@pytest.mark.parametrize("n", [5, 120, 4000])
def test_nothing_is_cut_at_any_depth(n):
    deep = "<div>" * n + "<p>in</p><script>no()</script><style>no</style><nav>no</nav><aside>no</aside><form>no</form>" + "</div>" * n
    page = f"<body><div><article><p>before</p>{deep}<p>after</p></article></div><p>outside"
    assert extract(parse(page), None, frozenset()) == "before\nin\nafter"
    inline = "<body><article><p>" + "<b>" * n + "bold</p><script>no()</script><p>next</p></article><p>outside"
    assert extract(parse(inline), None, frozenset()) == "bold\nnext"


@pytest.mark.parametrize("n", [5, 120, 4000])
def test_deep_pages_align(spark, n):
    make = lambda i: f"<body>{'<div>' * n}<p>Welcome to all</p><p>own {i}</p>{'<i>x' * (i % 2)}{'</div>' * n}<div>fixed end</div><p>tail {i}"
    a, b = parse(make(0)), parse(make(1))
    assert len(align(a, b)) == 6 + n
    pages = spark.createDataFrame([(i, "http://d.org/x", make(i)) for i in range(0, 12, 2)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in extract_pages(pages).collect()} == {i: f"own {i}\ntail {i}" for i in range(0, 12, 2)}


def test_many_open_tags_and_stray_ends_are_fast():
    page = "<b>" * 20_000 + "</i>" * 20_000 + "<p>x" * 2_000
    assert extract(parse(page), None, frozenset()) == "\n".join(["x"] * 2_000)


LONG = "the whole article is here"


@pytest.mark.parametrize("bad", [
    "<body class='no-sidebar'><article>{}</article>", "<body class='no-sidebar'><div class=content>{}</div>", "<html class=widget><body id=search><p>{}",
    "<body class='search-results'><main class='has-comments'>{}</main>", "<article class='post has-comments'>{}</article><div class=sidebar>more</div>",
    "<div class='elementor-widget-container'><article>{}</article></div>", "<article><div class='elementor-widget-container'>{}</div><div class=share>Tweet</div></article>",
    "<div class='content-sidebar-wrap'><div>{}</div><div class=sidebar>more</div></div>", "<article>{}</article><ol class=comments><li><article>nice</article></ol>",
    "<div class='widget'><article>{}</article></div><article class=teaser>x</article>".replace("<article class=teaser>x</article>", "<p>" + "outside " * 20),
])
def test_marks_never_take_the_article(bad):
    assert extract(parse(bad.format(LONG)), None, frozenset()) == LONG


@pytest.mark.parametrize("inside,want", [
    ("<p class='notice-of-works'>Works begin on Monday.</p>", LONG + "\nWorks begin on Monday."), ("<section id=discussion>nice</section>", LONG),
    ("<div class='user-feedback'>nice</div>", LONG), ("<div class='post-comments list'>nice</div>", LONG), ("<p class='ad-hoc'>kept</p>", LONG + "\nkept"),
    ("<p class='formula search-space'>kept</p>", LONG + "\nkept"), ("<div class='sidebar-left'>more</div>", LONG),
])
def test_names_that_say_more_than_a_mark(inside, want):
    assert extract(parse(f"<body><article><p>{LONG}</p>{inside}</article>"), None, frozenset()) == want


def test_many_slots_of_one_mark_are_content():
    blocks = "".join(f"<div class='widget'><p>part {i}</p></div>" for i in range(9))
    assert extract(parse(f"<body>{blocks}<div class=sidebar>more</div>"), None, frozenset()) == "\n".join(f"part {i}" for i in range(9))


def test_marks_yield_to_what_varies(spark):
    """A constant block longer than the article does not make its marked slot a small one."""
    fixed, own = prose(1, 200), [f"own text {i} {prose(i, 6)}" for i in range(6)]
    pages = [(i, "http://w.org/x", f"<body class=no-sidebar><div>{fixed}</div><div class=widget><p>{own[i]}</p></div><div class=share>s{i}</div>") for i in range(6)]
    got = extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string"))
    assert {r.page_id: r.text for r in got.collect()} == dict(enumerate(own))


def test_alignment_is_largest():
    a, b = parse("<div><p>1</p><ul><li>x</ul><p>2</p></div>"), parse("<div><ul><li>y<li>z</ul><p>2</p><hr></div>")
    assert sorted(x.tag for x, _ in align(a, b)) == ["#page", "div", "li", "p", "ul"]
    assert align(parse("<i>"), parse("<b>"))[0][0].tag == "#page" and len(align(parse("<i>"), parse("<b>"))) == 1


def rows():
    soup = lambda i: f"<body><div><p>Welcome to our site</p></div><div><p>{prose(i, 30)}</p><p>{prose(i + 50, 9)}</p></div><div>All rights kept</div>"
    return [(i, f"http://soup.org/{i}", soup(i)) for i in range(12)] + [(100 + i, f"http://art.org/{i}", page(i, prose(i, 5))) for i in range(5)] + [
        (200, None, page(9)), (201, "http://soup.org/x", None), (202, "no scheme", ""), (None, "http://one.org", "<p>only</p>"), (0, "http://soup.org/0", soup(0)),
    ]


@pytest.mark.parametrize("limit", [html_extract.BROADCAST_BYTES, 0])
def test_wrappers_per_host(spark, monkeypatch, limit):
    monkeypatch.setattr(html_extract, "BROADCAST_BYTES", limit)
    pages = spark.createDataFrame([(*r, "c") for r in rows()], "page_id long, url string, html string, _host string")
    got = extract_pages(pages).collect()
    assert len(got) == len(rows()) and all(r.n_chars == len(r.text) for r in got)
    by = {(r.page_id, r.url): r.text for r in got}
    for i in range(12):  # what is the same on all pages of the host is template
        assert by[i, f"http://soup.org/{i}"] == prose(i, 30) + "\n" + prose(i + 50, 9)
    for i in range(5):
        assert by[100 + i, f"http://art.org/{i}"] == f"Title {i}\nBold {i}.\nTwo <b> lines éA {prose(i, 5)}\none\ntwo"
    assert by[201, "http://soup.org/x"] == "" == by[202, "no scheme"] and by[None, "http://one.org"] == "only"


def test_copies_of_an_article_are_no_template(spark):
    pages = spark.createDataFrame([(i, "http://a.org/x", page(1, "same")) for i in range(9)], "page_id long, url string, html string")
    assert {r.text for r in extract_pages(pages).collect()} == {"Title 1\nBold 1.\nTwo <b> lines éA same\none\ntwo"}


def test_copies_without_an_article_slot_keep_their_text(spark):
    copy = "<body><div><p>the same text</p></div><div class=menu>m</div>"
    pages = spark.createDataFrame([(i, "http://b.org/x", copy) for i in range(9)], "page_id long, url string, html string")
    assert {r.text for r in extract_pages(pages).collect()} == {"the same text"}


@pytest.mark.parametrize("limits", [(html_extract.BROADCAST_BYTES, html_extract.BROADCAST_ROWS), (0, 0)])
def test_each_layout_of_a_host_has_its_template(spark, monkeypatch, limits):
    monkeypatch.setattr(html_extract, "BROADCAST_BYTES", limits[0])
    monkeypatch.setattr(html_extract, "BROADCAST_ROWS", limits[1])
    own = [f"own {i} {prose(i, 20)}" for i in range(26)]
    layouts = [
        "<body class='postid-{i}'><div id='wrap-{i}'><p>Welcome to the blog</p></div><div id='content-{i}'>{own}</div><div>All rights</div>",
        "<body class='page page-{i}'><section><p>The shop opens at nine</p></section><div class=top><div>Call us</div><div id='item{i}x'>{own}</div></div>",
        "<body><div><p>Forum rules</p></div><div>{own}</div><div>Powered by us</div><div>Terms</div>",
    ]
    html = [layouts[i % 3].format(i=i, own=own[i]) for i in range(24)]
    # Two pages alike in nothing else: their texts are all their own.
    html += [f"<body><center>{own[24]}</center>", f"<body><section>{own[25]}</section><center></center>"]
    pages = spark.createDataFrame([(i, "http://three.org/x", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in extract_pages(pages).collect()} == dict(enumerate(own))


def test_layouts_of_few_pages_share_one_template(spark):
    """Every page has a layout of its own, by the number of its blocks."""
    make = lambda i: "<body><div><p>Welcome</p></div>" + "".join(f"<div>own {i} {k}</div>" for k in range(i + 1)) + "<footer>f</footer>"
    pages = spark.createDataFrame([(i, "http://f.org/x", make(i)) for i in range(8)], "page_id long, url string, html string")
    want = {i: "\n".join(f"own {i} {k}" for k in range(i + 1)) for i in range(8)}
    assert {r.page_id: r.text for r in extract_pages(pages).collect()} == want


def test_empty_table(spark):
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
    assert text_of(parse("<p>x")) == "x"
