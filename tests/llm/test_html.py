"""Main text of pages: hand-made pages, consensus of a host, broken markup, the given pages."""

import html as escapes
import re

import pytest

from dwitable.llm import html
from dwitable.llm.queries import QUERIES

SCHEMA = "page_id long, url string, html string, host string, winner int"

PAGES = [
    ("", ""), ("plain &amp; simple &#233;&nbsp;&lt;p&gt;", "plain & simple é <p>"),
    ("<p>a<b>b</b> c<br>d</p><p>e  \n f", "ab c d e f"),
    ("<head><title>t</title><style>p{}</style></head><body><article><h1>Head</h1><p>one</p></article><footer>f</footer>", "Head one"),
    ("<body><nav><a href=1>menu<article><p>aaa<p>bbb<ul><li>x<li>y</ul></article><aside>s</aside>", "aaa bbb x y"),
    ("<div class=content><p>Long main text of the page.<div class='ad-box 12'>buy</div><p>End.</div><div id=sidebar><p>side</div>",
     "Long main text of the page. End."),
    ("<div class=with-sidebar><main><p>Main words here.</main><div class=sidebar>x</div></div>", "Main words here."),
    ("<main><p>The story goes on and on.</p><section id=comments><article><p>I say a lot, really a lot, in a comment.</article></section></main>",
     "The story goes on and on."),
    ("<article>Text<script>var a='</p><p>no';</script><form>name<input></form><!-- <p>hidden</p> -->more</article>", "Text more"),
    ("<article><p hidden>no<p style='display: none'>no</p><p>yes</article>", "yes"),
    ("<article>1 < 2 and 3 > 2 <unknown-tag>ok</unknown-tag></article>", "1 < 2 and 3 > 2 ok"),
    ("<article>never closed <p>text", "never closed text"), ("<article title='a > b'>x</article>", "x"),
    ("<article title=\"open>y</article>", "y"), ("<!-- all of it <p>x", ""),
    ("<div class=cookie-notice>We use cookies</div><article>Body</article><div class=newsletter>Join</div>", "Body"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"),
]


@pytest.mark.parametrize("source, text", PAGES)
def test_pages(source, text):
    assert html.Page(source).main_text(None)[0] == text


def test_a_host_agrees_on_a_container(spark):
    page = "<div class='story x{0}'><p>{1}</div><div class='talk'><p>{2}</div>"
    rows = [(i, f"http://a.org/{i}", page.format(i, "The text. " * 20, "Short."), "c", 1) for i in range(20)]
    rows += [(50, "http://A.org:80/odd", page.format(3, "Brief text.", "Much talk " * 300), "c", 1),
             (51, "http://b.org/odd", page.format(3, "Brief text.", "Much talk " * 300), "c", 1),
             (52, "http://a.org/else", "<section>Other page</section>", "c", 1), (53, None, "<p>no url", "c", 1), (54, "http://a.org", None, "c", 1),
             (53, None, "<p>no url", "c", 1), (None, "http://a.org/n", "<p>x", "c", 1)]
    found = {}
    for r in html.main_texts(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect():
        found.setdefault(r["page_id"], []).append(r["text"])
    assert found[50] == ["Brief text."]
    assert found[51][0].startswith("Brief text. Much talk")  # alone, nothing outvotes it
    assert found[0] == [("The text. " * 20).strip()]
    assert (found[52], found[53], found[54], found[None]) == (["Other page"], ["no url"] * 2, [""], ["x"])
    assert html.main_texts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_given_pages(spark):
    path = "/root/testdata/sf0.01"
    source = {r[0]: r[1] for r in spark.read.parquet(f"{path}/pages.parquet").select("page_id", "html").collect()}
    rows = QUERIES["op10_html_extraction"](spark, path).collect()
    assert len(rows) == len(source)
    for r in rows:
        body = re.search(r"<article>(.*?)(</article>|\Z)", source[r["page_id"]], re.S)[1]
        body = re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br)>", " ", body))
        assert r["text"] == " ".join(escapes.unescape(body).split()) and r["n_chars"] == len(r["text"])


def test_deep_and_long_pages():
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    assert html.Page(deep).main_text(None)[0] == "x"
    words = "word " * 200_000
    assert html.Page(f"<article><p>{words}</article>").main_text(None)[0] == words.strip()
    assert html.Page("<a \"" * 3000).main_text(None)[0] is not None


WRAPPED = [
    ("<div class='page has-comments'><article><p>Text</p></article></div>", "Text"),
    ("<form id=f><div class=content><p>Text</p></div></form>", "Text"),
    ("<div class='page with-sidebar'><div class=content><p>Text</p></div></div>", "Text"),
    ("<article class='post no-ads'><p>Text</article>", "Text"),
    *((f"<div>Logo</div><div class='page {word}'><main><p>The text of the page.</main></div>", "The text of the page.")
      for word in "social cookie share search sidebar has-ads".split()),
    *((f"<div class='page {word}'><div class=x><p>The text.</div><div class=footer>f</div></div>", "The text.")
      for word in "social cookie share search ad comments".split()),
    ("<div>Logo</div><form><div class=menu>Home</div><div class=content><p>The text of the page.</div></form>", "The text of the page."),
    ("<div>Logo</div><div class='page social'><p>" + "The text. " * 20 + "</div>", "Logo" + " The text." * 20),
    # marks that hold
    ("<div class='page social'><p>Story.</p><div class=comments><div class=text>" + "A comment. " * 20 + "</div></div></div>", "Story."),
    ("<div><p>The story.</div><div class=comments><article>" + "A comment. " * 20 + "</article></div>", "The story."),
    ("<div class=text>The story.</div><div class=cookie-notice><div class=content>We use a lot of cookies.</div></div>", "The story."),
    ("<main>The story.<div class=newsletter><div class=content>Join us, join us</div></div><form>name</form></main>", "The story."),
    ("<article>One</article><div class=related><article>Other page, other page</article></div>", "One"),
    ("<nav>Home</nav><div hidden><div class=content>no</div></div>", ""), ("<div class=menu><a href=x>Home</a></div>", ""),
]


@pytest.mark.parametrize("source, text", WRAPPED)
def test_marks_on_wrappers(source, text):
    assert html.Page(source).main_text(None)[0] == text


def test_nested_wrappers():
    source = "<div class=social>" * 300 + "<p>The text of the page." + "</div>" * 300
    assert html.Page(source).main_text(None)[0] == "The text of the page."


def test_all_parts_at_the_path():
    page = html.Page("<body><article>One two three four.</article><div class=ad>buy</div><article>Five.</article><p>o</p><article>Six <a>seven</a></article>")
    assert page.main_text(">body>article")[0] == "One two three four. Five. Six seven"
    long = "The article of this page. " * 40
    for box in ("<div class=tip>Small box.</div>", "<div class=content>Small box.</div>"):
        path = ">body>div." + ("tip" if "tip" in box else "content")
        for source in (f"<body>{box}<article>{long}</article>", f"<body><main><p>{long}</main>{box}"):
            assert html.Page(source).main_text(path)[0] == long.strip()
    assert html.Page(f"<body><div class=tip>Box.</div><p>{long}").main_text(">body>div.tip")[0] == "Box. " + long.strip()
    half = "<body><div class=x>" + "Some text. " * 20 + "</div><main>" + "More text. " * 30 + "</main>"
    assert html.Page(half).main_text(">body>div.x")[0] == ("Some text. " * 20).strip()
    deep = "<div>" * 600 + "x y" + "</div>" * 600  # paths end at a length, so nested containers share one
    assert html.Page(deep).main_text(html.Page(deep).best().path)[0] == "x y"


def test_parts_and_other_templates_on_a_host(spark):
    text = "The text of an article. " * 10
    rows = [(i, "http://a.org/x", f"<body><article>{text}</article>", "c", 1) for i in range(20)]
    rows += [(30, "http://a.org/x", f"<body><article>{text}</article><div class=ad>buy</div><article>Second part.</article>", "c", 1),
             (31, "http://a.org/x", f"<body><article>Box.</article><main>{text}</main>", "c", 1)]
    found = {r["page_id"]: r["text"] for r in html.main_texts(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    assert found == {**dict.fromkeys(range(20), text.strip()), 30: text + "Second part.", 31: text.strip()}


def alone(page):
    return html.Page(page).main_text(None)[0]


def test_attributes_are_read_in_order_and_by_their_whole_name():
    for attributes in ('title="a hidden gem"', "title='style=display:none'", 'data-hidden="true"', "data-class=sidebar", 'data-id="comments" data-role=navigation',
                       'alt="x" class="content" title="class=sidebar hidden"', "class=content id=a1 class=sidebar", 'x-hidden hidden-x aria-hidden="false"',
                       'title="1 > 0 hidden"', "title=hidden", 'title = "hidden"', 'title=a"hidden', "title='a\"hidden'"):
        assert alone(f"<article {attributes}><p>The whole text.</p></article>") == "The whole text.", attributes
        assert alone(f"<div class=content data-x {attributes}><p>The whole text.</p></div>") == "The whole text.", attributes
    for attributes in ("hidden", "HIDDEN=''", 'a="b" hidden', "title=x hidden", 'class="y"hidden', "style='color:red; Display: none'", "aria-hidden=true",
                       "class=comments", 'id="comments"', "role='navigation'", "title='it' class=sidebar"):
        page = f"<body><div class=main><p>Kept text of the page.</p><div {attributes}><p>gone</p></div></div></body>"
        assert alone(page) == "Kept text of the page.", attributes


def test_apostrophes_and_quotes_outside_values():
    assert alone("<p title=Bob's>First</p><p>second don't stop</p><p>third</p>") == "First second don't stop third"
    assert alone("<p title=5\">one</p><p>\"two\"</p><p 'x>three</p>") == "one \"two\" three"
    assert alone("<div class=\"a>b\" id='c>d'>in</div>") == "in"
    assert alone('<p class="never closed>first</p><p>second</p>') == "first second"
    assert alone("<a href=x=\"y>one</a> two") == "one two"


def test_an_article_in_sections_beside_a_long_menu():
    intro, body, menu = "intro words " * 40, "body words " * 40, "menu entry " * 40
    page = f"<body><nav>{menu}</nav><section class=intro>{intro}</section><section class=body>{body}</section></body>"
    assert alone(page) == (intro + body).strip()
    thirds = "".join(f"<div class=part-{x}>{x * 3} {'text of it ' * 30}</div>" for x in "abc")
    links = "<div class=more>" + "<a href=x>another page of this site</a> " * 30 + "</div>"
    assert alone(f"<body><nav>{menu}</nav><div class=wrap>{thirds}</div>{links}</body>").split()[::91] == ["aaa", "bbb", "ccc"]
    assert "another" not in alone(f"<body><nav>{menu}</nav><div class=wrap>{thirds}</div>{links}</body>")
    assert alone(f"<body><article>{body}</article><section class=latest>{intro[:99]}</section></body>") == body.strip()


def test_deep_containers_have_paths_of_their_own(spark):
    deep = "".join(f"<div class={'level' * 20}-{'x' * i}>" for i in range(60))
    page = f"{deep}<div class=one>{'first text ' * 30}</div><blockquote class=two>quoted</blockquote>{'</div>' * 60}"
    paths = [n.path for n in html.Page(page).containers]
    assert len(set(paths)) == len(paths) and max(map(len, paths)) < 3 * html.LONG_PATH
    rows = [(i, f"http://deep.example/{i}", page) for i in range(4)]
    found = html.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in found} == {"first text " * 30 + "quoted"}


def test_a_host_whose_articles_lie_in_differently_classed_siblings(spark):
    def page(i):
        parts = "".join(f"<div class={c}>part {c} of {i} {'and so on ' * 20}</div>" for c in ("lead", "rest"))
        return f"<body><div class=menu>{'menu ' * 90}</div><div class=wrap>{parts}</div><div class=footer>end</div></body>"

    rows = [(i, f"http://split.example/{i}", page(i)) for i in range(6)] + [(9, "http://split.example/9", "<div class=wrap><div class=lead>short</div></div>")]
    found = {r["page_id"]: r["text"] for r in html.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(f"part lead of {i}" in found[i] and f"part rest of {i}" in found[i] and "menu" not in found[i] for i in range(6))
    assert found[9] == "short"
