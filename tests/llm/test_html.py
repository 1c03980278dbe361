import time
from html.parser import HTMLParser

from anomalake.llm import html
from anomalake.llm.queries import op5_html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1><a href=/>Home</a></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- <p>hidden</p> -->
<div class="cookie-notice">We use cookies on this site and you have to accept all of them now.</div><div class="ad">Buy it now</div>
<article><header><h1>The&nbsp;title &amp; more</h1></header><p><b>First</b> block of the text, that is long enough to be decided by its own length.<br>
second   line<p>Short.</p><ul><li>An item</li></ul><form><input value=x>Send <button>Go</button></form><aside>Related: <a href=1>one</a></aside>
<div class="comments"><article class="comment"><p>A reader says that this is a very good article and he liked all of it a lot.</p></article></div></article>
<aside class="sidebar">Side</aside><footer>&copy; 2024</footer></body></html>"""


def test_article_alone_is_kept():
    assert html.extract(PAGE) == "The title & more First block of the text, that is long enough to be decided by its own length. second line Short. An item"


def test_page_without_article_uses_density():
    good = "It is a text that has many of the words that are found in all of the texts, and it is long enough to be kept by the rules. " * 2
    page = f"<div><a href=1>one</a> <a href=2>two</a></div><div>{good}</div><p>Short one.</p><div>{good}</div><p>© owner of the site</p>"
    assert html.extract(page) == " ".join(f"{good}Short one. {good}".split())


def test_odd_pages():
    for page in (None, "", "   ", "<", "<p", "<!-- open", "<script>x", "</p></p>", "<nav>a</nav>", "<a " + "b" * 100_000, "<p>" * 5000):
        assert html.extract(page) in ("", "<"), page
    assert html.extract("<article>a &amp b &am</article>") == "a & b &am"
    assert html.extract("<article>x<b>y</b>z<p>1<p>2") == "xyz 1 2"
    assert html.extract("<article>" + "w " * 300_000) == ("w " * 300_000).strip()


def test_query(spark):
    rows = op5_html(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 50 and all(r.n_chars == len(r.text) > 0 for r in rows)
    assert not any("©" in r.text or "·" in r.text for r in rows)


def test_operator_on_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, "<article>a", None)], "page_id long, html string, text string")
    assert sorted(r.text for r in html.main_text(df).collect()) == ["", "a"]
    assert html.main_text(df.limit(0)).count() == 0


def test_whole_classes_of_pages():
    chinese = "这是一篇关于城市历史的长文章，它讲述了许多年前的人们如何生活。" * 20
    russian = "Это большой текст о жизни города. Он рассказывает о людях и о том, как они жили. " * 3
    assert html.extract(f"<div><a href=1>菜单</a></div><p>{chinese}</p>") == chinese
    assert html.extract(f"<p>{russian}</p><div>Меню</div>").startswith(russian.strip())
    assert html.extract("<article class='article header-large'><p>One.</p></article>") == "One."
    assert html.extract("<main id=social-main><h1 class=header>T</h1><p>One.</p></main>") == "T One."
    assert html.extract("<article class=post><p>One.</p></article><article class=comment><p>Two.</p></article>") == "One."
    sign = "The sign © is put by the author of a work in front of the year in which it was made, and of the name of the one who holds the right in it, so that all of the readers know to whom it belongs and from when on."
    assert html.extract(f"<div>{sign}</div><div>© 2024 the owner of all that is on this site and of the rest of it, too</div>") == sign
    for name in ("footer-links", "site-header", "cookieNotice", "related-posts", "share-buttons", "comment-list"):
        assert html.extract(f"<article><p>One.</p><div class='{name}'>Two.</div></article>") == "One.", name


def test_many_blocks_take_linear_time():
    good = "It is a text that has many of the words that are found in all of the texts, and it is long."
    began = time.time()
    page = "".join(f"<h2>H {i}</h2><p>{good if i % 2 else 'Short.'}</p>" for i in range(50_000))
    assert html.extract(page).count("H ") > 49_000 and time.time() - began < 15


def test_whole_pages_against_another_extraction(spark):
    """The table's pages mark their articles: a parser of its own takes the text of these without the inner boilerplate."""
    import duckdb

    pages = dict(duckdb.sql("select page_id, html from '/root/testdata/sf0.01/pages.parquet'").fetchall())
    got = {r.page_id: r.text for r in op5_html(spark, "/root/testdata/sf0.01").collect()}
    assert set(got) == set(pages)
    for page, text in pages.items():
        p = Plain()
        p.feed(text)
        p.close()
        assert "".join(got[page].split()) == "".join("".join(p.out).split()), page


class Plain(HTMLParser):
    """Text inside article or main, outside elements that the contract leaves out."""

    SKIP = ("nav", "header", "footer", "aside", "form", "script", "style", "button", "noscript", "template", "iframe", "select", "textarea", "svg")
    EMPTY = ("br", "hr", "img", "input", "link", "meta", "source", "wbr", "area", "base", "col", "embed", "param", "track")

    def __init__(self):
        super().__init__()
        self.stack, self.out = [], []

    def handle_starttag(self, tag, attrs):
        if tag in self.EMPTY:
            return
        inside = any(k for _, k, _ in self.stack)
        named = f"{dict(attrs).get('class') or ''} {dict(attrs).get('id') or ''}"
        gone = any(g for _, _, g in self.stack) or tag in self.SKIP and not (tag == "header" and inside) or any(w in named for w in ("comment", "related", "share", "newsletter", "cookie", "sidebar", "advert", "promo", "breadcrumb"))
        self.stack.append((tag, tag in ("article", "main") and not gone, gone))

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        if any(k for _, k, _ in self.stack) and not any(g for _, _, g in self.stack):
            self.out.append(data)
