from html.parser import HTMLParser

import pytest

from tallywood.llm import html_text as H

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{a:b}</style><script>var t="</p>";if(a<b){}</script></head><body class="page">
<header><h1>Site name</h1></header><nav><ul><li><a href="/a">One</a><li><a href='/b>'>Two</a></ul></nav>
<div class="cookie-notice">We use cookies and more words than a menu has, please agree to all of them now.</div>
<article><header><h1>A  heading&nbsp;here</h1></header><p>First &lt;para&gt; with a <a href="x">link</a>&hellip;
 and  more.<p><b>Unclosed<br>second &#233; 3 < 4 paragraph</b>
<div class="ad">Buy a thing now, it is so very good that you will not believe it at all.</div>
<p>Third.</p><form><p>Your mail address so that we may write to you <input name=a></p></form>
<section id="comments"><p>I liked this a lot, thank you so much for writing it down for us.</p></section><p>Last words.</p></article>
<aside><p>Other things to read on this site, with long descriptions of each of them.</p></aside>
<footer>&copy; site</footer><!-- <p>not this</p> --></body></html>"""


def test_article_without_the_rest():
    want = "A heading here\nFirst <para> with a link… and more.\nUnclosed second é 3 < 4 paragraph\nThird.\nLast words."
    assert H.main_text(PAGE, H.trained()) == want


def test_pages_without_an_article_element():
    body = "word " * 60
    page = f"<body><div id=menu><a href=a>Home</a> <a href=b>News</a></div><div><h2>What it is</h2><div>{body}</div><p>Short one.</p><div>{body}</div></div><div class='footer'>All rights reserved</div>"
    assert H.main_text(page, H.trained()) == f"What it is\n{body.strip()}\nShort one.\n{body.strip()}"


def test_tree_learns_its_table():
    x, y = H.labelled()
    assert (H.classify(H.trained(), x) == y.astype(bool)).mean() > 0.95


BODY = " ".join(["word"] * 40)


@pytest.mark.parametrize(
    "page, want",
    [
        (f'<article class="post has-sidebar"><p>{BODY}</p></article>', BODY),
        (f'<main class="entry comments-open"><p>{BODY}</p></main>', BODY),
        ('<article><p class="ad-hoc">One two</p><p>x y <svg/> z</p><p>a <math><mi>q</mi></math></p></article>', "One two\nx y z\na q"),
        ("<article><p>Read on</p><ul><li><a href=a>l1</a><li><a href=b>l2</a></ul><button>Press</button> it</article>", "Read on\nl1\nl2\nPress\nit"),
        ("<body><p>Short note here.</p></body>", "Short note here."),
        ("<nav><a href=x>Home</a></nav><p>Short note here.</p><footer>Made by us</footer>", "Short note here."),
        (f'<div class="site-footer">No</div><div id="pageBody">{BODY}</div><div class="comment-list">me too</div><div class="ad-slot">buy</div>', BODY),
        (f'<div role="navigation">a b</div><div class="article-body"><p>{BODY}</p><div class="related-posts"><p>{BODY}</p></div></div>', BODY),
        (f"<article><p>{BODY}<svg><p>x</article><p>tail", BODY + "\nx"),
        (f'<article><p>{BODY}</p><article class="comment"><p>I agree</p></article></article>', BODY),
        (f"<main><p>{BODY}</p></main><p>{BODY} outside</p>", BODY),
    ],
)
def test_many_templates(page, want):
    assert H.main_text(page, H.trained()) == want


class Walk(HTMLParser):
    """The text of article elements by a plain walk, one line for each block, by another parser."""

    ENDS = frozenset("p h1 h2 h3 li ul ol div article section nav footer header aside blockquote table tr td".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.skip, self.out, self.part = 0, 0, [], []

    def flush(self):
        t = " ".join("".join(self.part).split())
        self.part = []
        if t:
            self.out.append(t)

    def handle_starttag(self, tag, attrs):
        if tag in self.ENDS:
            self.flush()
        if tag == "br":
            self.part.append(" ")
        self.depth += tag == "article"
        self.skip += tag in ("script", "style", "nav", "footer", "aside", "form")

    def handle_endtag(self, tag):
        if tag in self.ENDS:
            self.flush()
        self.depth -= tag == "article"
        self.skip -= tag in ("script", "style", "nav", "footer", "aside", "form")

    def handle_data(self, data):
        if self.depth and not self.skip:
            self.part.append(data)


def test_all_pages_equal_a_plain_walk(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    n = 0
    for r in H.extract(pages.select("page_id", "html")).collect():
        w = Walk()
        w.feed(r.html or "")
        w.flush()
        assert r.text == "\n".join(w.out), r.page_id
        n += 1
    assert n == pages.count()


def test_frames_with_odd_pages(spark):
    rows = [(1, None, "t"), (2, "", "t"), (3, "<<<>< <p", "t"), (4, "<article><p>" + "a<b " * 40_000, "t"), (4, "<p", None), (5, "<article>x" + "<div>" * 20_000 + "y", None), (6, "<script>", "t"), (7, PAGE, "t")]
    df = spark.createDataFrame(rows, "page_id long, html string, TEXT string")
    got = H.extract(df)
    assert got.columns == ["page_id", "html", "text"]
    out = got.collect()
    assert len(out) == 8 and all(r.text is not None for r in out)
    assert [r.text for r in out if r.page_id in (1, 2, 6)] == ["", "", ""]
    assert H.extract(df.limit(0)).count() == 0
