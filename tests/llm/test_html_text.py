"""Main-text extraction: the check pages against an independent parser, and
pages of our own for each part that is stripped."""

import duckdb
import pytest
from html.parser import HTMLParser

from tidemark.llm.html_text import extract_main_text, main_text

LONG = "many words stand here in one long paragraph of the article, "
SF = "/root/testdata/sf0.001"


class ArticleBlocks(HTMLParser):
    """Blocks inside <article>, by the standard library's parser."""

    BLOCK = {"article", "h1", "p", "div", "li", "ul"}

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = 0, [""]
        self.feed(page)
        self.close()
        self.text = "\n\n".join(b for b in (" ".join(x.split()) for x in self.blocks) if b)

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag in self.BLOCK:
            self.blocks.append("")
        if tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if tag in self.BLOCK:
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_check_pages_equal_an_independent_parser(spark):
    got = {r.page_id: (r.url, r.text, r.n_chars)
           for r in extract_main_text(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    rows = duckdb.sql(f"SELECT page_id, url, html FROM '{SF}/pages.parquet'").fetchall()
    want = {p: (u, t := ArticleBlocks(h).text, len(t)) for p, u, h in rows}
    assert got == want and all(t for _, t, _ in want.values())


@pytest.mark.parametrize("junk", [
    '<nav><a href="/">Home</a> and more words than a menu has</nav>', '<div class="main-menu">Menu, of words</div>',
    '<header><p>The site</p></header>', '<div id="page-header">The site</div>', "<footer>(c) us</footer>",
    '<aside><p>' + LONG * 3 + '</p></aside>', '<div class="sidebar left">' + LONG * 3 + '</div>',
    '<div class="cookie-notice"><p>We use cookies.</p></div>', '<p class="notice">Mind the gap.</p>',
    '<div class="ad">Buy <div>this</div> now</div>', '<span class="advert">Buy <span>this</span></span>',
    '<form action="/s"><label>Name</label><input value="x>y"><textarea>t</textarea></form>',
    '<script>var a = "</p><article>" + "<p>";</script>', "<style>p > a {margin: 0}</style>",
    '<!-- <p>not this</p> -->', '<noscript>Turn it on</noscript>', '<div role="navigation">here</div>',
    '<section id="comments"><h2>Comments</h2><article class="comment"><p>' + LONG * 3 + "</p></article></section>",
    '<svg><text>drawn</text></svg>', '<select><option>one<option>two</select>',
])
def test_each_part_is_stripped_inside_and_outside_of_the_article(junk):
    want = "Title\n\n" + (LONG * 2).strip() + "\n\nShort.\n\nThe end."
    body = f"<h1>Title</h1><p>{LONG * 2}</p>{junk}<p>Short.</p><p>The end.</p>"
    for page in (f"<body>{junk}<article>{body}</article>{junk}</body>",
                 f"<body>{junk}<main><div>{body}</div></main>{junk}",
                 f"<body>{junk}<div class='post'>{body}</div>{junk}</body>",
                 f"<article>{body}</article>{junk}"):
        assert main_text(page) == want, page


def test_blocks_white_space_and_references():
    page = ("<article><h1>A&amp;B</h1>\n<p>one\n two&nbsp;three<br>four <b>fi</b>ve &lt;p&gt; a < b"
            "<p>open <i>para<p>graph<ul><li>x<li>y</ul><table><tr><td>c1<td>c2</table>&#8364; &bogus; &amp</article>")
    assert main_text(page) == ("A&B\n\none two three four five <p> a < b\n\nopen para\n\ngraph\n\nx\n\ny\n\n"
                               "c1\n\nc2\n\n€ &bogus; &")


def test_surge_and_dive_without_any_marks():
    links = "<ul>" + '<li><a href="x">a link of many words and more words</a></li>' * 9 + "</ul>"
    page = f"<div>{links}</div><div><h2>Head</h2><p>{LONG * 3}</p><p>Of.</p><p>{LONG}</p><p>End.</p></div><div>{links}</div>"
    assert main_text(page) == "\n\n".join(["Head", (LONG * 3).strip(), "Of.", LONG.strip(), "End."])


def test_pages_without_text_and_odd_markup():
    for page in (None, "", "   ", "<html><head><title>t</title></head><body></body></html>",
                 "<nav>a</nav><footer>b</footer>", "<script>never closed <p>x</p>", "<!-- open <p>x</p>"):
        assert main_text(page) == ""
    assert main_text("just words") == "just words"
    assert main_text("<article><p>tiny</p></article>") == "tiny"
    assert main_text("<nav><ul><li>a<article><p>inside an open menu</p></article><footer>f") == "inside an open menu"
    assert main_text("<p>cut off here <a href='x") == "cut off here"
    long = "<article>" + "<p>word &amp; word</p>" * 50_000 + "</article>"
    assert main_text(long).count("word & word") == 50_000
    assert main_text('<p a="' * 20_000 + "x") in ("", "x")     # linear on broken quotes


def test_table_of_pages(spark):
    rows = [(1, "u", "<p>a</p>", "t", 5), (1, "u", "<p>a</p>", "t", 5), (None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = extract_main_text(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0)], key=str)
    assert extract_main_text(pages.limit(0)).count() == 0
