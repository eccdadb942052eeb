"""Main text of pages: hand-made pages, and the given pages against their markup by a plain pattern."""

import html
import re
import time

from pyspark.sql import types as T

from firmscope.llm import catalog, html_text
from tests.conftest import SF_ORACLE

PROSE = (
    "The committee met on the first of May and it was decided that all of the members would be asked for their views on the plan, "
    "which had been sent to them by the office in the week before. It is not known when the next meeting will be held."
)
MENU = '<ul class="x"><li><a href="/a">Home</a></li><li><a href="/b">News of the day</a></li></ul>'


def text(page):
    return html_text.main_text(page)


def test_unmarked_page_is_classified_by_its_blocks():
    page = f"<body><div>{MENU}</div><h1>Title</h1><p>{PROSE}</p><p>Short one.</p><p>{PROSE} More.</p><div>© 2024 Example Ltd. All rights reserved.</div></body>"
    assert text(page) == f"Title\n\n{PROSE}\n\nShort one.\n\n{PROSE} More."


def test_long_blocks_without_stop_words_are_boilerplate_outside_an_article():
    junk = "Login Register Products Prices Contact Imprint Careers Downloads Support Partners Newsletter " * 4
    assert text(f"<p>{PROSE}</p><p>{junk}</p><p>{PROSE}</p>") == f"{PROSE}\n\n{PROSE}"
    # In a marked article they are ambiguous and inherit.
    assert junk.strip() in text(f"<article><p>{PROSE}</p><p>{junk}</p></article>")


def test_marked_parts_go():
    page = (
        f"<header><p>{PROSE}</p></header><nav>{MENU}</nav><div class='cookie-notice'>{PROSE}</div>"
        f"<article><header><h1>Own title</h1></header><p>{PROSE}</p><aside>{PROSE}</aside><p>Be <b>bold</b>.<span class=ad>Buy!</span></p>"
        f"<form><label>Name</label><input name=n><button>Send</button></form><script>var x = '<p>no</p>';</script><!-- <p>no</p> -->"
        f"<section id=comments><article class=comment><p>{PROSE}</p></article></section></article>"
        f"<div role='complementary'>{PROSE}</div><p>{PROSE}</p><footer>{PROSE}</footer>"
    )
    assert text(page) == f"Own title\n\n{PROSE}\n\nBe bold."


def test_a_form_around_the_page_is_no_form_of_the_article():
    assert text(f"<form id=frame><div>{PROSE}</div><main><p>{PROSE}</p></main></form>") == PROSE


def test_references_white_space_and_lines():
    assert text("<article><p>a&amp;b&nbsp; &lt;i&gt;\n\t c&#233;<br>d</p><p>x &amp;amp; y</p></article>") == "a&b <i> cé d\n\nx &amp; y"


def test_names_of_classes():
    for name in ("ad", "top-ad", "adBanner", "site-footer", "page-footer", "article-comments", "mainNav", "text-ad"):
        assert html_text._named_boilerplate(name, False), name
    for name in ("article-body", "page-with-sidebar", "no-sidebar", "post", "header-free content", "badge", "shadow"):
        assert not html_text._named_boilerplate(name, True), name


def test_damaged_pages():
    assert text(None) == "" and text("") == "" and text("<") == "<" and text("   ") == ""
    assert text("plain text") == "plain text"
    assert text("<article><p>one<p>two<div>three") == "one\n\ntwo\n\nthree"
    assert text('<article><p title="a > b">kept</p><a href="x>lost quote</a></article>').startswith("kept")
    assert text("<article>a<!-- never closed") == "a"
    assert text("<article>a<svg>b</article>") == "a\n\nb" or text("<article>a<svg>b</article>") == "ab"
    assert text("<p>1 < 2 and 3 > 2</p>") == "1 < 2 and 3 > 2"
    assert text("</p></div></article>x") == "x"


def test_long_pages_take_linear_time():
    for piece in ('<a href="', "<!--", "<div>", "</span>", "<svg>", "<span class=ad>", "<", "&", "<b x='"):
        began = time.process_time()
        text(piece * 200_000)
        assert time.process_time() - began < 20, piece


def plain(page):
    """What stands in the article of a given page."""
    article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = (re.sub(r"<[^>]*>", " ", b) for b in re.split(r"</?(?:p|h1)>", article))
    return "\n\n".join(t for b in parts if (t := " ".join(html.unescape(b).split())))


def test_query_returns_the_articles_of_all_pages(spark):
    pages = spark.read.parquet(f"{SF_ORACLE}/pages.parquet").collect()
    got = {r.page_id: r for r in catalog.queries()["op11_html"](spark, SF_ORACLE).collect()}
    assert len(got) == len(pages)
    for p in pages:
        r = got[p.page_id]
        assert (r.url, r.text) == (p.url, plain(p.html)) and r.n_chars == len(r.text)


def test_nulls_repeats_clashing_columns_and_empty_tables(spark):
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("page_id", "html", "url", "text", "n_chars")])
    rows = [("a", None, None, "x", "y"), ("a", "", "u", None, None), (None, "<article>t", "u", "x", "y"), (None, "<article>t", "u", "x", "y")]
    got = html_text.extract(spark.createDataFrame(rows, schema))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(
        map(str, [("a", None, "", 0), ("a", "u", "", 0), (None, "u", "t", 1), (None, "u", "t", 1)])
    )
    assert html_text.extract(spark.createDataFrame([], schema)).count() == 0
