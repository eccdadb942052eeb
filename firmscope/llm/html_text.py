"""Main text of web pages by two-pass block rules.

A page is read once into blocks: the text between two block-level tags, with white
space folded, character references decoded and scripts, styles and comments left out.

First pass, each block by itself: blocks in menus, headers, footers, sidebars, forms,
notices, adverts or reader comments (by tag, role or class name) are boilerplate; so
are blocks outside the article where the page marks one (``article``, else ``main``),
and blocks that mostly are links.  Of the others, long blocks with many stop words
are main text, and outside a marked article long ones with few are boilerplate.  What
is short, or between the thresholds, stays ambiguous.

Second pass: an ambiguous block inherits the label of its nearest decided neighbour
in the same region (inside or outside the marked article); a heading that of the
next decided block; between a good and a bad one at the same distance it is good.
Without a decided neighbour it is main text, and so is what stands before the first
or after the last decided block of a marked article.

Stop words are counted in the language whose list the page matches most; where no
list reaches ``SOME`` of the words (another language, or no prose) the stop-word rule
is left out and length and link density decide.

Defined cases: a null or empty page has an empty text; a page without markup is one
block; unclosed tags, comments, scripts and quotes end where the page ends; very long
pages are read whole in linear time; repeated rows give a row each; null urls stay
null; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from firmscope.llm.common import workers

LINKS = 0.5  # share of a block's characters in links from which it is a menu
SHORT = 70  # characters below which a block says nothing by itself
LONG = 200  # characters from which a block outside a marked article can be good by itself
MANY, SOME = 0.22, 0.10  # shares of stop words

# Frequent words of four languages.
STOP_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he i this are or his from at which but have an had they you were their one all we can her has there been if more when will would who so no",
    "fr": "le la les de des du un une et à en est que qui dans pour pas sur au aux ce cette il elle ils par plus avec ne se son sa ses ou mais sont nous vous on comme été leur",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an er so dass wird sie nach bei aus um am sind noch wie einer über war hat nur",
    "es": "el la los las de del que y en un una a por con no es se para al lo como más su sus pero le ha o este sí porque esta entre cuando muy sin sobre también me hasta fue son",
}

# Kinds of elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style template noscript textarea title".split())
LEFT_OUT = RAW | set("iframe object svg canvas audio video select".split())
BOILERPLATE_TAGS = set("nav footer aside button menu dialog head".split())
BLOCK_TAGS = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre "
    "search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that end when one of the same kind begins.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOILERPLATE_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
# Words of class names and ids.
BOILERPLATE_NAMES = set(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie cookies disclaimer footer gdpr header "
    "login masthead menu modal nav navbar navigation newsletter notice notices notification pagination paywall popup promo promoted promotion "
    "related share sharing sidebar signup social sponsor sponsored subscribe subscription teaser toolbar widget".split()
)
COMMENT_NAMES = set("comment comments commentlist disqus replies respond".split())
HEADER_NAMES = {"header", "masthead", "banner"}
CONTENT_NAMES = set("article content entry main post story text body page wrapper container layout".split())

NEXT = re.compile(r"<(?=[A-Za-z/!?])")
NAME = re.compile(r"/?([A-Za-z][^\s/>]*)")
# A quote opens a value only after '='; possessive, so each character is looked at once.
ATTRIBUTES = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])))*+""")
VALUE = re.compile(r"""(?:^|\s)(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
WORD = re.compile(r"[^\W\d_]+")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")

STOP = {lang: frozenset(words.split()) for lang, words in STOP_WORDS.items()}


@dataclass(slots=True)
class Block:
    text: str
    link_chars: int
    heading: bool
    boilerplate: bool  # by tag, role or name
    region: int  # 2 in an article, 1 in the main element, 0 elsewhere
    good: bool | None = None


@dataclass(slots=True)
class _Open:
    tag: str
    boilerplate: bool
    region: int
    form: bool = False  # a form around a marked article is the page's frame


def _named_boilerplate(value: str, inside: bool) -> bool:
    """Whether a class list or id says so; ``page-with-sidebar`` does not, and an article's own header is the article's."""
    for name in value.split():
        parts = [p.lower() for p in NAME_PART.findall(name)]
        if COMMENT_NAMES.intersection(parts):
            return True
        said = BOILERPLATE_NAMES.intersection(parts) - (HEADER_NAMES if inside else set())
        if said and not {"has", "with", "no"}.intersection(parts) and (parts[-1] in said or not CONTENT_NAMES.intersection(parts)):
            return True
    return False


def _opened(tag: str, attributes: str, parent: _Open) -> _Open:
    boilerplate, region, form = parent.boilerplate, parent.region, parent.form or tag == "form"
    if tag in BOILERPLATE_TAGS or tag == "header" and region < 2:
        boilerplate = True
    elif tag == "article":
        region, form = 2, False
    elif tag == "main":
        region, form = max(region, 1), False
    if attributes:
        for m in VALUE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "itemprop":
                region = 2 if value.lower() == "articlebody" else region
            elif name == "role":
                role = value.strip().lower()
                region = max(region, {"article": 2, "main": 1}.get(role, 0))
                boilerplate |= role in BOILERPLATE_ROLES
            elif tag not in ("html", "body", "main") and tag not in HEADINGS and _named_boilerplate(value, region == 2):
                boilerplate = True
    return _Open(tag, boilerplate, region, form)


def blocks(page: str) -> list[Block]:
    """The blocks of a page in page order, not classified yet."""
    out: list[Block] = []
    stack = [_Open("", False, 0)]
    depth: Counter[str] = Counter()
    parts: list[str] = []
    links: list[str] = []
    paragraph: _Open | None = None  # an open p: it ends with the block
    link, heading, breaks = False, False, 0
    endless: set[str] = set()  # elements that have no end tag from here on

    def flush() -> None:
        nonlocal paragraph, breaks
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                here = paragraph or stack[-1]
                linked = sum(len(" ".join(x.split())) for x in links)
                out.append(Block(text, linked, heading, here.boilerplate or here.form, here.region))
            parts.clear()
            links.clear()
        paragraph, breaks = None, 0

    def close(tag: str) -> None:
        if depth[tag]:
            while True:
                top = stack.pop()
                depth[top.tag] -= 1
                if top.tag == tag:
                    break

    def say(text: str) -> None:
        nonlocal breaks
        if text and not (stack[-1].boilerplate and stack[-1].tag not in BLOCK_TAGS):
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if link:
                links.append(text)
            if breaks and not text.isspace():
                breaks = 0

    at, end = 0, len(page)
    while at < end:
        found = NEXT.search(page, at)
        if not found:
            say(page[at:])
            break
        say(page[at : found.start()])
        at = found.end()
        if page.startswith("!--", at):
            stop = page.find("-->", at + 1)
            at = stop + 3 if stop >= 0 else end
            continue
        if page[at] in "!?":
            stop = page.find(">", at)
            at = stop + 1 if stop >= 0 else end
            continue
        name = NAME.match(page, at)
        if not name:  # "</" before something else
            stop = page.find(">", at)
            at = stop + 1 if stop >= 0 else end
            continue
        tag, closing = name[1].lower(), page[at] == "/"
        inner = ATTRIBUTES.match(page, name.end())
        attributes, stop = inner[0], inner.end()
        if stop < end and page[stop] != ">":  # a quote that is never closed
            stop = page.find(">", stop)
            stop = end if stop < 0 else stop
        at = stop + 1
        if tag in LEFT_OUT:
            if not closing and tag not in endless and not attributes.endswith("/"):
                if finish := re.compile(rf"</{tag}(?![^\s/>])[^>]*>", re.I).search(page, at):
                    at = finish.end()
                else:
                    endless.add(tag)
                    at = end if tag in RAW else at
            continue
        if tag == "br":
            parts.append(" ")
            breaks += 1
            if breaks == 2:  # an empty line ends a block, the element stays open
                kept = paragraph
                flush()
                paragraph = kept
            continue
        if tag == "a":
            link = not closing
        if tag not in BLOCK_TAGS:
            if closing:
                close(tag)
            elif tag not in VOID and (attributes or depth[tag]):
                parent = paragraph or stack[-1]
                opened = _opened(tag, attributes, parent)
                if depth[tag] or opened.boilerplate and not parent.boilerplate:  # a marked piece inside a line
                    stack.append(opened)
                    depth[tag] += 1
            continue
        flush()
        heading = False
        if closing:
            close(tag)
            link = False
            while tag == "p" and stack[-1].tag and stack[-1].tag not in BLOCK_TAGS:
                depth[stack.pop().tag] -= 1
            continue
        if tag == "p":
            paragraph = _opened(tag, attributes, stack[-1])
        elif tag != "hr":
            if stack[-1].tag in SIBLINGS.get(tag, ()):
                depth[stack.pop().tag] -= 1
                if tag == "tr" and stack[-1].tag == "tr":
                    depth[stack.pop().tag] -= 1
            stack.append(_opened(tag, attributes, stack[-1]))
            depth[tag] += 1
            heading = tag in HEADINGS
    flush()
    return out


def first_pass(found: list[Block]) -> None:
    """Label the blocks that say enough by themselves."""
    words = [WORD.findall(b.text.lower()) for b in found]
    counts = {lang: [sum(map(stop.__contains__, w)) for w in words] for lang, stop in STOP.items()}
    best = max(counts, key=lambda lang: sum(counts[lang]))
    prose = sum(counts[best]) >= SOME * max(1, sum(map(len, words)))
    article = max((b.region for b in found if not b.boilerplate), default=0)
    for b, w, stops in zip(found, words, counts[best]):
        size, inside = len(b.text), article > 0
        if b.boilerplate or b.region < article or b.link_chars > LINKS * size:
            b.good = False
        elif not inside and ("©" in b.text and size < LONG or b.link_chars and size < SHORT):
            b.good = False
        elif size >= SHORT:
            share = stops / len(w) if w else 0.0
            if not prose:
                b.good = True if inside or size >= LONG else None
            elif share >= MANY and (inside or size >= LONG):
                b.good = True
            elif share < SOME and not inside:
                b.good = False


def second_pass(found: list[Block]) -> None:
    """Ambiguous blocks inherit from their nearest decided neighbours.  Blocks that markup decides are no neighbours of a marked article's."""
    article = max((b.region for b in found if not b.boilerplate), default=0)
    region = [b for b in found if not b.boilerplate and b.region >= article]
    n = len(region)
    before: list[tuple[int, bool] | None] = [None] * n
    after: list[tuple[int, bool] | None] = [None] * n
    for near, order in ((before, range(n)), (after, range(n - 1, -1, -1))):
        last = None
        for k in order:
            near[k] = last
            if region[k].good is not None:
                last = (k, region[k].good)
    for k, (b, left, right) in enumerate(zip(region, before, after)):
        if b.good is not None:
            continue
        if b.heading and right:
            b.good = right[1]
        elif left and right:
            gap = (k - left[0]) - (right[0] - k)
            b.good = left[1] if gap < 0 else right[1] if gap > 0 else left[1] or right[1]
        else:  # a marked article vouches for what stands at its ends
            b.good = article > 0 or (left or right or (0, True))[1]


def main_text(page: str | None) -> str:
    """The main text's blocks, joined by empty lines."""
    found = blocks(page or "")
    first_pass(found)
    second_pass(found)
    return "\n\n".join(b.text for b in found if b.good)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: page_id, url, text (empty if the page has none), n_chars (code points)."""
    workers(df.sparkSession)
    kinds = [df.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):  # pages may be very long
                some = batch.slice(at, 100)
                texts = [main_text(x) for x in some.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return df.select(df[id_col], df[url_col], df[html_col]).mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
