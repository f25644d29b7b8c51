"""Main text of web pages by line-block distribution.

Markup is stripped into lines (one for each block of text). A line weighs its length, less its link text outside articles;
element names and class words only make that more or less: much less in boilerplate elements, less outside the article of a
page that marks one, more inside it. Window sums over a few lines of one kind show where text surges and where it dives to
nothing; the lines between are kept, and so boilerplate and stray lines go because they never surge.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from nearfield.llm._common import append_columns, read

#: Lines in a window: gaps of fewer weightless lines don't end the text.
WINDOW = 4
#: A window that weighs more than this is a surge; on pages with less text, one that weighs more than half of the heaviest.
SURGE = 60
#: What a character weighs in a boilerplate element, and outside the article of a page that has one.
BOILERPLATE_WEIGHT, OUTSIDE_WEIGHT = 0.02, 0.03
#: Kinds of lines; each has its own distribution.
BOILER, OUTSIDE, ARTICLE = range(3)

# Element names of HTML, by what they mean for text.
RAW = frozenset("script style template noscript iframe textarea select svg math canvas object audio video head title xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
BOILERPLATE = frozenset("nav footer aside form button dialog menu fieldset".split())
# Words in class, id and role that mark what isn't article text.
MARKS = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner nav navbar navigation
    navigational menu menus sidebar sidebars aside footer foot contentinfo complementary masthead breadcrumb breadcrumbs comment comments
    commentlist disqus respond reply replies cookie cookies consent gdpr notice notices notification notifications alert popup modal
    overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget widgets
    toolbar pagination pager search searchbox skip copyright legal disclaimer outbrain taboola dialog""".split()
)

#: Open elements that a block ends; other blocks end an open paragraph.
ENDED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}
#: Of these, what marks an article element itself: its other class words may tell what it is about.
ARTICLE_MARKS = frozenset("comment comments reply replies related ad ads advert advertisement".split())

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^'">]|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_WORD = re.compile(r"[a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _marked(attributes: str, in_article: bool, marks: frozenset[str] = MARKS) -> bool:
    """Whether attributes say that an element is boilerplate or hidden."""
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "").lower()
        name = name.lower()
        if name in ("class", "id", "role", "itemprop", "aria-label") and (words := _WORD.findall(value)):
            if marks.intersection(words) or marks is MARKS and not in_article and "header" in words:
                return True
        elif name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
            return True
    return re.search(r"(?:^|\s)hidden(?:\s|$)", attributes) is not None if "hidden" in attributes else False


def lines_of(html: str) -> tuple[list[tuple[str, float, int]], bool]:
    """(text, weight, kind) of each block; whether the page has an article. Takes time in proportion to the page."""
    found: list[tuple[str, int, int]] = []  # text, link-free characters, kind
    stack: list[tuple[str, bool]] = []  # open elements; whether each is boilerplate
    blocks: list[int] = []  # places in the stack of those that aren't inline
    opened: dict[str, int] = {}
    endless: set[str] = set()  # raw elements whose end tag doesn't come any more
    boiler = articles = links = 0
    has_article = False
    parts: list[str] = []
    linked = 0
    at, n = 0, len(html)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                kind = BOILER if boiler else ARTICLE if articles else OUTSIDE
                found.append((text, len(text) if kind == ARTICLE else max(0, len(text) - linked), kind))
            parts.clear()
        linked = 0

    def close(upto: int) -> None:
        nonlocal boiler, articles, links
        while len(stack) > upto:
            name, bad = stack.pop()
            opened[name] -= 1
            if blocks and blocks[-1] == len(stack):
                blocks.pop()
            boiler -= bad
            articles -= name in ("article", "main")
            links -= name == "a"

    def say(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if links:
            linked += len(" ".join(unescape(text).split()))

    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            say(html[at:])
            break
        if m.start() > at:
            say(html[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                say(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        ending, attributes = m[1] or m[4], m[3] if m[3] is not None else m[6] or ""
        if name not in INLINE:
            flush()
        if ending:
            if opened.get(name):
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                close(k)
            continue
        if name in RAW:
            end = None if name in endless else re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
            if end is None:
                endless.add(name)
            at = end.end() if end else (n if name not in ("head", "svg", "math", "select", "object") else at)
            continue
        if name in VOID or attributes.endswith("/") and name not in ("p", "div", "span", "a", "li"):
            continue
        if name not in INLINE:
            # an open paragraph, item or cell ends where the next block begins
            group = ENDED_BY.get(name, ("p",))
            for k in reversed(blocks):
                if stack[k][0] in group:
                    close(k)
                    break
                if stack[k][0] != "p":
                    break
            blocks.append(len(stack))
        bad = name in BOILERPLATE or name == "header" and not articles or bool(attributes) and name not in ("html", "body") and _marked(attributes, articles > 0, ARTICLE_MARKS if name in ("article", "main") else MARKS)
        if name in ("article", "main") and not bad and not boiler:
            has_article = True
        stack.append((name, bad))
        opened[name] = opened.get(name, 0) + 1
        boiler += bad
        articles += name in ("article", "main")
        links += name == "a"
    flush()
    each = (BOILERPLATE_WEIGHT, OUTSIDE_WEIGHT if has_article else 1.0, 1.0)
    return [(text, each[kind] * chars + SURGE * (kind == ARTICLE), kind) for text, chars, kind in found], has_article


def window_sums(weights: list[float]) -> list[float]:
    """The sum of each line's weight and those of the WINDOW - 1 lines after it."""
    return [sum(weights[i : i + WINDOW]) for i in range(len(weights))]


def between_surge_and_dive(weights: list[float], surge: float) -> list[int]:
    """Lines with a weight from where a window surges on to where the windows have dived to nothing."""
    out: list[int] = []
    inside = False
    for i, (w, s) in enumerate(zip(weights, window_sums(weights), strict=True)):
        inside = s > 0 if inside else w > 0 and s > surge
        if inside and w > 0:
            out.append(i)
    return out


def main_text(html: str | None) -> str:
    """The text between surges and dives of the line-block distribution, blocks joined by a space; empty if there is none."""
    if not html:
        return ""
    lines, _ = lines_of(html)
    each = [[w if k == kind else 0.0 for _, w, k in lines] for kind in (BOILER, OUTSIDE, ARTICLE)]
    most = max(max(window_sums(each[kind]), default=0.0) for kind in (OUTSIDE, ARTICLE))
    kept: list[int] = []
    for kind, weights in enumerate(each):
        kept += between_surge_and_dive(weights, SURGE if kind == BOILER else min(SURGE, most / 2))
    return " ".join(lines[i][0] for i in sorted(kept))


def extract(df: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """``keep`` columns with the main text of each whole page and its code points; empty for null, empty and textless pages."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = [main_text(h) for h in batch.column(html).cast(pa.string()).to_pylist()]
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    return append_columns(df, keep, run, [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], [html])


def op5_html_text(spark, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page. Null ids and urls pass through; equal rows give equal rows; no rows give none."""
    return extract(read(spark, sf_dir, "pages"), ["page_id", "url"])
