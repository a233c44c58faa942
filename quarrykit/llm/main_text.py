"""Main text of web pages by the distribution of text over their lines.

A page becomes lines, one a block of text, after scripts, styles, comments and markup are stripped. Elements that say what they are
(menus, headers, footers, sidebars, notices, adverts, forms, readers' comments: by tag, role, class or id) leave empty lines. Text lengths
are summed over sliding windows of WINDOW lines. A run of lines starts at a surge, where a window's sum rises from nothing, and
ends at a dive, where a whole window is empty again; of the runs those with the highest windows are the main text, and all lines between their two
points are kept, however short. Where a page marks an article, the lines in it form the runs by themselves, and short lines at
its ends stay.

How it works at scale: each page by itself, in one Arrow map without a shuffle; time and memory grow with the page's length.

Defined cases: a null or empty page, or one without text, gives an empty text; tags that are left open end where the page does, or where an
element around them does; `<` that starts no tag is text; markup cut off at the end of the page is dropped; an article within an
element that is left open still counts, if nothing else is found; pages of any length are read whole; equal runs are all kept; repeated rows and
null ids each give a row; an empty table gives no rows; other columns, whatever their names, aren't read. White space is
what Unicode calls so, no-break spaces included. `<br>` is white space, two in a row end a block.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.llm.common import bounded_batches, trimmed

#: Lines of a window, and the share of the highest window that a run's own highest must reach to be main text.
WINDOW, RUN_SHARE = 3, 0.3
#: The share of a line's characters in links from which it counts as empty outside an article.
LINK_SHARE = 0.5

# HTML's elements by what they mean for text.
_RAW = ("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = frozenset("head nav aside form footer dialog menu noscript template svg canvas object audio video map button select datalist".split())
_BLOCKS = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 header ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption address center details summary fieldset legend hgroup hr"
    " nav aside form footer dialog menu".split()
)
_CLOSES_P = _BLOCKS - {"html", "body"}
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
# What authors call parts of a page that aren't its article: words of class and id.
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promoted promotion banner menu menus nav navbar navigation breadcrumb breadcrumbs toc pagination pager topbar"
    " masthead header footer foot sidebar aside rail widget widgets notice notices notification notifications cookie cookies consent gdpr disclaimer alert popup modal overlay newsletter subscribe subscription signup login"
    " comment comments commentary disqus reply replies respond share sharing social related recommended recommendations form search toolbar skip copyright legal".split()
)
_ARTICLE_NAMES = frozenset("articlebody article-body article-content entry-content post-content post-body story-body main-content".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?P<end>>|\Z)",
    re.DOTALL,
)
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE) for tag in _RAW}
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|style|itemprop|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?(?=[\s/>\"']|\Z)", re.IGNORECASE)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


@dataclass
class _Open:
    tag: str
    dropped: bool
    article: int


@dataclass
class Line:
    """A line of a page. article: the number of the article it is in, or 0; weight: its characters, or 0 where it is no text of the page's own."""

    text: str
    article: int
    weight: int


@dataclass
class _Reader:
    kept_forms: bool = False  # second try: forms, headers and open elements don't drop an article
    lines: list[Line] = field(default_factory=list)
    stack: list[_Open] = field(default_factory=list)
    opened: Counter = field(default_factory=Counter)  # tags in the stack, so that a stray end tag costs no walk
    articles: int = 0
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    link: bool = False
    breaks: int = 0

    def text(self, piece: str) -> None:
        if piece.strip():
            self.breaks = 0
        self.parts.append(piece)
        if self.link:
            self.linked += len(piece.strip())

    def end_block(self) -> None:
        if not self.parts:
            return
        text = " ".join(html.unescape("".join(self.parts)).split())
        if text:
            top = self.stack[-1] if self.stack else _Open("", False, 0)
            if top.dropped:
                self.gap()
            else:
                links = not top.article and self.linked >= LINK_SHARE * len(text)
                self.lines.append(Line(text, top.article, 0 if links else len(text)))
        self.parts, self.linked = [], 0

    def gap(self) -> None:
        """Empty lines, enough that no window reaches over them."""
        if self.lines and self.lines[-1].text:
            self.lines.extend(Line("", 0, 0) for _ in range(WINDOW))

    def open(self, tag: str, attrs: str) -> None:
        if tag == "br":
            self.breaks += 1
            self.parts.append(" ")
            if self.breaks > 1:
                self.end_block()
            return
        if tag in _BLOCKS:
            self.end_block()
            if tag in _CLOSES_P:
                self.close_implied("p", ("article", "main", "section", "div", "td", "th", "li", "blockquote", "aside", "nav", "header", "footer", "form", "body"))
        if tag == "li":
            self.close_implied("li", ("ul", "ol", "menu"))
        if tag == "a":
            self.link = True
        if tag in _VOID or attrs.endswith("/") and tag not in _BLOCKS:
            return
        above = self.stack[-1] if self.stack else _Open("", False, 0)
        dropped, article = self.judged(tag, attrs, above)
        if dropped and not above.dropped:
            self.end_block()
            self.gap()
        self.stack.append(_Open(tag, dropped, article))
        self.opened[tag] += 1

    def cut(self, k: int) -> None:
        """Closes the elements from the k-th on."""
        for entry in self.stack[k:]:
            self.opened[entry.tag] -= 1
        del self.stack[k:]

    def judged(self, tag: str, attrs: str, above: _Open) -> tuple[bool, int]:
        """(whether the element isn't main text, the number of its article)."""
        names, raw, role, hidden, body = set(), set(), "", False, False
        for match in _ATTRIBUTE.finditer(attrs) if attrs else ():
            name, value = match[1].lower(), (match[2] or "").strip("\"'")
            if name in ("class", "id"):
                raw |= {v.lower() for v in value.split()}
                names |= {w.lower() for w in _WORDS.findall(value)}
            elif name == "role":
                role = value.lower()
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value):
                hidden = True
            elif name == "itemprop" and value.lower() == "articlebody":
                body = True
        marks = tag in ("article", "main") or role in ("main", "article") or body or bool(raw & _ARTICLE_NAMES)
        named = tag not in ("html", "body", "main") and bool(names & _NAMES) and not raw & _ARTICLE_NAMES
        if above.article and names & {"header"} and not names & (_NAMES - {"header"}):
            named = False  # an article's own header bears its title
        unmarked = tag in _DROPPED or role in _ROLES or tag == "header" and not above.article
        if self.kept_forms and marks and not named:
            self.articles += 1
            return False, self.articles
        dropped = above.dropped or hidden or named or unmarked and not marks
        if marks and not dropped and not above.article:
            self.articles += 1
            return False, self.articles
        return dropped, above.article

    def close_implied(self, tag: str, within: tuple[str, ...]) -> None:
        """Closes an element that a new one ends without an end tag."""
        if not self.opened[tag]:
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].tag == tag:
                self.cut(k)
                return
            if self.stack[k].tag in within:
                return

    def close(self, tag: str) -> None:
        if tag == "a":
            self.link = False
        for k in range(len(self.stack) - 1, -1, -1) if self.opened[tag] else ():
            if self.stack[k].tag == tag:
                if tag in _BLOCKS or any(entry.dropped != (self.stack[k - 1].dropped if k else False) for entry in self.stack[k:]):
                    self.end_block()
                dropped = self.stack[k].dropped
                self.cut(k)
                if dropped and not (self.stack and self.stack[-1].dropped):
                    self.gap()
                return
            if self.stack[k].tag in ("article", "main", "body") and tag not in ("body", "html", "main", "article"):
                break  # a stray end tag doesn't reach out of an article
        if tag in _BLOCKS:
            self.end_block()

    def read(self, page: str) -> list[Line]:
        at, size = 0, len(page)
        while at < size:
            start = page.find("<", at)
            if start < 0:
                self.text(page[at:])
                break
            match = _TOKEN.match(page, start)
            if match is None:
                self.text(page[at : start + 1])
                at = start + 1
                continue
            if start > at:
                self.text(page[at:start])
            at = match.end()
            tag = match["tag"]
            if tag is None or not match["end"]:
                continue
            tag = tag.lower()
            if match["close"]:
                self.close(tag)
            elif tag in _RAW_END:
                end = _RAW_END[tag].search(page, at)
                at = end.end() if end else size
            else:
                self.open(tag, match["attrs"])
        self.end_block()
        return self.lines


def lines_of(page: str) -> list[Line]:
    """A page's lines; those of an element that isn't its text are empty."""
    lines = _Reader().read(page)
    if not any(line.text for line in lines):
        lines = _Reader(kept_forms=True).read(page)
    return lines


def runs(weights: list[int], window: int = WINDOW) -> list[tuple[int, int, int]]:
    """(surge, dive, highest window) of the runs of lines: from the first line of weight to the last one before an empty window."""
    found, total, begin, last, highest = [], 0, -1, -1, 0
    for at, weight in enumerate(weights):
        total += weight - (weights[at - window] if at >= window else 0)
        if weight:
            if begin < 0:
                begin, highest = at, 0
            last = at
        if begin >= 0:
            highest = max(highest, total)
            if not total:
                found.append((begin, last + 1, highest))
                begin = -1
    if begin >= 0:
        found.append((begin, last + 1, highest))
    return found


def main_text(page: str | None) -> str:
    """The main text of a page, its blocks joined by line ends."""
    lines = lines_of(page or "")
    articles: dict[int, int] = {}
    for line in lines:
        if line.article:
            articles[line.article] = articles.get(line.article, 0) + line.weight
    if articles:
        # Of several articles those of a size with the largest; an article stays whole.
        least = RUN_SHARE * max(articles.values())
        kept = [line.text for line in lines if line.article and line.text and articles[line.article] >= least]
    else:
        weights = [line.weight for line in lines]
        found = runs(weights if any(weights) else [len(line.text) for line in lines])
        least = RUN_SHARE * max((highest for _, _, highest in found), default=0)
        kept = [line.text for begin, end, highest in found if highest >= least for line in lines[begin:end] if line.text]
    return "\n".join(kept)


def _extract(batches) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        texts = [main_text(page) for page in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    bounded_batches(pages.sparkSession)
    columns = [F.col("page_id"), F.col("url"), F.col("html")]
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select(*columns).mapInArrow(trimmed(_extract), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


#: The same for pages that mark their article and bear no other element in it than headings, paragraphs, bold type and line breaks.
ORACLE = r"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*)', 1, 's'), '</article>.*', '', 's') AS body FROM pages),
b AS (SELECT page_id, url, list_transform(regexp_split_to_array(body, '</?(p|h1)>'), lambda x: replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>')) AS parts FROM a),
c AS (SELECT page_id, url, list_filter(list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(x, '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') AS parts FROM b)
SELECT page_id, url, array_to_string(parts, chr(10)) AS text, CAST(length(array_to_string(parts, chr(10))) AS BIGINT) AS n_chars FROM c
"""
