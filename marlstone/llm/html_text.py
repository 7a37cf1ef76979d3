"""Main text of HTML pages.

The standard library's parser streams events; block boundaries cut them into
*lines*, each with its text, its tags and its text inside links. The ratio of
unlinked text to tags of each line is smoothed by a Gaussian kernel, and lines
at or above a threshold between the page's mean and deviation form the content
clusters. A cluster selects the region it lies in: the outermost article or main
element around it, or where there is none the smallest container that has all
clusters. A selected region gives all its lines, so short paragraphs stay; what is
by name or role a menu, header, footer, sidebar, notice, advert, form, script,
style or comment section gives none. If no line of an article or main element
reaches the threshold, these elements are the region.

The class or id of a wrapper may name what is beside the content ('layout
sidebar-right'). A main element is kept, so named itself or inside a div or section. An
article there counts where no article or main element is kept and it has more
unlinked text than all that is kept; an article in what is named for
comments or related pages counts only where nothing else has text.
Inside an article or main the last word of a name counts (copyright-law is no copyright), quotes are kept whatever their name, and
some names (discussion, notice) are believed only of elements without a heading, with little text or with many links. Tables, lists and
their items that hold an article are wrappers as well.
Names like with-, has-, no-sidebar or share-enabled say nothing of a container. On pages
without a kept article or main element, a div or section that holds more than three quarters of
the text is a wrapper too, whatever its name. Names of elements within a line, such
as links, take words away only if the line has no others.

Defined cases: a null or empty html has the text ''. Character references are
decoded; white space in a block becomes one blank; a line break is white space;
blocks are joined by an empty line. Unclosed elements end with their parent; ``<![`` other than CDATA is a comment; a page that ends inside a tag loses it;
a header inside an article is part of it; an article inside a form is kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

SIGMA, RADIUS, WRAPPER_SHARE = 1.0, 3, 0.75

# Element and class names.
SKIPPED = frozenset("head script style noscript template nav footer aside form button select textarea option iframe object svg math canvas audio video dialog menu map datalist".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that are kept on the stack: they hold blocks, or text that is no content.
HOLDERS = SKIPPED | frozenset("article main section div header body table td ul ol dl figure blockquote details center fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without an end tag of their own end where one of these begins.
ENDED_BY = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner sidebar sidebars rail menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager footer footers masthead topbar toolbar "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist disqus reply replies respond responses discussion "
    "widget widgets skip search searchbox copyright disclaimer".split()
)
#: Names of what holds articles that are not the page's.
OTHERS = frozenset("related recommended recommendations comment comments commentlist disqus reply replies respond responses discussion".split())
#: Within an article: names that say nothing of a section with a heading and long unlinked text, and elements whose names say nothing at all.
DOUBTFUL = frozenset("discussion search notice notices menu copyright banner related".split())
QUOTES = frozenset("blockquote figure figcaption pre".split())
#: Within an article, a name is told by its last word but these.
PARTS = frozenset(
    "left right top bottom upper lower main inner outer side wrapper wrap container box section area list block bar link links button buttons icon icons form item items panel content slot unit posts post articles article stories story pages "
    "inline toggle title header body text author meta count thread module zone holder row col column group set region text more info label".split()
)
LONG_TEXT, LINKED_SHARE = 200, 1 / 3
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Containers whose names may tell of what is beside their content.
WRAPPERS = frozenset("div section article main table tbody tr td ul ol li".split())
_STATE = re.compile(r"(?:with|has|no|without)[-_].*|.*[-_](?:enabled|disabled)", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
_SPACE = re.compile(r"\s+")
_CUT_TAG = re.compile(r"<[a-zA-Z/!?][^>]*\Z")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


Line = tuple[str, int, int, int, bool, int, int, int]

#: How an element is kept from the text: not at all, as a form, by a name, by the name of other articles, in any case; or by a name within a line.
KEPT, FORM, NAMED, OTHER, AWAY, INLINE, DOUBTED = range(7)


def _head_words(value: str) -> set[str]:
    """Of each name in a class or id, the last word that isn't one of PARTS."""
    found = set()
    for name in value.split():
        words = [w.lower() for w in _WORD.findall(name)]
        while len(words) > 1 and words[-1] in PARTS:
            words.pop()
        found.update(words[-1:])
    return found


def _named_away(tag: str, attrs: list[tuple[str, str | None]], inside: bool = False) -> int:
    """KEPT, or how an element's class, id, role or style says that it is no content; ``inside`` an article less is made of names."""
    level = KEPT
    for k, v in attrs:
        if k in ("hidden", "inert") or k == "aria-hidden" and v == "true":
            return AWAY
        if not v:
            continue
        if k == "role" and v.lower() in ROLES or k == "style" and _HIDDEN.search(v):
            return AWAY
        if k in ("class", "id"):
            if tag in WRAPPERS:
                v = " ".join(x for x in v.split() if not _STATE.fullmatch(x))
            words = {w.lower() for w in _WORD.findall(v)}
            if inside and tag in BLOCKS:
                words &= _head_words(v) if tag not in QUOTES else set()
                if tag in WRAPPERS and words & NAMES and words & NAMES <= DOUBTFUL:
                    level = level or DOUBTED
                    continue
            if not NAMES.isdisjoint(words):
                level = KEPT if level == DOUBTED else level
                level = max(level, NAMED if OTHERS.isdisjoint(words) else OTHER)
    if level in (KEPT, DOUBTED):
        return level
    return level if tag in WRAPPERS else AWAY if tag in BLOCKS or tag in SKIPPED else INLINE


class Lines(HTMLParser):
    """Collects the lines of a page: (text, tags, linked characters, region, semantic, rank, named, doubt).

    ``parents`` has the region around each region; rank is how an article that
    counts only for want of others was kept from the text; named is the innermost element around
    the line that a name keeps from the text (0: none), and ``wrappers`` has the next such element around each. doubt is the innermost element of a doubtful name inside an
    article (0: none); ``doubts`` has for each the one around it, and whether it holds a heading, and what is for readers' comments.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.stack: list[tuple[str, int, int, bool, int, int, int]] = []  # tag, level, region, semantic, rank, named, doubt
        self.doubts: list[list] = [[0, False, False]]
        self.open: dict[str, int] = {}  # elements on the stack by tag
        self.parts: list[str] = []
        self.parents, self.wrappers = [0], [0]
        self.tags = self.linked = self.links = 0
        self.aside = 0  # open inline elements on the stack whose name keeps them from the text
        self.own = False  # whether the line has words outside of these

    def top(self) -> tuple[str, int, int, bool, int, int, int]:
        return self.stack[-1] if self.stack else ("", KEPT, 0, False, KEPT, 0, 0)

    def push(self, item: tuple[str, int, int, bool, int, int, int]) -> None:
        self.stack.append(item)
        self.open[item[0]] = self.open.get(item[0], 0) + 1

    def pop(self) -> None:
        tag, level = self.stack.pop()[:2]
        self.open[tag] -= 1
        if level == INLINE:
            self.aside -= 1

    def cut(self) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip() if self.own else ""
        if text:
            self.lines.append((text, self.tags, self.linked, *self.top()[2:]))
            self.tags = self.linked = 0
        self.parts, self.own = [], False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.cut()
            self.links = 0
            while self.stack and tag in ENDED_BY.get(self.stack[-1][0], ()):
                self.pop()
        elif tag == "br":
            self.parts.append(" ")
        elif tag == "a":
            self.links = 1
        named_away = _named_away(tag, attrs, self.top()[3]) if attrs and tag not in VOID and tag not in ("body", "html") else KEPT
        doubt = self.top()[6]
        if doubt and (tag in HEADINGS or named_away == OTHER):
            self.doubts[doubt][1 if tag in HEADINGS else 2] = True
        if named_away == DOUBTED:
            self.doubts.append([doubt, False, False])
            doubt = len(self.doubts) - 1
        if named_away == INLINE:
            _, outer, region, semantic, rank, named, _ = self.top()
            if not KEPT < outer < INLINE and outer != AWAY:
                self.push((tag, INLINE, region, semantic, rank, named, doubt))
                self.aside += 1
                return
            named_away = AWAY
        if tag in HOLDERS or named_away:
            named_away = KEPT if named_away == DOUBTED else named_away
            _, outer, region, semantic, rank, named, _ = self.top()
            outer = KEPT if outer == INLINE else outer
            only = tag == "main" or ("role", "main") in attrs
            main = only or tag == "article"
            away = max(FORM if tag == "form" else AWAY if tag in SKIPPED else KEPT, named_away)
            if only and tag in WRAPPERS and away < AWAY:
                away = KEPT
            if main and not away and (outer == FORM or outer < AWAY and not semantic):
                if outer > FORM and not only:
                    rank = outer
                outer, named = KEPT, 0
            elif tag == "header" and not semantic:
                away = AWAY
            if not semantic:
                self.parents.append(region)
                region = len(self.parents) - 1
            level = max(outer, away)
            if level == NAMED and FORM in (outer, away):
                level = OTHER
            if level == NAMED == away:
                self.wrappers.append(named)
                named = len(self.wrappers) - 1
            self.push((tag, level, region, semantic or main and not level, rank, named, doubt))

    def parse_html_declaration(self, i: int) -> int:
        """``<![`` that opens no CDATA is a comment up to the next ``>``, as browsers take it."""
        if self.rawdata.startswith("<![", i) and not self.rawdata.startswith("<![CDATA[", i):
            end = self.rawdata.find(">", i)
            return end + 1 if end >= 0 else -1
        return super().parse_html_declaration(i)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.cut()
        elif tag == "br":
            self.parts.append(" ")

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.cut()
        if tag == "a":
            self.links = 0
        if not self.open.get(tag):
            return
        while True:  # what is passed over ends here, so each element is looked at once
            last, level = self.stack[-1][:2]
            if last == tag and tag not in BLOCKS and level not in (KEPT, INLINE):
                self.parts.append(" ")
            self.pop()
            if last == tag:
                return

    def handle_data(self, data: str) -> None:
        if self.top()[1] not in (KEPT, NAMED, INLINE):
            return
        self.parts.append(data)
        if not self.aside and not self.own:
            self.own = not data.isspace()
        if self.links:
            self.linked += len(data)


def _believed(lines: list[Line], doubts: list[list]) -> list[Line]:
    """Without the lines of doubtful elements that have no heading, little text, many links or readers' comments inside."""
    if len(doubts) == 1:
        return lines
    text, linked = [0] * len(doubts), [0] * len(doubts)
    for x in lines:
        text[x[7]] += len(x[0])
        linked[x[7]] += x[2]
    for i in range(len(doubts) - 1, 0, -1):  # an element is numbered before what it holds
        outer, heading, other = doubts[i]
        text[outer] += text[i]
        linked[outer] += linked[i]
        doubts[outer][1] |= heading
        doubts[outer][2] |= other
    kept = [True]
    for i in range(1, len(doubts)):
        outer, heading, other = doubts[i]
        kept.append(kept[outer] and heading and not other and text[i] - linked[i] >= LONG_TEXT and linked[i] <= LINKED_SHARE * text[i])
    return [x for x in lines if kept[x[7]]]


def _unwrapped(lines: list[Line], wrappers: list[int]) -> list[Line]:
    """The lines that no name keeps from the text; without an article or main among them, those of wrappers, too."""
    kept = [x for x in lines if not x[6]]
    if len(kept) == len(lines) or any(x[4] and x[5] == KEPT for x in kept):
        return kept
    inside = [0] * len(wrappers)
    for text, _, linked, _, _, _, named, _ in lines:
        inside[named] += len(text) - linked
    for i in range(len(wrappers) - 1, 0, -1):  # an element is numbered before what it holds
        inside[wrappers[i]] += inside[i]
    free = {0}
    for i in range(1, len(wrappers)):
        if wrappers[i] in free and inside[i] > WRAPPER_SHARE * inside[0]:
            free.add(i)
    return [x for x in lines if x[6] in free]


def _counting(lines: list[Line]) -> list[Line]:
    """The lines that no name keeps from the text, or those of articles in wrappers that count for want of others."""
    kept, wrapped = ([x for x in lines if x[5] == rank] for rank in (KEPT, NAMED))
    if not any(x[4] for x in kept) and sum(len(x[0]) - x[2] for x in wrapped) > sum(len(x[0]) - x[2] for x in kept):
        return wrapped
    return kept or wrapped or lines


def _container(regions: set[int], parents: list[int]) -> int:
    """The smallest region that holds all: each gives way to the one around it, from the last to the first, until one is left."""
    held, left = bytearray(len(parents)), len(regions)
    for r in regions:
        held[r] = 1
    for r in range(max(regions), -1, -1):  # a container is numbered before what it holds
        if held[r]:
            if left == 1:
                return r
            if held[parents[r]]:
                left -= 1
            held[parents[r]] = 1
    return 0


def content_lines(lines: list[Line], parents: list[int], wrappers: list[int]) -> list[str]:
    """The lines of the regions that the clusters select."""
    lines = _counting(_unwrapped(lines, wrappers))
    if not lines:
        return []
    ratio = np.array([max(0, len(t) - linked) / max(1, tags) for t, tags, linked, *_ in lines])
    k = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2)
    padded = np.pad(ratio, RADIUS, mode="edge")
    smooth = np.convolve(padded, k / k.sum(), mode="valid")
    chosen = smooth >= min(smooth.mean(), smooth.std() if smooth.std() > 0 else smooth.mean())
    regions = {x[3] for x, c in zip(lines, chosen) if x[4] and c} or {x[3] for x in lines if x[4]}
    if not regions:
        regions = {x[3] for x, c in zip(lines, chosen) if c}
        top = _container(regions, parents)
        regions = {top}
        for r in range(top + 1, len(parents)):
            if parents[r] in regions:
                regions.add(r)
    return [x[0] for x in lines if x[3] in regions]


def main_text(html: str | None) -> str:
    parser = Lines()
    try:
        parser.feed(html or "")
        if _CUT_TAG.match(parser.rawdata):  # the page ends inside a tag
            parser.rawdata = ""
        parser.close()
    except (AssertionError, ValueError):  # the standard parser gives up on some broken declarations; what was read counts
        pass
    parser.cut()
    return "\n\n".join(content_lines(_believed(parser.lines, parser.doubts), parser.parents, parser.wrappers))


def extract_text(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with the main text and its number of code points (n_chars)."""

    @pandas_udf("string")
    def main_texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for htmls in batches:
            yield htmls.map(main_text)

    texts = pages.withColumn(text_col, main_texts(F.coalesce(F.col(html_col), F.lit(""))))
    return texts.withColumn("n_chars", F.length(text_col).cast("long"))
