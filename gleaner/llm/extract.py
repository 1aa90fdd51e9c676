"""Main text of web pages by tag-path ratios.

A page is a sequence of text blocks, each with the path of tags from the root
to it.  For each path, text length and punctuation are summed over its nodes;
the two ratios are fused, smoothed over the page and held against a threshold.
Boxes (the nearest enclosing article, section, div, cell, ...) whose text on the
whole reaches it are content with all that they enclose, so short paragraphs of
an article stay and short boxes beside it go.  Elements that say what they are
(navigation, footer, advert, comments, ...) are no candidates; forms and boxes
named after a sidebar, banner and the like are none either, unless they hold an
article or the bulk of the page.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from math import exp, sqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:_-]*")
_MARK = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden|itemprop)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text of the page.
_OPAQUE = frozenset("script style noscript template svg math iframe object audio video canvas select textarea button head title datalist".split())
#: All that an open head may hold; any other element ends it.
_IN_HEAD = frozenset("head title meta link base basefont bgsound script style noscript template object".split())
_RAW = frozenset("script style textarea title noscript iframe template".split())
_OUTSIDE = frozenset("nav footer aside menu dialog".split())
_BLOCK = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption hr address details summary fieldset header footer nav aside form center menu dialog".split()
)
_BOX = frozenset("html body main article section div td blockquote details center fieldset figure".split())
#: A start tag of the first kind ends an open element of the second.
_ENDS = {
    **dict.fromkeys("p div ul ol dl table blockquote pre section article main aside header footer nav form h1 h2 h3 h4 h5 h6 hr address figure fieldset details center menu".split(), frozenset(["p"])),
    "li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]),
}
_FENCE = frozenset("html body main article section div table td th ul ol dl blockquote aside header footer nav form".split())
_ASIDE = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|menubar|breadcrumbs?|masthead|topbar|footer|sidebar|side|aside|widget|ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo|promotion|banner|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscribe|signup|login|comments?|disqus|repl(?:y|ies)|respond|discussion|related|recommend(?:ed|ations)?|share|sharing|social|pagination|pager|toolbar|copyright|legal|disclaimer|skip|site-header|page-header)(?:$|[\s_-])",
    re.I,
)
_COMMENT = re.compile(r"(?:^|[\s_-])(?:comments?|repl(?:y|ies)|disqus|respond|discussion|ads?|advert(?:isement)?|sponsored|related|promo)(?:$|[\s_-])", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")


#: How an element is taken: as text, as what the page says is none unless it
#: holds the bulk of it, or as no text in any case.
PLAIN, DOUBTFUL, OUTSIDE = 0, 1, 2


def _standing(tag: str, attributes: str, inside_article: bool, hints: bool) -> int:
    if tag in _OUTSIDE or (tag == "header" and not inside_article):
        return OUTSIDE
    out = DOUBTFUL if tag == "form" else PLAIN
    if not attributes.strip():
        return out
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id") and tag not in ("html", "body", "main") and hints:
            if _COMMENT.search(value):
                return OUTSIDE
            if tag != "article" and _ASIDE.search(value):
                out = DOUBTFUL
        if name == "role" and value.lower() in _ROLES:
            out = max(out, DOUBTFUL if value.lower() == "form" else OUTSIDE)
        if name == "style" and _HIDDEN.search(value) or name == "aria-hidden" and value.lower() == "true":
            return OUTSIDE
        if name == "hidden" and re.search(r"(?:^|\s)hidden(?:\s|=|$|/)", attributes, re.I):
            return OUTSIDE
    return out


class Block:
    """A stretch of text: number of its tag path, of its nearest box and nearest
    doubtful element (-1 for none), inside an article, characters in links."""

    __slots__ = ("path", "box", "doubt", "text", "good", "linked")

    def __init__(self, path: int, box: int, doubt: int, text: str, good: bool, linked: int):
        self.path, self.box, self.doubt, self.text, self.good, self.linked = path, box, doubt, text, good, linked


class Page:
    """The candidate blocks of a page in order; for each box and each doubtful
    element the one that encloses it, and the doubtful ones that hold an article."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.box_parents: list[int] = []
        self.doubt_parents: list[int] = []
        self.excused: set[int] = set()


class _Ends:
    """Where tags of a page end.  Quotes that lead nowhere and the mark that
    comes next are remembered, so no stretch is walked twice however many tags
    are left open."""

    def __init__(self, page: str):
        self.page, self.dead = page, set()
        self.none: set[str] = set()  # what does not come any more
        self.known = (0, -1)  # no mark between the two but at the second

    def _find(self, what: str, at: int) -> int:
        found = -1 if what in self.none else self.page.find(what, at)
        if found < 0:
            self.none.add(what)
        return found

    def _mark(self, at: int) -> int:
        if self.known[0] <= at <= self.known[1]:
            return self.known[1]
        found = None if "" in self.none else _MARK.search(self.page, at)
        if found is None:
            self.none.add("")
            return -1
        self.known = (at, found.start())
        return found.start()

    def plain(self, at: int) -> int:
        return self._find(">", at)

    def of(self, at: int) -> int:
        """The ">" of a tag, looking from behind its name: the first outside
        quotes, or behind a quote that is never closed the first of all; -1 if
        there is none."""
        passed = []
        while (mark := self._mark(at)) >= 0 and mark not in self.dead:
            if self.page[mark] == ">":
                return mark
            close = self._find(self.page[mark], mark + 1)
            if close < 0:
                return self.plain(mark + 1)
            passed.append(mark)
            at = close + 1
        self.dead.update(passed)
        return -1


def parse(page: str, hints: bool = True) -> Page:
    """A page's blocks, with references decoded and white space single.

    One walk over the page; what it looks back at is kept by name of element,
    so neither open tags nor deep nesting make it walk again."""
    out = Page()
    stack: list[tuple[str, int, int, int, int]] = []  # tag, standing, path, box, doubt
    open_at: dict[str, list[int]] = defaultdict(list)  # tag -> where it stands on the stack
    fences: list[int] = []
    paths: dict[tuple[int, str], int] = {}
    tag_ends = _Ends(page)
    outside = opaque = linked = 0
    parts: list[str] = []
    first: tuple[int, int, int, bool] | None = None
    at, n = 0, len(page)

    def flush():
        nonlocal first, linked
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        if text:
            out.blocks.append(Block(*first[:3], text, first[3], linked))
        parts.clear()
        first, linked = None, 0

    def add(text: str):
        nonlocal first, linked
        if text and not outside and not opaque:
            if first is None and not text.isspace():
                _, _, path, box, doubt = stack[-1] if stack else ("", 0, -1, -1, -1)
                first = path, box, doubt, bool(open_at["article"] or open_at["main"])
            parts.append(text)
            linked += len(text) if open_at["a"] else 0

    def pop_to(depth: int):
        nonlocal outside, opaque
        while len(stack) > depth:
            tag, standing, *_ = stack.pop()
            outside -= standing == OUTSIDE
            opaque -= tag in _OPAQUE
            open_at[tag].pop()
            if tag in _FENCE:
                fences.pop()

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        add(page[at:lt])
        if page.startswith(("<!--", "<![CDATA["), lt):
            end, size = (page.find("-->", lt + 4), 3) if page.startswith("<!--", lt) else (page.find("]]>", lt + 9), 3)
            at = end + size if end >= 0 else n
            continue
        closing = page.startswith("</", lt)
        name = _NAME.match(page, lt + 1 + closing)
        if name is None:
            end = tag_ends.plain(lt) if page.startswith(("<!", "<?"), lt) else -1
            if end < 0:
                add("<")
                at = lt + 1
            else:
                at = end + 1
            continue
        end = tag_ends.of(name.end())
        if end < 0:
            add("<")
            at = lt + 1
            continue
        tag, attributes, at = name.group().lower(), page[name.end() : end], end + 1
        if tag == "br":
            add(" ")
            continue
        if tag in _BLOCK:
            flush()
        if closing:
            if open_at[tag] and (tag in _FENCE or not fences or fences[-1] < open_at[tag][-1]):
                pop_to(open_at[tag][-1])
            continue
        if open_at["head"] and tag not in _IN_HEAD:
            pop_to(open_at["head"][0])
        if tag in _VOID:
            continue
        ends = _ENDS.get(tag, ())
        while ended := [open_at[e][-1] for e in ends if open_at[e] and (open_at[e][-1] > fences[-1] if fences and e not in _FENCE else not fences or open_at[e][-1] >= fences[-1])]:
            pop_to(max(ended))
        if attributes.endswith("/") and tag not in _BLOCK:
            continue
        if tag in _RAW:
            close = _closing(tag).search(page, at)
            at = close.end() if close else n
            continue
        standing = _standing(tag, attributes, bool(open_at["article"] or open_at["main"]), hints)
        _, _, path, box, doubt = stack[-1] if stack else ("", 0, -1, -1, -1)
        path = paths.setdefault((path, tag), len(paths))
        if tag in ("article", "main") and doubt >= 0 and not outside and standing != OUTSIDE:
            out.excused.add(doubt)
        if tag in _BOX and tag not in ("html", "body"):
            out.box_parents.append(box)
            box = len(out.box_parents) - 1
        if standing == DOUBTFUL:
            out.doubt_parents.append(doubt)
            doubt = len(out.doubt_parents) - 1
        outside += standing == OUTSIDE
        opaque += tag in _OPAQUE
        open_at[tag].append(len(stack))
        if tag in _FENCE:
            fences.append(len(stack))
        stack.append((tag, standing, path, box, doubt))
    flush()
    return out


@cache
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\s*>", re.I)


def candidates(page: Page, bulk: float = 0.9) -> list[Block]:
    """The blocks without those in doubtful elements, unless such an element
    holds an article or at least ``bulk`` of the page's text out of links: a
    page in one form, or whose frame is named after its sidebar, is a page."""
    plain = [max(0, len(b.text) - b.linked) for b in page.blocks]
    held = [0] * len(page.doubt_parents)
    for b, size in zip(page.blocks, plain, strict=True):
        if b.doubt >= 0:
            held[b.doubt] += size
    for i in reversed(range(len(held))):
        if page.doubt_parents[i] >= 0:
            held[page.doubt_parents[i]] += held[i]
            if i in page.excused:
                page.excused.add(page.doubt_parents[i])
    total, fine = sum(plain), []
    for i, parent in enumerate(page.doubt_parents):
        fine.append((i in page.excused or held[i] >= bulk * total > 0) and (parent < 0 or fine[parent]))
    return [b for b in page.blocks if b.doubt < 0 or fine[b.doubt]]


def content_blocks(page: Page, reach: int = 2, prior: float = 4.0) -> list[Block]:
    """The blocks of the main text, by fused and smoothed ratios of their tag paths."""
    blocks = candidates(page)
    if not blocks:
        return []
    length, marks, nodes = defaultdict(float), defaultdict(float), defaultdict(int)
    for b in blocks:
        length[b.path] += len(b.text)
        marks[b.path] += len(_PUNCTUATION.findall(b.text))
        nodes[b.path] += 1
    fused = [length[b.path] / nodes[b.path] * (1 + marks[b.path] / nodes[b.path]) * (prior if b.good else 1) for b in blocks]
    kernel = [exp(-0.5 * (d / max(reach / 2, 1e-9)) ** 2) for d in range(-reach, reach + 1)]
    smooth = []
    for i in range(len(fused)):
        near = [(kernel[j - i + reach], fused[j]) for j in range(max(0, i - reach), min(len(fused), i + reach + 1))]
        # Neighbours do not make a list of links a text.
        plain = max(0.0, 1 - blocks[i].linked / len(blocks[i].text))
        smooth.append(plain * sum(k * x for k, x in near) / sum(k for k, _ in near))
    mean = sum(smooth) / len(smooth)
    threshold = min(sqrt(sum((x - mean) ** 2 for x in smooth) / len(smooth)), 0.5 * max(smooth))
    # A box is content if its own text lies above the threshold on the whole; so is all that it encloses.
    held, score = defaultdict(float), defaultdict(float)
    for b, x in zip(blocks, smooth, strict=True):
        held[b.box] += len(b.text)
        score[b.box] += len(b.text) * x
    content = {box for box in held if score[box] > 0 and score[box] >= threshold * held[box]}
    inside = [False] * len(page.box_parents)
    for box, parent in enumerate(page.box_parents):
        inside[box] = box in content or (parent >= 0 and inside[parent])
    return [b for b in blocks if (inside[b.box] if b.box >= 0 else -1 in content)]


def main_text(page: str, hints: bool = True) -> str:
    """``hints``: whether class names and ids say what an element is."""
    return "\n".join(b.text for b in content_blocks(parse(page, hints)))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(p) for p in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars (code points).

    Null and empty pages, and pages without a main text, give an empty text.
    Pages without an id or url keep them null; repeated rows give repeated
    rows.  Other columns are not looked at.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
