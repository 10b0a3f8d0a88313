"""Main text of web pages by tag-path ratios.

A page is read into blocks of text, each with the path of block elements that
leads to it.  Paragraphs, lists, tables and plain wrappers fold into the element
around them, so a path ends at a classed or sectioning element, or at the element
that has text of its own.  Per path, text length outside links and punctuation are
summed and divided by the number of blocks; the two ratios are fused, smoothed
over neighbouring blocks in page order, and averaged back onto the path.

A path is content if its score reaches a share of the page's length-weighted
mean.  Text in paragraph elements counts for more; text straight in an element is
weighed by how much of it the page has on that path; class words that may tell of
something else count against it.  Tags and class words that leave no doubt
(menus, headers, footers, sidebars, notices, adverts, forms, comments of readers)
drop a block whatever its score.  If articles hold most of the content, or else a
main element, nothing outside them stays.  Headings stay with what they head, and
lists of links go.
"""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common
from .common import text_slices

#: Smoothing weights over the blocks around one, and the smoothed ratio's share of the fused one.
KERNEL = (0.25, 0.5, 1.0, 0.5, 0.25)
SMOOTH = 0.25
#: The share of the mean that content has, of the text an article must have for
#: nothing else to count, and of links in what is a list of them.
THRESHOLD = 0.4
COVER = 0.5
LINKS = 0.8
#: Weights of paragraph elements and of each doubtful class word.
PARAGRAPH, DOUBT = 1.25, 0.5

#: What HTML reads as raw text: without an end tag the rest of the page is in it.
RAW = {"script", "style", "textarea", "title", "iframe", "noframes", "noembed", "xmp"}
#: Skipped up to the end tag; without one only the tag is.
SKIPPED = {"noscript", "template", "svg", "object", "canvas", "audio", "video", "annotation", "annotation-xml"}
END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I | re.A) for t in RAW | SKIPPED}
#: Tokens of formulas, set apart by spaces.
FORMULA = {"mi", "mn", "mo", "ms", "mtext"}
BOILERPLATE = {"nav", "footer", "aside", "form", "dialog", "menu", "button", "select", "fieldset", "head", "label", "input"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "ruby", "rp", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "img", "br", "wbr",
    "math", "maction", "menclose", "merror", "mfenced", "mfrac", "mmultiscripts", "mover", "mpadded", "mphantom", "mprescripts", "mroot", "mrow", "mspace", "msqrt", "mstyle", "msub", "msubsup", "msup", "mtable", "mtd", "mtr", "mlabeledtr", "munder", "munderover", "none", "semantics", *FORMULA,
}
#: Parts of an article, never all of it: what holds them is.
PARTS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "ul", "ol", "li", "dl", "dt", "dd", "table", "caption", "thead", "tbody", "tfoot", "tr", "td", "th", "pre", "blockquote", "figure", "figcaption", "section", "details", "summary"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
#: Words of a class, id or role that tell what an element is for.
HINTS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs",
    "sidebar", "aside", "complementary", "footer", "contentinfo", "masthead", "comment", "comments", "commentlist", "discussion", "disqus", "replies", "reply", "respond", "related", "recommended", "share", "sharing", "social", "newsletter", "subscribe", "subscription", "signup", "login",
    "popup", "modal", "dialog", "overlay", "widget", "toolbar", "pagination", "pager", "paywall", "search", "searchform", "skip", "tagcloud",
}
#: Words that say nothing beside a hint: "ad-box" is as sure as "ad", "related-work" isn't "related".
GENERIC = {
    "", "area", "bar", "big", "block", "body", "bottom", "box", "btn", "button", "card", "col", "column", "container", "content", "contents", "data", "field", "fixed", "form", "global", "group", "header", "heading", "holder", "id", "inline", "inner", "item", "items", "js", "label", "left", "line", "link", "links", "list", "local", "main", "message", "module", "news", "outer",
    "page", "panel", "policy", "post", "posts", "primary", "region", "right", "row", "secondary", "section", "site", "slot", "small", "stories", "sticky", "sub", "text", "thread", "title", "top", "unit", "user", "users", "view", "wide", "wrap", "wrapper", "zone",
}
HEADER_HINTS = {"header", "topbar"}
#: The head of an article is part of it.
OWN_HEADER = {"article", "content", "entry", "page", "post", "section", "story"}
KEEPERS = {"html", "body", "article", "main"}
TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|!\[CDATA\[(.*?)(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|/?[a-zA-Z][^>]*(?:>|\Z))""", re.S)
SIMPLE = re.compile(r"(/?)([a-zA-Z][^\s/>]*)([^>]*)", re.S)
#: What also drops an article element: teasers and comments come as such.
ARTICLE_HINTS = {"ad", "ads", "advert", "advertisement", "comment", "comments", "promo", "related", "reply", "sponsored", "teaser"}
#: Classes that say what a page has or lacks, not what an element is.
ABOUT_PAGE = re.compile(r"\b(?:no|has|with|without)[-_]\w+", re.I)
ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.S)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|[^A-Za-z]+")
PUNCT = re.compile(r"[.,;:!?。、，；：！？…¿¡»«\"“”()]")
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"thead", "tbody", "tfoot", "tr", "td", "th"}, "tbody": {"thead", "tbody", "tfoot", "tr", "td", "th"}}
SCOPE = {"ul", "ol", "dl", "table", "div", "article", "section", "main", "body", "html", "td", "th", "blockquote"}


def _name_words(token: str) -> set[str]:
    return {w.lower() for w in CAMEL.split(token)} - {""}


def judge_name(token: str, hints: set[str]) -> tuple[bool, bool]:
    """(surely, perhaps) a name of what isn't the article."""
    ws = _name_words(token)
    return bool(ws & hints) and ws <= hints | GENERIC, bool(ws & hints) and not ws <= hints | GENERIC


def is_header_name(token: str) -> bool:
    ws = _name_words(token)
    return bool(ws & HEADER_HINTS) and not ws & OWN_HEADER - {"page", "content"} and ws <= HEADER_HINTS | GENERIC


@dataclass
class Block:
    path: tuple[int, ...]  # element numbers from the root
    names: tuple[str, ...]  # their tags, with classes
    text: str
    link: int  # characters in links
    dropped: bool
    heading: bool
    doubts: int = 0  # elements whose class words may tell of something else
    place: tuple[str, ...] = ()  # the path that is judged
    marked: bool = False  # in a paragraph element, not straight in that path's


@dataclass
class _Reader:
    """Open elements, and the blocks read so far."""

    blocks: list[Block] = field(default_factory=list)
    stack: list[tuple[str, str, int, int, bool]] = field(default_factory=list)  # tag, name, number, kind, doubtful
    parts: list[tuple[str, bool]] = field(default_factory=list)
    count: int = 0
    links: int = 0

    def flush(self) -> None:
        if not self.parts:
            return
        text = " ".join("".join(p for p, _ in self.parts).split())
        if text:
            kinds = [e[3] for e in self.stack]
            heading = any(e[0] in HEADINGS for e in self.stack)
            inside = max((i for i, e in enumerate(self.stack) if e[0] in ("article", "main")), default=-1)
            dropped = 2 in kinds or any(k == 1 and not (heading and i > inside >= 0) for i, k in enumerate(kinds))
            link = sum(len("".join(p.split())) for p, in_link in self.parts if in_link)
            blocks = [e for e in self.stack if e[0] not in INLINE]
            ends = max((i + 1 for i, (tag, name, _, _, doubtful) in enumerate(blocks) if doubtful or (tag not in PARTS and name != "div")), default=0)
            marked = any(e[0] in PARTS for e in blocks[ends:])
            place = tuple(e[1] for e in (blocks[:ends] if marked else blocks))
            doubts = sum(e[4] for e in self.stack)
            self.blocks.append(Block(tuple(e[2] for e in self.stack), tuple(e[1] for e in self.stack), text, link, dropped, heading, doubts, place, marked))
        self.parts = []

    def open(self, tag: str, attrs: str) -> None:
        if tag == "a":
            self.links += 1
        if tag in ("br", "wbr", "img"):
            if tag == "br":
                self.parts.append((" ", False))
            return
        kind, name, doubtful = (1 if tag == "header" else 2 if tag in BOILERPLATE else 0), tag, False
        if attrs and tag not in ("html", "body"):
            found = {m[1].lower(): (m[2] or "").strip("\"'") for m in ATTR.finditer(attrs)}
            for k in ("class", "id", "role"):
                for token in ABOUT_PAGE.sub(" ", found.get(k, "")).split():
                    sure, doubt = judge_name(token, ARTICLE_HINTS if tag in KEEPERS else HINTS)
                    kind = 2 if sure else kind
                    doubtful |= doubt
                    if tag not in KEEPERS and is_header_name(token):
                        kind = max(kind, 1)
            if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
                kind = 2
            if found.get("class"):
                name = f"{tag}.{found['class']}"
        if tag in INLINE:
            if kind:  # a hidden span ends the run of text but not the block
                self.stack.append((tag, name, self.count, kind, doubtful))
                self.count += 1
            return
        self.flush()
        self._imply(tag)
        if tag in VOID:
            return
        self.stack.append((tag, name, self.count, kind, doubtful))
        self.count += 1

    def _imply(self, tag: str) -> None:
        """End tags that HTML leaves out before ``tag``."""
        closes = CLOSES.get(tag, set())
        for i in range(len(self.stack) - 1, -1, -1):
            t = self.stack[i][0]
            if t == "p":
                del self.stack[i:]
                return
            if t in closes:
                del self.stack[i:]
                if tag not in ("tr", "thead", "tbody"):
                    return
            elif t in SCOPE and t not in closes:
                return

    def close(self, tag: str) -> None:
        if tag == "a":
            self.links = max(0, self.links - 1)
        elif tag in FORMULA:
            self.parts.append((" ", False))
        if tag not in INLINE:
            self.flush()
            self.links = 0 if tag in SCOPE else self.links
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                if self.stack[i][3]:
                    self.flush()
                del self.stack[i:]
                return
            if tag in INLINE and self.stack[i][0] not in INLINE:
                return

    def text(self, raw: str) -> None:
        if raw:
            self.parts.append((html.unescape(raw) if "&" in raw else raw, self.links > 0))


def blocks(page: str) -> list[Block]:
    """The blocks of a page in page order."""
    r, at = _Reader(), 0
    endless: set[str] = set()  # no end tag of these from here on
    while m := TAG.search(page, at):
        if m.start() > at:
            r.text(page[at : m.start()])
        at = m.end()
        tag, slash, attrs = m[3], m[2], m[4]
        if m[1] is not None:
            r.text(m[1])
            continue
        if tag is None:
            s = SIMPLE.match(page, m.start() + 1)
            if not s:
                continue
            slash, tag, attrs = s[1], s[2], s[3]
        tag = tag.lower()
        if slash:
            r.close(tag)
        elif tag in END:
            if tag in endless or attrs.rstrip().endswith("/"):
                continue
            if end := END[tag].search(page, at):
                at = page.find(">", end.end()) + 1 or len(page)
            elif tag in RAW:
                at = len(page)
            else:
                endless.add(tag)
        else:
            r.open(tag, attrs)
    r.text(page[at:])
    r.flush()
    return r.blocks


def path_scores(found: list[Block]) -> dict[tuple[str, ...], float]:
    """Fused and smoothed ratio of each path; headings count where there is nothing else."""
    sums: dict[tuple[str, ...], list[float]] = {}
    texts = {b.place for b in found if not b.heading}
    for b in found:
        if b.heading and b.place in texts:
            continue
        s = sums.setdefault(b.place, [0, 0, 0])
        s[0] += max(0, len(b.text) - b.link)
        s[1] += len(PUNCT.findall(b.text)) * (b.link < LINKS * len(b.text))
        s[2] += 1
    fused = {p: math.sqrt(n / k * (1 + q / k)) for p, (n, q, k) in sums.items()}
    raw, half = [fused[b.place] for b in found], len(KERNEL) // 2
    around: dict[tuple[str, ...], list[float]] = {}
    for i, b in enumerate(found):
        near = [(raw[i + d], KERNEL[d + half]) for d in range(-half, half + 1) if 0 <= i + d < len(raw)]
        around.setdefault(b.place, []).append(sum(v * w for v, w in near) / sum(w for _, w in near))
    return {p: fused[p] ** (1 - SMOOTH) * (sum(v) / len(v)) ** SMOOTH for p, v in around.items()}


def content(found: list[Block]) -> list[bool]:
    """Which blocks are on content paths."""
    score = path_scores(found)
    size: dict[tuple[str, ...], int] = {}
    for b in found:
        size[b.place] = size.get(b.place, 0) + len(b.text)
    total, most = sum(size.values()), max(size.values())
    limit = THRESHOLD * sum(score[p] * n for p, n in size.items()) / total
    weight = lambda b: (PARAGRAPH if b.marked else math.sqrt(size[b.place] / most)) * DOUBT**b.doubts
    return [score[b.place] * weight(b) >= limit for b in found]


def extract(page: str | None) -> str:
    """The main text of a page: its blocks joined by an empty line."""
    found = [b for b in blocks(page or "") if not b.dropped]
    if not found:
        return ""
    chosen = content(found)
    # outside of articles, or else of a main element, that hold most of it nothing counts
    mass = sum(len(b.text) for b, ok in zip(found, chosen) if ok)
    home = [True] * len(found)
    for tag in ("article", "main"):
        inside = [any(n.split(".")[0] == tag for n in b.names) for b in found]
        if mass and sum(len(b.text) for b, ok, here in zip(found, chosen, inside) if ok and here) >= COVER * mass:
            home = inside
            break
    for i in range(home.index(True) - 1, -1, -1):  # headings directly before it
        if not found[i].heading:
            break
        home[i] = True
    # a path of links only is a list of them
    links: dict[tuple[str, ...], list[int]] = {}
    for b in found:
        n = links.setdefault(b.names, [0, 0])
        n[0] += b.link
        n[1] += len("".join(b.text.split()))
    keep = [here and ok and (b.heading or links[b.names][0] < LINKS * links[b.names][1]) for b, ok, here in zip(found, chosen, home)]
    # a heading stays with what it heads, and where its path has other text that does
    texts = {b.place for b in found if not b.heading}
    kept = {b.place for b, ok in zip(found, keep) if ok and not b.heading}
    follows = False
    for i in range(len(found) - 1, -1, -1):
        if found[i].heading:
            keep[i] = home[i] and (follows or (keep[i] and (found[i].place in kept or found[i].place not in texts)))
        else:
            follows = keep[i]
    return "\n\n".join(b.text for b, ok in zip(found, keep) if ok)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row.

    Null and empty pages, and those with no text, give an empty text.
    Repeated rows are read alike, null ids and urls are kept; columns of other
    names are ignored; an empty table gives an empty result.
    """

    def work(batches):
        for b in text_slices(batches, 2):
            text = [extract(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = common.clean_names(pages, {"page_id": id_col, "url": url_col, "html": html_col})
    kinds = [rows.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return rows.mapInArrow(work, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(common.table(spark, sf_dir, "pages"))
