"""HTML extraction by line-block distribution.

Markup is stripped to lines: a block element starts and ends a line, inline markup leaves the line whole, and what no reader
sees as text (head, scripts, styles, controls, comments of the source, hidden elements) leaves none.  A line weighs the length
of its text that is no link; a line that is mostly link weighs nothing, unless it is a heading.  Weights are summed over
sliding windows of lines, and the sums decide everything:

* The text's lines are those outside of boxes that look like furniture.  They are kept from the first surge, a window that
  carries enough from a line with weight on, to the last dive, after which windows weigh nothing.
* A box looks like furniture by its kind (navigation, footer, aside, form, their roles), by a name all of whose words say so,
  or by its controls.  That only takes weight from its lines: all but a ``FURNITURE``th, or half for a weak hint.  The box has a
  distribution of its own, and stays where it surges and comes up to a quarter of the text's highest window.
* A box that holds the marked article, or most of the page's text with its headline, is no furniture but wraps the article.

Where the page marks its article (``article``, ``main``, role main), lines inside weigh twice, and lines outside half of what
they have beyond ``OUTSIDE`` characters; text that goes on past the mark may so be kept.  A surge inside the mark takes the
weighing lines right before it along.  Links alone at the start of a mark are a menu and are cut, if they fill a window; at its
end they stay where a heading leads to them, as references do, or where they don't fill a window.  A page that never surges is
kept from its first line of any weight.

White space inside a line becomes one space, character references are decoded, lines are joined by one line feed.  Null and
empty pages give an empty text.  Rows that repeat, and null ids, are pages like any other; an empty table gives no rows.
Nothing is capped; a page is read once, and boxes are measured by running sums, so time grows with the page.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import arrow_function, bounded_batches

#: Lines of a window, weight that makes a surge, characters of an unmarked line that weigh nothing beside a marked article, and
#: what a mark and furniture do to weights.
WINDOW, SURGE, OUTSIDE = 3, 80, 160
MARKED, FURNITURE, HINT = 2, 256, 2
#: The part of the text's highest window that a box must reach to stay, and characters for each control that make no form.
SHARE, CONTROL_TEXT = 4, 60

#: Fixed names of HTML elements.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg".split())
DROPPED = RAW | frozenset("head select button object audio video canvas map annotation annotation-xml".split())
KINDS = frozenset("nav footer aside form dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CONTROLS = frozenset("input select textarea button".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class and id names.  A name counts if each of its words is here and one at least is of FURNISHING.
FURNISHING = frozenset(
    """ad ads adsense advert adverts advertisement advertisements advertising sponsor sponsors sponsored promo promos promotion promotions promoted related recommended recommendations comment comments commenting replies reply disqus
    nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar aside footer masthead topbar toolbar notice notices notification notifications alert alerts cookie cookies consent gdpr popup modal overlay
    newsletter subscribe subscription signup login share sharing social banner copyright""".split()
)
#: These furnish a page, but not an article.
OUTER = frozenset("header banner masthead".split())
HINTS = frozenset("widget widgets".split())
SETTING = frozenset(
    """site page global main top bottom left right primary secondary mobile reader readers user users visitor visitors guest post posts article articles story stories news entry content contents item items link links list lists section
    sections block blocks box boxes bar area slot unit container wrapper wrap inner outer group panel column col row thread threads form button buttons icon icons info success warning danger error primary secondary google facebook twitter
    header widget widgets body title heading text fixed sticky""".split()
)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.S)
#: Elements that end an open paragraph, and those that end their own kind.
ENDS_P = BLOCKS - {"option", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "html", "body", "head", "title", "legend", "summary"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}


def attributes(source: str) -> dict[str, str]:
    return {k.lower(): references.unescape((v or "").strip("\"'")) for k, v in ATTRIBUTE.findall(source)}


def named(name: str, inside: bool) -> int:
    """What a class or id says of its box: FURNITURE, HINT, or 1 for nothing.  Inside a marked article headers are its own."""
    words = [w.lower() for w in WORD.findall(name)]
    known = FURNISHING - OUTER if inside else FURNISHING | OUTER
    if not words or not all(w in FURNISHING or w in SETTING or w in OUTER or w.isdigit() for w in words):
        return 1
    if any(w in known and not (w in OUTER and {"post", "article", "entry", "story", "content", "section"} & set(words)) for w in words):
        return FURNITURE
    return HINT if set(words) <= HINTS else 1


class Box:
    """A block element: what it looks like, and the text in it."""

    __slots__ = ("parent", "looks", "is_kind", "start", "end", "controls", "marks", "headline")

    def __init__(self, parent: int, looks: int, is_kind: bool, start: int):
        self.parent, self.looks, self.is_kind, self.start = parent, looks, is_kind, start
        self.end = self.controls = 0
        self.marks = self.headline = False


class Line(NamedTuple):
    text: str
    inside: bool  # a marked article
    linked: int  # characters that are link text
    heading: bool
    box: int  # the innermost box


class Page:
    """A page's lines that have text, in order, and its boxes, each after the one that it is in."""

    def __init__(self, page: str):
        self.lines: list[Line] = []
        self.boxes = [Box(-1, 1, False, 0)]
        self._text: list[str] = []
        self._linked = self._size = self._inside = self._links = self._headings = self._dropping = self._pre = 0
        self._stack: list[tuple[str, bool, bool, int]] = []  # tag, drops, marks, box or 0
        self._open: Counter[str] = Counter()
        self._box = 0
        self._marked = self._headed = False
        self._read(page)
        self._pop(0)
        self._flush()
        self.boxes[0].end = self._size

    def _flush(self) -> None:
        if self._dropping:
            return
        if line := " ".join("".join(self._text).split()):
            self.lines.append(Line(line, self._inside > 0, min(self._linked, len(line)), self._headings > 0, self._box))
            self._size += len(line)
        self._text.clear()
        self._linked = 0

    def _pop(self, n: int) -> None:
        for tag, drops, marks, box in reversed(self._stack[n:]):
            if tag in BLOCKS:
                self._flush()
            self._dropping -= drops
            self._inside -= marks
            self._links -= tag == "a"
            self._headings -= tag in HEADINGS
            self._pre -= tag == "pre"
            self._open[tag] -= 1
            if box:
                own = self.boxes[box]
                own.end = self._size
                up = self.boxes[own.parent]
                up.controls += own.controls
                up.marks |= own.marks
                up.headline |= own.headline
                self._box = own.parent
        del self._stack[n:]

    def _add(self, piece: str) -> None:
        if piece and not self._dropping:
            piece = references.unescape(piece)
            self._text.append(piece)
            if self._links:
                self._linked += len(piece.strip())

    def _start(self, tag: str, source: str) -> None:
        a = attributes(source) if source else {}
        role = a.get("role", "").lower()
        drops = tag in DROPPED or tag not in ("html", "body") and ("hidden" in a or a.get("aria-hidden") == "true")
        marks = not drops and not self._dropping and (tag in ("article", "main") or role == "main")
        box = 0
        if tag in BLOCKS and not self._dropping and not drops:
            inside = self._inside > 0
            # A page's own header is furniture, an article's header holds its headline.
            kind = tag in KINDS or tag == "header" and not inside or role in ROLES
            looks = FURNITURE if kind else 1
            if not kind and not self._pre and tag not in ("html", "body", "main") and (tag != "article" or inside):
                looks = max((named(n, inside) for n in f"{a.get('class', '')} {a.get('id', '')}".split()), default=1)
            box = len(self.boxes)
            self.boxes.append(Box(self._box, looks, kind, self._size))
            self._box = box
            if marks and not self._marked:
                self._marked = self.boxes[box].marks = True
            if tag == "h1" and not self._headed:
                self._headed = self.boxes[box].headline = True
        if tag in CONTROLS:
            self.boxes[self._box].controls += 1
        self._stack.append((tag, drops, marks, box))
        self._open[tag] += 1
        self._dropping += drops
        self._inside += marks
        self._links += tag == "a"
        self._headings += tag in HEADINGS
        self._pre += tag == "pre"

    def _read(self, page: str) -> None:
        at, stack = 0, self._stack
        while at < len(page):
            m = TOKEN.search(page, at)
            if not m:
                self._add(page[at:])
                break
            self._add(page[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag, source = m[2].lower(), m[3]
            if m[1]:
                if self._open[tag]:
                    n = len(stack) - 1
                    while stack[n][0] != tag:
                        n -= 1
                    self._pop(n)
                elif tag in BLOCKS:
                    self._flush()
                continue
            if tag == "br":
                self._add(" ")
                continue
            if tag in BLOCKS:
                ends = SIBLINGS.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
                if any(self._open[e] for e in ends):
                    for n in range(len(stack) - 1, -1, -1):
                        if stack[n][0] in ends:
                            self._pop(n)
                            break
                        if stack[n][0] in BLOCKS:
                            break
                self._flush()
            if tag in VOID or source.rstrip().endswith("/") and tag not in BLOCKS and tag not in RAW:
                if tag == "input" and 'type="hidden"' not in source.lower():
                    self.boxes[self._box].controls += 1
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
                if tag == "textarea":
                    self.boxes[self._box].controls += 1
                continue
            self._start(tag, source)

    def furniture(self) -> list[tuple[int, int]]:
        """For each box (the outermost box of furniture that it is in, what that takes from its weight); (0, 1) outside of any."""
        whole, out = self.boxes[0].end, [(0, 1)]
        for i, b in enumerate(self.boxes[1:], 1):
            size, looks = b.end - b.start, b.looks
            if looks == 1 and b.controls and size <= CONTROL_TEXT * b.controls and not b.marks:
                looks = FURNITURE
            if looks > 1:
                most = 2 * size > whole
                wraps = b.marks if self._marked else most and (b.headline or not b.is_kind and not self._headed)
                looks = 1 if wraps else looks
            box, taken = out[b.parent]
            out.append((box, max(taken, looks)) if box else (i, looks) if looks > 1 else (0, 1))
        return out


def weight_of(line: Line, marked: bool) -> int:
    """What a line brings to the distribution of the text."""
    own = len(line.text) if line.heading else 0 if 2 * line.linked > len(line.text) else len(line.text) - line.linked
    if line.inside:
        return MARKED * own
    return max(0, own - OUTSIDE) // 2 if marked else own


def peak(weight: list[float], window: int) -> float:
    return max((sum(weight[i : i + window]) for i in range(len(weight))), default=0)


def surge_and_dive(lines: list[Line], weight: list[float], window: int, surge: float, marked: bool) -> tuple[int, int] | None:
    """[start, end) from the first surge to the last dive; None without a surge."""
    sums = [sum(weight[i : i + window]) for i in range(len(weight))]
    start = next((i for i, s in enumerate(sums) if s >= surge and weight[i]), None)
    if start is None:
        return None
    while marked and start and weight[start - 1] and lines[start - 1].inside:
        start -= 1
    end = max(i for i, w in enumerate(weight) if w) + 1
    if marked:
        lead = next((i for i in range(start, 0, -1) if weight[i - 1]), 0)
        start = lead if start - lead < window else start
        if lines[end - 1].heading or len(weight) - end < window:
            end = len(weight)
    return start, end


def main_text(page: str | None, window: int = WINDOW, surge: float = SURGE, share: float = SHARE) -> str:
    """The article's blocks, one a line."""
    read = Page(page) if page else None
    if read is None or not read.lines:
        return ""
    places, marked = read.furniture(), any(x.inside for x in read.lines)
    own: list[tuple[Line, float]] = []
    boxes: dict[int, list[tuple[int, Line, float]]] = {}
    for i, x in enumerate(read.lines):
        box, taken = places[x.box]
        if box:
            boxes.setdefault(box, []).append((i, x, weight_of(x._replace(inside=False), False) / taken))
    high = peak([weight_of(x, marked) for x in read.lines if not places[x.box][0]], window)
    stays = {b for b, rows in boxes.items() if peak([w for _, _, w in rows], window) >= max(surge, high / share)}
    for x in read.lines:
        box, taken = places[x.box]
        if not box:
            w = weight_of(x, marked)
            # Beside a mark, lines without weight are nobody's.
            if x.inside or w or not marked:
                own.append((x, w))
        elif box in stays:
            own.append((x, weight_of(x._replace(inside=False), False) / taken))
    lines, weight = [x for x, _ in own], [w for _, w in own]
    found = surge_and_dive(lines, weight, window, surge, marked) or surge_and_dive(lines, weight, window, 1e-9, marked)
    return "\n".join(x.text for x in lines[found[0] : found[1]]) if found else ""


@arrow_function("string")
def extract(page: pa.Array) -> pa.Array:
    return pa.array([main_text(x) for x in page.to_pylist()], pa.string())


def op10_html_extraction(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    bounded_batches(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", "url", extract("html").alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))
