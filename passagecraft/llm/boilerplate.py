"""Main text of web pages by the distribution of text over lines.

A page becomes lines, one for each block of its markup, with empty lines where containers begin or end. The length of a
line is the number of its characters outside of links, less where the markup speaks against it: text around a marked
article counts a twentieth, and what stands in headers, footers, adverts, notices and the like an eighth, and so much at most
that no window of it can surge. Nothing is left out for that: lengths are summed up over a sliding window of lines, text begins where that sum surges, and ends where it
dives to nothing. What lies between is kept, but for blocks in it that are marked and whose own sums never surge.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lines in a window. The least sum of lengths that counts as a surge: measured, no block around an article of 12,000
#: pages has over 135 characters, and 98 of 100 articles have a window of more than 160.
WINDOW = 3
SURGE = 160
#: What a character counts: beside a marked article; in a block with one mark of its name; in a block that is marked.
BESIDE, SOME, LITTLE, NONE = 0.05, 0.6, 0.125, 0.0
#: Lines of marked blocks count so much at most that a window of them can't surge, however long they are.
MOST = SURGE / (WINDOW + 1)
#: Marked elements around an element that are looked at; one more says nothing new.
DEEPEST = 64
#: Tags of a page whose quotes may be open up to its end; further ones end at their first >, so that work is linear in a page.
UNBALANCED = 64

# Elements without text; elements that begin a line; what surrounds an article, by element, role and words of class and id.
_NO_TEXT = frozenset("title button select option textarea input label datalist menu noscript template iframe svg canvas object audio video map".split())
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
_LANDMARK = frozenset("article aside dialog footer form header main nav search".split())
_CONTAINER = _LANDMARK | frozenset("body center details div dl fieldset ol section table ul".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose end may be left out, and what ends a paragraph without saying so; lists keep their items to themselves.
_OPTIONAL = frozenset("p li dt dd".split())
_ENDS_P = _BLOCK - frozenset("br caption legend".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BY_NAME = {"nav": NONE, "aside": NONE, "form": NONE, "dialog": NONE, "search": NONE, "footer": LITTLE, "header": LITTLE}
_BY_ROLE = dict.fromkeys("alert alertdialog banner contentinfo".split(), LITTLE) | dict.fromkeys("complementary dialog form menu menubar navigation search toolbar".split(), NONE)
_COMMENTS = frozenset("comment comments commentlist replies respond disqus".split())
_BY_WORD = dict.fromkeys(_COMMENTS, NONE) | dict.fromkeys("breadcrumb breadcrumbs dialog menu modal nav navbar navigation pager pagination search sidebar toolbar".split(), NONE)
_BY_WORD |= dict.fromkeys(
    "ad ads advert adverts advertisement advertising adsense banner consent cookie cookies footer footnav gdpr header login masthead newsletter notice notices notification popup promo promoted promotion related share sharing signup skip social sponsor sponsored subscribe widget widgets".split(),
    LITTLE,
)
#: Elements of running text: in an article such a name must be one of the block's kind through and through, and none that prose is named by, too.
_RUNNING = _HEADING | frozenset("p li blockquote figcaption pre td th dd dt".split())
_PROSE = frozenset("banner dialog footer header login menu notice notices notification promotion related search social widget".split())
#: A word after one of these says that the element holds such a block, not that it is one.
_HOLDS = frozenset("has with no is not without show hide".split())

_OPEN = re.compile(r"<(?:(?P<comment>!--)|[!?]|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*))")
#: The rest of a tag, where what is quoted may have a > in it.
_REST = re.compile(r"[^>\"']*+(?:\"[^\"]*\"[^>\"']*+|'[^']*'[^>\"']*+)*+>")
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style")}
_A = re.compile(r"<(/?)a(?=[\s/>])", re.I)
_HREF = re.compile(r"(?:^|[\s\"'])href\s*=", re.I)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)


@dataclass
class Line:
    """A block's text, its characters outside of links, whether it stands in an article, whether it is a heading, and its marks."""

    text: str = ""
    plain: int = 0
    article: bool = False
    heading: bool = False
    marks: tuple[int, ...] = ()


@dataclass
class Mark:
    """What markup says about an element: what its characters count, and whether it holds an article, after all."""

    counts: float
    comments: bool = False
    whole: bool = False  # the last word of a name says it, so headings in it are no exception
    sure: bool = False  # an element that is never a wrapper of the page
    article: bool = False


def mark_of(name: str, attrs: str, inside: bool) -> Mark | None:
    """How an element is marked; inside: it stands in an article, where a header has its headline."""
    if name in ("html", "body", "main"):
        return None
    found = Mark(_BY_NAME[name], whole=True, sure=name != "form") if name in _BY_NAME and not (name == "header" and inside) else None
    if "=" not in attrs:
        return found
    for key, *values in _ATTR.findall(attrs):
        value = "".join(values).lower()
        if key.lower() == "role":
            said = [Mark(_BY_ROLE[r], whole=True) for r in value.split() if r in _BY_ROLE]
        else:
            said = []
            for token in value.split():
                parts = re.split(r"[-_]+", token)
                if inside and name in _RUNNING and not (all(w in _BY_WORD for w in parts) and not _PROSE.issuperset(parts)):
                    continue
                comments = bool(_COMMENTS.intersection(parts)) and not _HOLDS.intersection(parts)
                if parts[-1] in ("header", "footer") and (inside or len(parts) > 1 and parts[0] not in ("site", "page", "main", "top")):
                    continue
                if parts[-1] in _BY_WORD and not _HOLDS.intersection(parts):
                    said.append(Mark(_BY_WORD[parts[-1]], comments, True))
                elif comments:
                    said.append(Mark(NONE, True, True))
                elif any(w in _BY_WORD for w in parts):
                    said.append(Mark(SOME))
        for m in said:
            if name == "article" and not m.comments:
                continue
            if found is None or m.counts < found.counts or m.comments:
                found = m
    return found


def _boxed(name: str) -> bool:
    return name not in ("div", "address") and name not in _OPTIONAL


class _Page:
    """The blocks of a page as its tags come by: what is open, and the lines so far."""

    def __init__(self) -> None:
        self.lines: list[Line] = []
        self.marks: list[Mark] = []
        self.open: list[tuple[str, int, tuple[int, ...]]] = []  # name, its mark or -1, all marks around and of it
        self.count: Counter[str] = Counter()
        self.boxes = self.mute = self.headings = self.empty = 0
        self.parts: list[str] = []
        self.plain = 0

    @property
    def inside(self) -> bool:
        return self.count["article"] + self.count["main"] > 0

    def flush(self) -> None:
        """Ends a line."""
        if text := " ".join("".join(self.parts).split()):
            self.lines.append(Line(text, min(self.plain, len(text)), self.inside, self.headings > 0, self.open[-1][2] if self.open else ()))
            self.empty = 0
        self.parts.clear()
        self.plain = 0

    def gap(self, name: str) -> None:
        """Empty lines at an end of a container that is not in an article; more than a window of them say no more."""
        if name in _CONTAINER and not self.inside:
            n = min(WINDOW if name in _LANDMARK else 2, WINDOW - self.empty)
            self.lines += [Line() for _ in range(n)]
            self.empty += n

    def pop(self) -> str:
        name = self.open.pop()[0]
        self.count[name] -= 1
        self.boxes -= _boxed(name)
        self.mute -= name in _NO_TEXT
        self.headings -= name in _HEADING
        self.gap(name)
        return name

    def end(self, name: str) -> None:
        """Closes the last element of the name and all in it, if there is one."""
        if self.count[name]:
            while self.pop() != name:
                pass

    def make_way(self, name: str) -> None:
        """Closes the paragraph or item that a block of the name ends as it starts."""
        if name in _ENDS_P and self.open and self.open[-1][0] == "p":
            self.pop()
        if name in _OPTIONAL and name != "p":
            same = ("li",) if name == "li" else ("dt", "dd")
            for k in range(len(self.open) - 1, -1, -1):
                if not any(self.count[x] for x in same):
                    break
                if self.open[k][0] in same:
                    self.end(self.open[k][0])
                if k >= len(self.open) or _boxed(self.open[k][0]):
                    break

    def start(self, name: str, mark: Mark | None) -> None:
        self.gap(name)
        around = self.open[-1][2] if self.open else ()
        if name in ("article", "main") and not (mark and mark.comments):
            for k in around:
                self.marks[k].article = True
        if mark and len(around) >= DEEPEST:
            mark = None
        if mark:
            around = (*around, len(self.marks))
            self.marks.append(mark)
        self.open.append((name, len(self.marks) - 1 if mark else -1, around))
        self.count[name] += 1
        self.boxes += _boxed(name)
        self.mute += name in _NO_TEXT
        self.headings += name in _HEADING


def tags_of(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, whether it ends an element, its rest) of each tag, in order; what has no text, as comments and scripts, has no name."""
    last, at, unbalanced = page.rfind(">"), 0, 0
    while m := _OPEN.search(page, at):
        start, name, rest = m.start(), (m["name"] or "").lower(), ""
        if m["comment"]:
            end = page.find("-->", m.end())
            at = end + 3 if end >= 0 else len(page)
        elif start > last:  # nothing closes a tag here, so only a comment can begin
            at = page.find("<!--", start)
            if at < 0:
                return
            continue
        elif name in _RAW_END and not m["end"]:
            end = _RAW_END[name].search(page, page.index(">", start) + 1)
            name, at = "", end.end() if end else len(page)
        else:
            whole = _REST.match(page, m.end()) if name and unbalanced < UNBALANCED else None
            unbalanced += whole is None and bool(name)
            at = whole.end() if whole else page.index(">", m.end()) + 1
            rest = page[m.end() : at]
        yield start, at, name, bool(m["end"]), rest


def lines_of(page: str) -> tuple[list[Line], list[Mark]]:
    """The lines of a page, one for each block with text and empty ones between containers, and the marks that they name."""
    p = _Page()
    links = 0  # 0: in no link; else more than the blocks that a link reaches over

    def text(piece: str) -> None:
        if p.mute:
            return
        if "&" in piece:
            piece = entities.unescape(piece)
        p.parts.append(piece)
        if not links:
            p.plain += len(piece)

    at = 0
    for start, stop, name, end, rest in tags_of(page):
        if start > at:
            text(page[at:start])
        at = stop
        if not name or name == "head":
            continue
        block = name in _BLOCK
        if end:
            if name == "a":
                links = 0
            if block or p.count[name]:
                p.flush()
                p.end(name)
        else:
            if block:
                p.flush()
                if name == "body":
                    while p.open:
                        p.pop()
                p.make_way(name)
            if name not in _VOID and not rest.endswith("/>"):
                mark = mark_of(name, rest, p.inside)
                if name == "a" and _HREF.search(rest):
                    # one that is never closed ends with the first block that starts or ends
                    closes = _A.search(page, at)
                    links = len(p.open) + 1 if closes and closes[1] else len(page)
                if block or mark or name in _NO_TEXT:
                    p.flush()
                    p.start(name, mark)
        # a link ends with the block that it stands in, if nothing else ends it
        if block and (links == len(page) or len(p.open) + 1 < links):
            links = 0
    if at < len(page):
        text(page[at:])
    p.flush()
    return p.lines, p.marks


def sums_of(lengths: Sequence[float], window: int = WINDOW) -> list[float]:
    """For each line the sum of lengths over the window that begins there."""
    return [sum(lengths[i : i + window]) for i in range(len(lengths))]


def between(lengths: Sequence[float], surge: float, window: int = WINDOW) -> list[bool]:
    """Which lines stand between a surge and the next dive of the sums over windows of lines."""
    keep, inside = [False] * len(lengths), False
    for i, total in enumerate(sums_of(lengths, window)):
        if not inside and total >= surge and lengths[i]:
            inside = True
        elif inside and not total:
            inside = False
        keep[i] = inside
    return keep


def weighed(lines: list[Line], marks: list[Mark]) -> tuple[list[float], list[int]]:
    """What each line counts, and the outermost mark that holds for it, or -1.

    A mark does not hold where its element has the article in it. On a page without one, it does not where a wrapper has
    over half of the text. Those of comments always hold.
    """
    marked = any(x.article and x.text and not any(marks[k].comments for k in x.marks) for x in lines)
    of, total = [0] * len(marks), 0
    for x in lines:
        total += x.plain
        for k in x.marks:
            of[k] += x.plain
    holds = [m.comments or not m.article and (marked or m.sure or 2 * n <= total) for m, n in zip(marks, of, strict=True)]
    lengths, outer = [], []
    for x in lines:
        held = [k for k in x.marks if holds[k] and not (x.heading and not marks[k].whole)]
        counts = min((marks[k].counts for k in held), default=1.0)
        here = x.article and not any(marks[k].comments for k in held)
        length = (len(x.text) if here else x.plain) * counts * (1.0 if here or not marked else BESIDE)
        lengths.append(min(length, MOST) if counts <= LITTLE else length)
        outer.append(held[0] if held else -1)
    return lengths, outer


def main_text(page: str | None, window: int = WINDOW, surge: float = SURGE) -> str:
    """The article's blocks, joined by one space."""
    lines, marks = lines_of(page or "")
    lengths, outer = weighed(lines, marks)
    # marked blocks within an article interrupt no window of it
    flow = [i for i, x in enumerate(lines) if not (x.article and outer[i] >= 0)]
    marked = any(x.article and n for x, n in zip(lines, lengths, strict=True))
    free = sums_of([lengths[i] if outer[i] < 0 and (lines[i].article or not marked) else 0.0 for i in flow], window)
    # a page with little text has its surge lower, but not for what stands beside a marked article
    least = min(surge, max(free, default=0.0) / 2) or surge
    scaled = [lengths[i] * (least / surge if marked and not lines[i].article else 1.0) for i in flow]
    keep = [False] * len(lines)
    for i, inside in zip(flow, between(scaled, least, window), strict=True):
        keep[i] = inside
    return _joined(lines, lengths, outer, flow, keep, window, surge)


def _joined(lines: list[Line], lengths: list[float], outer: list[int], flow: list[int], keep: list[bool], window: int, surge: float) -> str:
    """The text of the lines to keep, with what belongs to them, without marked blocks whose own sums never surge; those of adverts, notices and the like can't."""
    # up to the heading, or the first line of the article, that a surge came after
    for a, b in zip(reversed(flow[:-1]), reversed(flow[1:]), strict=True):
        if keep[b] and not keep[a] and lines[a].text and outer[a] < 0 and (lines[a].heading or lines[a].article):
            keep[a] = True
    kept = [i for i in flow if keep[i]]
    if not kept:
        return ""
    # short text between two parts that are kept, and what stands in an article without being part of its flow
    first, last = kept[0], kept[-1]
    while first and lines[first].article and lines[first - 1].article:
        first -= 1
    while last + 1 < len(lines) and lines[last].article and lines[last + 1].article:
        last += 1
    for i in range(first, last + 1):
        if not keep[i] and lines[i].text and (outer[i] < 0 and lengths[i] or lines[i].article):
            keep[i] = True
    at = 0
    while at < len(lines):
        end = at + 1
        if outer[at] >= 0:
            while end < len(lines) and outer[end] == outer[at]:
                end += 1
            if max(sums_of(lengths[at:end], window)) < surge:
                keep[at:end] = [False] * (end - at)
        at = end
    return " ".join(x.text for x, k in zip(lines, keep, strict=True) if k and x.text)


@F.arrow_udf(T.StringType())
def extract(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The main text of each page; empty for null, for an empty page and for one without an article.

    Pages are judged one by one, so repeated rows have equal texts. Very long pages take time in proportion to their length.
    """
    for batch in pages:
        yield pa.array([main_text(p.as_py()) for p in batch], pa.string())
