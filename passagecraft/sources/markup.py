"""HTML documents to text: a tree of the standard library's parser, then headings, paragraphs, lists and tables in order."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Void elements, elements that are not content, and elements that carry text.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CHROME = frozenset("script style nav footer header aside".split())
_LEVEL = {"h1": 1, "h2": 2, "h3": 3, "h4": 4}
_TEXT = frozenset([*_LEVEL, "p", "li", "table", "blockquote"])

#: An ampersand, with the name behind it if a semicolon ends that; numbers that one ends are left out.
_AMPERSAND = re.compile(r"&(?!#[0-9]+;|#[xX][0-9a-fA-F]+;)([A-Za-z][A-Za-z0-9]*;)?")


class Node:
    """An element, or with ``text`` a piece of text."""

    __slots__ = ("children", "name", "parent", "text")

    def __init__(self, name: str, parent: Node | None, text: str = ""):
        self.name, self.parent, self.text, self.children = name, parent, text, []
        if parent is not None:
            parent.children.append(self)

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += reversed(node.children)

    def first(self, name: str) -> Node | None:
        return next((n for n in self.walk() if n.name == name), None)

    def inside(self, name: str) -> bool:
        node = self.parent
        while node is not None and node.name != name:
            node = node.parent
        return node is not None

    def words(self) -> str:
        """All pieces of text below without white space at their ends, joined by a space; what is inside a piece stays as it is."""
        return " ".join(t for n in self.walk() if n.name == "#" and (t := n.text.strip()))

    def cells(self) -> Iterator[str]:
        for row in self.walk():
            if row.name == "tr" and (cells := [c.words() for c in row.walk() if c.name in ("th", "td")]):
                yield " | ".join(cells)


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.here = Node("#root", None)
        self.meta: dict[str, str] = {}

    def handle_starttag(self, tag, attrs):
        node = Node(tag, self.here)
        if tag == "meta":
            values = dict(attrs)
            if values.get("name") and values.get("content"):
                self.meta[values["name"]] = values["content"]
        if tag not in _VOID:
            self.here = node

    def handle_startendtag(self, tag, attrs):
        before = self.here
        self.handle_starttag(tag, attrs)
        self.here = before

    def handle_endtag(self, tag):
        node = self.here
        while node is not self.root and node.name != tag:
            node = node.parent
        if node is not self.root:
            self.here = node.parent

    def handle_data(self, data):
        last = self.here.children[-1] if self.here.children else None
        if self.here.name in ("script", "style"):
            return
        if last is not None and last.name == "#":
            last.text += data
        else:
            Node("#", self.here, data)

    def apart(self, data):
        """Comments and the like are no text, but part the pieces beside them."""
        Node("#apart", self.here)

    handle_comment = handle_decl = handle_pi = unknown_decl = apart


def parse(page: str, open_references: bool = True) -> tuple[str, dict[str, str]]:
    """Text and metadata of a page: the main element, else the body, else all of it, without chrome.

    As browsers do, references that no semicolon ends (``&amp``) are decoded, too; without ``open_references`` they are text.
    """
    tree = _Tree()
    tree.feed(page if open_references else _AMPERSAND.sub(lambda m: m[0] if m[1] in html5 else f"&amp;{m[1] or ''}", page))
    tree.close()
    meta = dict(tree.meta)
    title = tree.root.first("title")
    if title is not None and len(title.children) == 1 and title.children[0].text.strip():
        meta.setdefault("title", title.children[0].text.strip())
    for node in list(tree.root.walk()):
        if node.name in _CHROME and node.parent is not None:
            node.parent.children.remove(node)
    root = tree.root.first("main") or tree.root.first("body") or tree.root
    lines = []
    for node in root.walk():
        if node.name not in _TEXT or node.name != "table" and node.inside("table"):
            continue
        if node.name == "table":
            rows = "\n".join(node.cells())
            line = f"\n{rows}\n" if rows else ""
        elif node.name in _LEVEL:
            line = f"\n{'#' * _LEVEL[node.name]} {node.words()}\n"
        else:
            line = f"- {node.words()}" if node.name == "li" else node.words()
        if line.strip():
            lines.append(line)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip(), meta


_READ = T.StructType([T.StructField("text", T.StringType()), T.StructField("meta", T.MapType(T.StringType(), T.StringType()))])


def read(page: Column | str, open_references: bool = True) -> Column:
    """parse() on a column; a null page is an empty one."""

    @F.arrow_udf(_READ)
    def run(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("text", pa.string()), ("meta", pa.map_(pa.string(), pa.string()))])
        for batch in pages:
            made = (parse(p.as_py() or "", open_references) for p in batch)
            yield pa.array([{"text": t, "meta": list(m.items())} for t, m in made], kind)

    return run(page)
