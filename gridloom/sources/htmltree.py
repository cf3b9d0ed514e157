"""A tolerant HTML tree: the parts of the public HTML parsing rules that decide text order and table structure.

Unclosed cells and rows close each other, implied rows and bodies appear, a table inside a cell nests, a table
directly inside a table ends it, and stray content of a table moves before it. No recursion: depth is unbounded.
"""

from __future__ import annotations

import html
import html.entities
import re
import sys
from collections.abc import Iterator
from html.parser import HTMLParser
from types import MappingProxyType

VOID = frozenset("area base br col embed hr img input link meta param source track wbr keygen basefont bgsound frame".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
IN_HEAD = frozenset("title style script meta link base noscript template basefont bgsound".split())
#: Start tags that end an open paragraph.
ENDS_P = HEADINGS | frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header hgroup hr li dd dt main menu nav ol p pre listing search section summary table ul".split())
TABLE_PARTS = frozenset(("caption", "colgroup", "col", "tbody", "thead", "tfoot", "tr", "td", "th"))
SECTIONS = frozenset(("tbody", "thead", "tfoot"))
FOSTERS = SECTIONS | {"table", "tr"}
#: An end tag never reaches past these.
FENCES = frozenset(("td", "th", "caption", "table", "#root"))
REFERENCE = re.compile(r"&(?:(#[0-9]+;|#[xX][0-9a-fA-F]+;)|([A-Za-z][A-Za-z0-9]*;))?")
#: Of all nodes without attributes.
NO_ATTRS = MappingProxyType({})


class Node:
    """An element, or text (name '#text') or a comment ('#comment')."""

    __slots__ = ("attrs", "children", "name", "parent", "text")

    def __init__(self, name: str, attrs: dict[str, str] | None = None, text: str = ""):
        self.name, self.attrs, self.text = name, attrs or NO_ATTRS, text
        self.children: list[Node] | tuple[()] = ()  # a list with the first child
        self.parent: Node | None = None

    def add(self, node: Node, before: Node | None = None) -> Node:
        node.parent = self
        if not self.children:
            self.children = [node]
        elif before is None:
            self.children.append(node)
        else:
            self.children.insert(next(i for i, c in enumerate(self.children) if c is before), node)
        return node

    def walk(self) -> Iterator[Node]:
        """This node and all below it, in document order."""
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo.extend(reversed(n.children))

    def strings(self) -> Iterator[str]:
        return (n.text for n in self.walk() if n.name == "#text")

    def joined(self) -> str:
        """Stripped, non-empty strings below, joined by a space."""
        return " ".join(t for s in self.strings() if (t := s.strip()))

    def ancestor(self, *names: str) -> Node | None:
        n = self.parent
        while n is not None and n.name not in names:
            n = n.parent
        return n

    def release(self) -> None:
        """Give the tree's memory back at once: nodes and parents hold each other."""
        for n in self.walk():
            n.parent = None

    def first(self, *names: str) -> Node | None:
        return next((n for n in self.walk() if n.name in names), None)


class Builder(HTMLParser):
    RCDATA_CONTENT_ELEMENTS = ("textarea", "title")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.stack = [self.root]
        self.amp = "&"  # what stands for an ampersand that is no reference

    def _plain(self, s: str) -> str:
        return s if self.amp == "&" else s.replace(self.amp, "&")

    # placing

    def _place(self, node: Node) -> Node:
        top = self.stack[-1]
        if top.name in FOSTERS and not (node.name == "#comment" or node.name == "#text" and not node.text.strip()):
            if node.name in TABLE_PARTS or node.name in ("script", "style", "template"):
                return top.add(node)
            table = next(n for n in reversed(self.stack) if n.name == "table")
            return table.parent.add(node, before=table)
        return top.add(node)

    def _open(self, name: str, attrs: dict[str, str] | None = None) -> None:
        self.stack.append(self._place(Node(name, attrs)))

    def _has(self, names: frozenset[str] | tuple[str, ...], fences: frozenset[str] = FENCES) -> bool:
        for n in reversed(self.stack):
            if n.name in names:
                return True
            if n.name in fences:
                return False
        return False

    def _pop(self, names: frozenset[str] | tuple[str, ...]) -> None:
        while self.stack[-1].name not in names:
            self.stack.pop()
        self.stack.pop()

    def _back_to(self, names: frozenset[str] | tuple[str, ...]) -> None:
        while self.stack[-1].name not in names and self.stack[-1].name != "#root":
            self.stack.pop()

    def _in_table(self) -> bool:
        return any(n.name == "table" for n in self.stack)

    # tokens

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        tag = sys.intern(self._plain(tag))
        given = {self._plain(k): self._plain(v) if v is not None else "" for k, v in reversed(attrs)}
        if tag in ("html", "body"):
            self._leave_head()
            if tag == "body" and (b := self.root.first("body")) is None:
                self._open("body", given)
            return
        if tag == "head":
            if self.root.first("head") is None and self.root.first("body") is None:
                self._open("head", given)
            return
        if tag in IN_HEAD and len(self.stack) == 1 and not any(c.name[0] != "#" or c.name == "#text" and c.text.strip() for c in self.root.children):
            self._open("head")  # implied: nothing to read has come yet
        if self.stack[-1].name == "head" and tag not in IN_HEAD:
            self._leave_head()
        if tag in TABLE_PARTS:
            self._table_part(tag, given)
            return
        if tag == "table":
            if self.stack[-1].name in FOSTERS:  # directly inside a table: that one ends
                self._pop(("table",))
            elif self._has(("p",)):
                self._pop(("p",))
            self._open(tag, given)
            return
        if tag in ENDS_P and self._has(("p",)):
            self._pop(("p",))
        if tag in HEADINGS and self.stack[-1].name in HEADINGS:
            self.stack.pop()
        if tag == "li":
            self._end_item(("li",))
        elif tag in ("dd", "dt"):
            self._end_item(("dd", "dt"))
        elif tag in ("option", "optgroup") and self.stack[-1].name == "option":
            self.stack.pop()
        if tag in VOID:
            self._place(Node("img" if tag == "image" else tag, given))
        else:
            self._open(tag, given)

    def _leave_head(self) -> None:
        if any(n.name == "head" for n in self.stack):
            self._pop(("head",))

    def _end_item(self, names: tuple[str, ...]) -> None:
        for n in reversed(self.stack):
            if n.name in names:
                self._pop(names)
                return
            if n.name in FENCES or n.name in ("ul", "ol", "dl", "section", "article", "blockquote", "body"):
                return

    def _table_part(self, tag: str, attrs: dict[str, str]) -> None:
        if not self._in_table():
            return
        if self._has(("td", "th", "caption"), frozenset(("table",))):
            self._pop(("td", "th", "caption"))
        if tag in ("td", "th"):
            self._back_to(("tr", *SECTIONS, "table"))
            if self.stack[-1].name == "table":
                self._open("tbody")
            if self.stack[-1].name in SECTIONS:
                self._open("tr")
        elif tag == "tr":
            self._back_to((*SECTIONS, "table"))
            if self.stack[-1].name == "table":
                self._open("tbody")
        elif tag == "col":
            self._back_to(("colgroup", "table"))
            self.stack[-1].add(Node("col", attrs))
            return
        else:
            self._back_to(("table",))
        self._open(tag, attrs)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash means nothing outside void elements

    def handle_endtag(self, tag: str) -> None:
        tag = self._plain(tag)
        if tag in ("html", "body"):
            return
        if tag == "head":
            self._leave_head()
        elif tag == "br":
            self._place(Node("br"))
        elif tag == "p" and not self._has(("p",)):
            self._place(Node("p"))
        elif tag in HEADINGS:
            if self._has(HEADINGS):
                self._pop(HEADINGS)
        elif tag == "table":
            if self._in_table():
                self._pop(("table",))
        elif tag in SECTIONS or tag in ("tr", "td", "th", "caption"):
            if self._has((tag,), frozenset(("table", "#root"))):
                self._pop((tag,))
        elif tag not in VOID and self._has((tag,)):
            self._pop((tag,))

    def handle_data(self, data: str) -> None:
        top = self.stack[-1]
        if top.name == "head" and data.strip():
            self._leave_head()
        if data:
            self._place(Node("#text", text=self._plain(data)))

    def handle_comment(self, data: str) -> None:
        self.stack[-1].add(Node("#comment", text=self._plain(data)))

    def unknown_decl(self, data: str) -> None:
        self.handle_comment(data)

    def handle_pi(self, data: str) -> None:
        self.handle_comment("?" + data)


def open_amp(m: re.Match) -> bool:
    """Whether an ampersand begins no reference that a semicolon ends."""
    return not (m[1] or m[2] and m[2] in html.entities.html5)


def parse_tree(text: str, closed_refs: bool = False) -> Node:
    """``closed_refs``: character references count only with their semicolon; by HTML's rules some names do without."""
    b = Builder()
    text = text or ""
    if closed_refs and any(open_amp(m) for m in REFERENCE.finditer(text)):
        b.amp = next(c for c in map(chr, range(0xFDD0, 0xFDF0)) if c not in text)  # no characters, but allowed in strings
        text = REFERENCE.sub(lambda m: b.amp + m[0][1:] if open_amp(m) else m[0], text)
    b.feed(text)
    b.close()
    return b.root


def body_of(root: Node) -> Node:
    """What a walk of the document covers: the body where a tag opened one, else all (a head is skipped anyway)."""
    body = root.first("body")
    return body if body is not None and not any(c.name not in ("head", "body", "#text", "#comment") or c.name == "#text" and c.text.strip() for c in root.children) else root


def serialize(root: Node) -> str:
    """The tree as HTML; raw-text elements as they are, other text escaped."""
    out: list[str] = []
    todo: list[Node | str] = [root]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.name == "#text":
            out.append(n.text if n.parent is not None and n.parent.name in ("script", "style") else html.escape(n.text, quote=False))
        elif n.name == "#comment":
            out.append(f"<!--{n.text}-->")
        else:
            if n.name != "#root":
                out.append("<" + n.name + "".join(f' {k}="{html.escape(v)}"' for k, v in n.attrs.items()) + ">")
                if n.name in VOID:
                    continue
                todo.append(f"</{n.name}>")
            todo.extend(reversed(n.children))
    return "".join(out)
