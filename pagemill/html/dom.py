"""A small tolerant document tree on the standard library's tokenizer."""

from __future__ import annotations

from html import escape
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style"))
#: An opening tag that closes an open one of the same kind of place.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
_BLOCKS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


class Node:
    """An element, or with ``tag`` None a piece of text."""

    __slots__ = ("attrs", "children", "parent", "tag", "text")

    def __init__(self, tag: str | None, attrs: dict[str, str] | None = None, text: str = ""):
        self.tag, self.attrs, self.text = tag, attrs or {}, text
        self.children: list[Node] = []
        self.parent: Node | None = None

    def append(self, child: Node) -> Node:
        child.parent = self
        self.children.append(child)
        return child

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children.remove(self)
            self.parent = None

    def elements(self) -> list[Node]:
        return [c for c in self.children if c.tag is not None]

    def walk(self):
        """Descendant elements in document order, without recursion."""
        stack = self.elements()[::-1]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(node.elements()[::-1])

    def find(self, *tags: str) -> Node | None:
        return next((n for n in self.walk() if n.tag in tags), None)

    def text_content(self) -> str:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if node.tag is None:
                out.append(node.text)
            stack.extend(node.children[::-1])
        return "".join(out)

    def get(self, name: str) -> str | None:
        return self.attrs.get(name)

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def inner_html(self) -> str:
        return "".join(c.outer_html() for c in self.children)

    def outer_html(self) -> str:
        if self.tag is None:
            return self.text if self.parent is not None and self.parent.tag in RAW else escape(self.text, quote=False)
        attrs = "".join(f' {k}="{escape(v)}"' for k, v in self.attrs.items())
        return f"<{self.tag}{attrs}>" + ("" if self.tag in VOID else f"{self.inner_html()}</{self.tag}>")


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#document")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "head", "body") and any(n.tag == tag for n in self.open):
            return
        if tag in _BLOCKS:
            self._close({"p"}, {"button", "td", "th", "li", "body", "div", "article", "section", "blockquote"} - {tag})
        if tag in _CLOSES:
            self._close(*_CLOSES[tag])
        node = self.open[-1].append(Node(tag, {k: v or "" for k, v in reversed(attrs)}))
        if tag not in VOID and len(self.open) < 400:
            self.open.append(node)

    handle_startendtag = handle_starttag

    def _close(self, tags, stop):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in stop:
                return
            if self.open[i].tag in tags:
                del self.open[i:]
                return self._close(tags, stop)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].append(Node(None, text=data))


def parse(html: str) -> Node:
    """The tree of a document; a fragment is put in a body first."""
    builder = _Builder()
    builder.feed(html if "<html" in html else f"<html><head></head><body>{html}</body></html>")
    builder.close()
    return builder.root


def body_of(document: Node) -> Node:
    return document.find("body") or document.find("html") or document


def title_of(document: Node) -> str:
    node = document.find("title")
    return " ".join(node.text_content().split()) if node else ""
