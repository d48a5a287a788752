"""Leaf blocks of a page, for documents that have no article element."""

from __future__ import annotations

from .dom import Node, body_of, parse

BLOCKS = frozenset("div p h1 h2 h3 h4 h5 h6 li blockquote pre figure section article ul ol".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Class names of pictures that are no content, and the least size of one that is.
DECORATION, LEAST_PIXELS = ("emoji", "reaction", "sticker", "icon", "avatar"), 80


def _picture(img: Node) -> tuple[str, str] | None:
    """The address of a picture that is content."""
    sizes = (img.get("width") or "", img.get("height") or "")
    tiny = any(s.isdigit() and 0 < int(s) < LEAST_PIXELS for s in sizes)
    names = (img.get("class") or "").lower()
    src = img.get("src") or img.get("data-src") or ""
    usable = src and not src.startswith("data:") and not tiny and not any(d in names for d in DECORATION)
    return ("image", src) if usable else None


def _kind(node: Node) -> str:
    """What a leaf is: a heading's tag, item, quote, code or text; a heading inside makes it one."""
    heading = node if node.tag in HEADINGS else node.find(*HEADINGS)
    if heading is not None:
        return heading.tag
    names = node.get("class") or ""
    tests = (("item", node.tag == "li"), ("quote", node.tag == "blockquote" or "quote" in names), ("code", node.tag == "pre" or "code" in names))
    return next((kind for kind, holds in tests if holds), "text")


def leaf_blocks(html: str | None) -> list[tuple[str, str]]:
    """(kind, text or address) of pictures, captions and leaf blocks in document order, as they stand: repeats and boilerplate included."""
    found: list[tuple[str, str] | None] = []
    waiting = body_of(parse(html or "")).elements()[::-1]
    while waiting:
        node = waiting.pop()
        inside = node.elements()
        framed = node.tag == "figure" or "image" in (node.get("class") or "")
        if node.tag == "img":
            found.append(_picture(node))
        elif framed:
            pictures = [_picture(x) for x in [node.find("img")] if x is not None]
            captions = [("caption", x.text_content().strip()) for x in [node.find("figcaption")] if x is not None]
            found += pictures + captions
        elif any(x.tag in BLOCKS for x in inside):
            waiting += inside[::-1]
        else:
            found += [_picture(x) for x in node.walk() if x.tag == "img"]
            found.append((_kind(node), node.text_content().strip()))
    return [x for x in found if x is not None]
