"""One platform's article pages, rebuilt on the tree: title, author, time and content; code snippets as ``pre``."""

from __future__ import annotations

import re

from .dom import Node, parse, title_of
from .select import select

#: Lines that a style sheet's counter leaves in snippets.
_COUNTER = re.compile(r"[ce]?ounter\(line")


def element(tag: str, text: str = "", children: list[Node] = (), **attrs: str) -> Node:
    node = Node(tag, {k.replace("_", "-"): v for k, v in attrs.items()})
    for child in [Node(None, text=text)] * bool(text) + list(children):
        node.append(child)
    return node


def replace(old: Node, new: Node) -> None:
    """Put ``new`` where ``old`` is."""
    parent = old.parent
    parent.children[parent.children.index(old)] = new
    old.parent, new.parent = None, parent


def snippets_as_pre(tree: Node) -> bool:
    """Code boxes as ``pre`` and ``code``, without line numbers; whether there were any."""
    boxes = [x for x in select(tree, "[class*=code-snippet__fix]") if x.tag in ("section", "div")]
    for box in boxes:
        language = next((x.get("data-lang") for x in [*box.walk(), box] if x.get("data-lang")), "")
        for number in select(box, "[class*=code-snippet__line-index]"):
            number.remove()
        lines = [x.text_content() for x in box.walk() if x.tag == "code"]
        text = "\n".join(x for x in lines if not _COUNTER.match(x)) if lines else box.text_content().strip()
        code = element("code", text.replace("\xa0", " "))
        replace(box, element("pre", children=[code], data_lang=language))
    return bool(boxes)


def _said(tree: Node, selector: str, attribute: str | None = None) -> str:
    """The text, or an attribute, of the first match, in one line."""
    node = next(iter(select(tree, selector)), None)
    if node is None:
        return ""
    return " ".join(((node.get(attribute) or "") if attribute else node.text_content()).split())


def article(html: str) -> str:
    """The rebuilt page; one without snippets and without an article's content stays as it is."""
    tree = parse(html)
    changed = snippets_as_pre(tree)
    content = next(iter(select(tree, "#js_content")), None)
    if content is None:
        return tree.inner_html() if changed else html
    for img in select(content, "img[data-src]"):
        img.attrs["src"] = img.attrs["data-src"] or img.attrs.get("src", "")
    title = _said(tree, "#activity-name") or _said(tree, "meta[property='og:title']", "content") or title_of(tree)
    author, time = _said(tree, "#js_name"), _said(tree, "[data-wechat-meta='publish_time']")
    lines = [element("h1", title)] * bool(title)
    lines += [element("p", f"作者: {author}", data_wechat_meta="author")] * bool(author)
    lines += [element("p", time, data_wechat_meta="publish_time")] * bool(time)
    body = element("article", children=[*lines, *content.children], data_adapter="wechat")
    page = element("html", children=[element("head", children=[element("title", title)]), element("body", children=[body])])
    return page.outer_html()
