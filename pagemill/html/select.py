"""CSS selectors on the tree, and the XPath subset as selectors."""

from __future__ import annotations

import re
from functools import lru_cache

from .dom import Node


class SelectorError(ValueError):
    """A selector that cannot be read."""


class XPathError(ValueError):
    """A path outside the supported subset."""


_NAME = r"(?:[\w-]|[^\x00-\x7f]|\\.)+"
_TOKEN = re.compile(
    rf"(?P<tag>\*|{_NAME})|#(?P<id>{_NAME})|\.(?P<cls>{_NAME})"
    rf"|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:\"(?P<dq>(?:[^\"\\]|\\.)*)\"|'(?P<sq>(?:[^'\\]|\\.)*)'|(?P<raw>[^\]\s]+))\s*)?\]"
    rf"|:(?P<pseudo>first-child|last-child|nth-of-type|nth-child|not)(?:\((?P<arg>[^()]*)\))?"
)


def _plain(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text)


def _position(node: Node, same: bool) -> int:
    rows = node.parent.elements() if node.parent else [node]
    return [n for n in rows if not same or n.tag == node.tag].index(node) + 1


def _attribute(name, op, value):
    def test(node: Node) -> bool:
        own = node.attrs.get(name)
        if own is None:
            return False
        return {None: True, "=": own == value, "*=": bool(value) and value in own, "^=": bool(value) and own.startswith(value), "$=": bool(value) and own.endswith(value), "~=": value in own.split(), "|=": own == value or own.startswith(value + "-")}[op]

    return test


def _compound(text: str):
    """Tests of one element from a compound selector."""
    tests, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or (m["tag"] and at):
            raise SelectorError(text)
        at = m.end()
        if m["tag"]:
            if (tag := _plain(m["tag"]).lower()) != "*":
                tests.append(lambda n, tag=tag: n.tag == tag)
        elif m["id"]:
            tests.append(lambda n, v=_plain(m["id"]): n.attrs.get("id") == v)
        elif m["cls"]:
            tests.append(lambda n, v=_plain(m["cls"]): v in n.classes())
        elif m["attr"]:
            value = next((x for x in (m["dq"], m["sq"], m["raw"]) if x is not None), "")
            tests.append(_attribute(m["attr"].lower(), m["op"], _plain(value)))
        elif m["pseudo"] == "not":
            inner = _compound((m["arg"] or "").strip())
            tests.append(lambda n, inner=inner: not all(t(n) for t in inner))
        elif m["pseudo"].startswith("nth"):
            if not (m["arg"] or "").strip().isdigit():
                raise SelectorError(text)
            tests.append(lambda n, k=int(m["arg"]), same=m["pseudo"] == "nth-of-type": n.parent is not None and _position(n, same) == k)
        else:
            last = m["pseudo"] == "last-child"
            tests.append(lambda n, last=last: n.parent is not None and n.parent.elements()[-1 if last else 0] is n)
    if not tests and text.strip() != "*":
        raise SelectorError(text)
    return tests


def _pieces(text: str, marks: str) -> list[tuple[str, str]]:
    """(mark before, piece) of a text cut at marks outside of brackets and quotes."""
    out, depth, quote, mark, piece = [], 0, "", "", ""
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "[(":
            depth += 1
        elif c in "])":
            depth -= 1
        elif c in marks and not depth and not piece.endswith("\\"):
            out.append((mark, piece))
            mark, piece = c, ""
            continue
        piece += c
    if quote or depth:
        raise SelectorError(text)
    return [*out, (mark, piece)]


@lru_cache(512)
def _compiled(selector: str):
    groups = []
    for _, part in _pieces(selector, ","):
        if not part.strip():
            raise SelectorError(selector)
        steps, how = [], " "
        for mark, piece in _pieces(re.sub(r"\s+", " ", part.strip()), " >+~"):
            if mark.strip():
                if how != " " or not steps:
                    raise SelectorError(selector)
                how = mark
            if not piece:
                continue
            steps.append((how, _compound(piece)))
            how = " "
        if not steps or how != " ":
            raise SelectorError(selector)
        groups.append(steps)
    return groups


def _matches(node: Node, steps, i: int) -> bool:
    how, tests = steps[i]
    if node.tag is None or node.tag.startswith("#") or not all(t(node) for t in tests):
        return False
    if i == 0:
        return True
    if how == ">":
        return node.parent is not None and _matches(node.parent, steps, i - 1)
    if how in "+~":
        rows = node.parent.elements() if node.parent else [node]
        before = rows[: rows.index(node)]
        return any(_matches(n, steps, i - 1) for n in (before[-1:] if how == "+" else before))
    up = node.parent
    while up is not None:
        if _matches(up, steps, i - 1):
            return True
        up = up.parent
    return False


def select(root: Node, selector: str) -> list[Node]:
    """Descendants of ``root`` that match, in document order."""
    groups = _compiled(selector)
    return [n for n in root.walk() if any(_matches(n, steps, len(steps) - 1) for steps in groups)]


# --- paths: read straight to the matcher's steps ----------------------------------------
_WORDS = re.compile(r"""\s*(?:(?P<axis>//?)|(?P<step>\*|[A-Za-z_][\w:-]*(?:\(\))?)|\[(?P<test>(?:"[^"]*"|'[^']*'|[^\]"'])*)\])\s*""")
_PREDICATE = re.compile(r"""\s*(@[A-Za-z_][\w:-]*|"[^"]+"|'[^']+'|[A-Za-z]+|[0-9]+|[(),=])\s*""")


def _words(pattern: re.Pattern, text: str) -> list[re.Match]:
    """The matches that make up all of a text."""
    out, at = [], 0
    while at < len(text):
        m = pattern.match(text, at)
        if m is None:
            raise XPathError(text)
        out.append(m)
        at = m.end()
    return out


def _predicate(text: str):
    """The test of what stands in brackets: a place, an attribute's value, or a part of it."""
    match [m[1] for m in _words(_PREDICATE, text)]:
        case [place] if place.isdigit():
            return lambda n: n.parent is not None and _position(n, True) == int(place)
        case [name, "=", value] if name[0] == "@" and value[0] in "\"'":
            return _equals(name[1:], value[1:-1])
        case ["contains", "(", name, ",", value, ")"] if name[0] == "@" and value[0] in "\"'":
            return _attribute(name[1:].lower(), "*=", value[1:-1])
    raise XPathError(text)


def _equals(name: str, value: str):
    """An id, one class of several, or a whole attribute."""
    bare = value.strip()
    if name == "id":
        return _attribute("id", "=", bare)
    if name == "class" and len(bare.split()) == 1:
        return lambda n: bare in n.classes()
    return _attribute(name.lower(), "=", value)


@lru_cache(512)
def path_steps(path: str):
    """Steps of a path; its first axis does not count, and ``text()`` is skipped."""
    steps, axis, last = [], "", None  # an empty axis is the beginning, none a step that was read
    for word in _words(_WORDS, path.strip().removeprefix(".")):
        step = word["step"]
        if word["axis"]:
            if axis:
                raise XPathError(path)
            axis, last = word["axis"], None
        elif step:
            if axis is None or ("(" in step and step != "text()"):
                raise XPathError(path)
            last = None
            if step != "text()":
                last = [] if step == "*" else [lambda n, tag=step.lower(): n.tag == tag]
                steps.append((">" if axis == "/" and steps else " ", last))
            axis = None
        else:
            if last is None:
                raise XPathError(path)
            last.append(_predicate(word["test"]))
            last = None
    if not steps:
        raise XPathError(path)
    return steps


def select_path(root: Node, path: str) -> list[Node]:
    """Descendants of ``root`` that a path of the subset names, in document order."""
    steps = path_steps(path)
    return [n for n in root.walk() if _matches(n, steps, len(steps) - 1)]
