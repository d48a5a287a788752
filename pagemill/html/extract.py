"""Structured extraction from one page: selectors, XPath subset, or regular expressions."""

from __future__ import annotations

import re
from typing import Any

from .dom import Node, body_of, parse
from .select import SelectorError, XPathError, select, select_path

MAX_BYTES, MAX_PATTERNS, MAX_PATTERN, MAX_MATCHES = 2_000_000, 64, 4096, 1000


class ExtractionError(ValueError):
    def __init__(self, code: str, message: str, **details: Any):
        super().__init__(message)
        self.code, self.details = code, details


def structured_schema(schema: Any) -> dict:
    """A checked css/xpath schema."""
    if not isinstance(schema, dict):
        raise ExtractionError("INVALID_SCHEMA", "Schema must be an object for css/xpath extraction.")
    fields = schema.get("fields")
    if not isinstance(fields, list) or not fields:
        raise ExtractionError("INVALID_SCHEMA", "Schema.fields must be a non-empty array.")
    if any(not isinstance(f, dict) or not isinstance(f.get("name"), str) or not f["name"] for f in fields):
        raise ExtractionError("INVALID_SCHEMA", "Each schema field must include a non-empty name.")
    return schema


def regex_schema(schema: Any) -> tuple[dict[str, str], str | None]:
    """(patterns, flags) of a nested or flat regex schema."""
    if not isinstance(schema, dict):
        raise ExtractionError("INVALID_SCHEMA", "Regex schema must be an object.")
    nested = isinstance(schema.get("patterns"), dict)
    patterns = schema["patterns"] if nested else schema
    if not patterns:
        raise ExtractionError("INVALID_SCHEMA", "Regex schema patterns must include at least one entry.")
    if len(patterns) > MAX_PATTERNS:
        raise ExtractionError("INVALID_SCHEMA", f"Regex schema patterns exceed limit (max {MAX_PATTERNS}).", max=MAX_PATTERNS, count=len(patterns))
    for label, p in patterns.items():
        if not isinstance(p, str):
            raise ExtractionError("INVALID_SCHEMA", "Regex schema values must be strings.", label=label)
        if not p:
            raise ExtractionError("INVALID_SCHEMA", "Regex pattern cannot be empty.", label=label)
        if len(p) > MAX_PATTERN:
            raise ExtractionError("INVALID_SCHEMA", f"Regex pattern is too long (max {MAX_PATTERN} chars).", label=label)
    return patterns, schema.get("flags") if nested else None


def _css(root: Node, selector: str) -> list[Node]:
    try:
        return select(root, selector)
    except SelectorError as e:
        raise ExtractionError("INVALID_SCHEMA", "Invalid CSS selector in extraction schema.", selector=selector) from e


def _xpath(root: Node, path: str) -> list[Node]:
    try:
        return select_path(root, path)
    except XPathError as e:
        raise ExtractionError("UNSUPPORTED_XPATH", "Unsupported XPath expression. Use a simpler path with tag/predicate steps.", xpath=path) from e


def _value(node: Node, field: dict) -> str:
    kind = field.get("type") or "text"
    if kind == "html":
        return (node.inner_html() or node.outer_html()).strip()
    if kind == "attribute":
        return (node.get(field.get("attribute") or "href") or "").strip()
    return " ".join(node.text_content().split())


def _roots(strategy: str, document: Node, schema: dict, selector: str | None) -> list[Node]:
    found: list[Node] = []
    if strategy == "xpath" and schema.get("baseXPath"):
        found = _xpath(document, schema["baseXPath"])
    elif chosen := (schema.get("baseSelector") if strategy == "css" else None) or selector:
        found = _css(document, chosen)
    return found or [body_of(document)]


def structured(strategy: str, html: str, schema: dict, options: dict | None = None, selector: str | None = None) -> list[dict] | dict:
    """One row for each root; a single object where there is no base and one root."""
    keep_empty = bool((options or {}).get("includeEmpty"))
    order = [("selector", _css), ("xpath", _xpath)]
    rows = []
    for root in _roots(strategy, parse(html), schema, selector):
        row: dict[str, Any] = {}
        for field in schema["fields"]:
            ways = order if strategy == "css" else order[::-1]
            nodes = next((find(root, field[key]) for key, find in ways if field.get(key)), [root])
            if field.get("multiple"):
                values = [_value(n, field) for n in nodes]
                row[field["name"]] = values if keep_empty else [v for v in values if v]
            else:
                row[field["name"]] = _value(nodes[0], field) if nodes else ""
            got = row[field["name"]]
            if field.get("required") and not any(v.strip() for v in (got if isinstance(got, list) else [got])):
                raise ExtractionError("EXTRACTION_FAILED", f'Required field "{field["name"]}" was not found.', field=field["name"])
        rows.append(row)
    return rows[0] if len(rows) == 1 and not schema.get("baseSelector") and not schema.get("baseXPath") else rows


_FLAGS = {"i": re.I, "m": re.M, "s": re.S, "g": 0, "u": 0, "y": 0, "d": 0, "v": 0}


def by_regex(html: str, patterns: dict[str, str], flags: str | None, options: dict | None = None) -> dict[str, list[str]]:
    """All matches by label: the first non-empty group, or the whole match, with collapsed white space."""
    options = options or {}
    keep_empty = bool(options.get("includeEmpty"))
    chosen = options.get("regexFlags") or flags or "g"
    out = {}
    for label, pattern in patterns.items():
        try:
            compiled = re.compile(re.sub(r"\(\?<(?=[A-Za-z])", "(?P<", pattern), sum({_FLAGS[f] for f in chosen}) | re.ASCII)
        except (re.error, KeyError) as e:
            raise ExtractionError("INVALID_SCHEMA", "Regex pattern could not be compiled.", label=label, pattern=pattern) from e
        hits: list[str] = []
        for m in compiled.finditer(html):
            group = next((g for g in m.groups() if g is not None and (g or keep_empty)), None)
            value = " ".join((m[0] if group is None else group).split())
            if value or keep_empty:
                hits.append(value)
            if len(hits) > MAX_MATCHES:
                raise ExtractionError("INVALID_REQUEST", f'Regex extraction produced too many matches for "{label}" (max {MAX_MATCHES}).', label=label)
        out[label] = list(dict.fromkeys(hits)) if options.get("dedupe") else hits
    return out


def count_matches(value: Any) -> int:
    """Non-empty leaves."""
    if isinstance(value, dict):
        return sum(map(count_matches, value.values()))
    if isinstance(value, list):
        return sum(map(count_matches, value))
    return int(bool(value)) if isinstance(value, str) or value is None else 1


def extract(strategy: str, html: str | None, schema: Any, options: dict | None = None, selector: str | None = None) -> Any:
    """The data of one page, or an ExtractionError."""
    if not html:
        raise ExtractionError("INVALID_REQUEST", "Extraction input html must be a string.")
    if (size := len(html.encode())) > MAX_BYTES:
        raise ExtractionError("INVALID_REQUEST", f"Input HTML is too large (max {MAX_BYTES} bytes).", size=size)
    if strategy in ("css", "xpath"):
        return structured(strategy, html, structured_schema(schema), options, selector)
    if strategy == "regex":
        return by_regex(html, *regex_schema(schema), options)
    raise ExtractionError("UNSUPPORTED_STRATEGY", f"Unsupported extraction strategy: {strategy}", strategy=strategy)
