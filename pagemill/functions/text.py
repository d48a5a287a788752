"""Markdown and HTML text as Columns: escaping, plain text, snippets, output formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import replace_all

# --- fixed values: marks of Markdown, in order: each step sees what the one before left ---
PLAIN_STEPS = [
    ("\r\n?", "\n"),
    (r"(?md)^#{1,6}\s+", ""),
    (r"```[\t ]*[^\n]*\n([\s\S]*?)```", "$1"),
    (r"`([^`]+)`", "$1"),
    (r"!\[([^\]]*)\]\([^)]+\)", "$1"),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"\*\*([^*]+)\*\*", "$1"),
    (r"__([^_]+)__", "$1"),
    (r"\*([^*\n]+)\*", "$1"),
    (r"_([^_\n]+)_", "$1"),
    (r"~~([^~]+)~~", "$1"),
    (r"(?md)^>\s?", ""),
    (r"(?md)^[-*+]\s+", ""),
    (r"(?md)^\d+\.\s+", ""),
    (r"\n{3,}", "\n\n"),
]
SNIPPET_STEPS = [
    (r"(?md)^#{1,6}\s+", ""),
    (r"\*\*(.+?)\*\*", "$1"),
    (r"\*(.+?)\*", "$1"),
    (r"~~(.+?)~~", "$1"),
    (r"`(.+?)`", "$1"),
    (r"!\[[^\]]*\]\([^)]+\)", ""),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"(?md)^[-*+]\s", ""),
    (r"(?md)^>\s", ""),
    (r"\n+", " "),
]
#: What is left of Markdown rendered from HTML when its marks go.
STRIP_STEPS = [
    (r"#{1,6}\s", ""),
    (r"\*\*([^*]+)\*\*", "$1"),
    (r"\*([^*]+)\*", "$1"),
    (r"~~([^~]+)~~", "$1"),
    (r"`([^`]+)`", "$1"),
    (r"!\[([^\]]*)\]\([^)]+\)", "$1"),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"(?md)^[-*+]\s", ""),
    (r"(?md)^\d+\.\s", ""),
    (r"(?md)^>\s", ""),
]
MAX_CHARS, MAX_LINE = 2_000_000, 20_000
# -------------------------------------------------------------------------------------


def strip(text: Column) -> Column:
    """Without white space at either end, Unicode's included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def escape_html(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for raw, safe in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def basic_html(markdown: Column) -> Column:
    return F.concat(F.lit("<pre>"), escape_html(markdown), F.lit("</pre>"))


def plain_text(markdown: Column) -> Column:
    return strip(replace_all(markdown, PLAIN_STEPS))


def clamp_lines(text: Column, most: int = MAX_CHARS, line: int = MAX_LINE) -> Column:
    """At most ``most`` characters, at most ``line`` of any line."""
    return F.array_join(F.transform(F.split(F.substring(text, 1, most), "\n"), lambda x: F.substring(x, 1, line)), "\n")


def stripped_text(markdown: Column) -> Column:
    """Rendered Markdown as plain text, whole; blank stays empty."""
    return F.when(strip(markdown) == "", "").otherwise(replace_all(markdown, STRIP_STEPS))


def snippet(markdown: Column, most: int = 160) -> Column:
    plain = strip(replace_all(markdown, SNIPPET_STEPS))
    return F.when(F.length(plain) > most, F.concat(F.substring(plain, 1, most - 1), F.lit("…"))).otherwise(plain)


def heading(markdown: Column) -> Column:
    """The first level-one heading, or an empty text."""
    return F.trim(F.regexp_extract(markdown, r"(?md)^#\s+(.+)$", 1))


def json_output(url: Column, title: Column, markdown: Column, method: Column, timestamp: Column) -> Column:
    return F.to_json(F.struct(url.alias("url"), title.alias("title"), markdown.alias("markdown"), method.alias("method"), timestamp.alias("timestamp")))


def formatted(kind: Column, markdown: Column, url: Column, title: Column, method: Column, timestamp: Column) -> Column:
    """The output in one of the formats markdown (default), html, text, json."""
    return F.when(kind == "html", basic_html(markdown)).when(kind == "text", plain_text(markdown)).when(kind == "json", json_output(url, title, markdown, method, timestamp)).otherwise(markdown)


_HOTLINKED = r"!\[([^\]]*)\]\((https?://mmbiz\.qpic\.cn/[^)]+)\)"


def proxied_images(markdown: Column, host: str) -> Column:
    """Images of the hot-link-protected host, rewritten to ``https://host/img/<encoded url>``.

    The text is split at the images; every piece after the first begins with one.
    """
    pieces = F.split(markdown, f"(?={_HOTLINKED})")
    link = lambda p: F.replace(F.url_encode(F.regexp_extract(p, _HOTLINKED, 2)), F.lit("+"), F.lit("%20"))
    done = lambda p: F.concat(F.lit("!["), F.regexp_extract(p, _HOTLINKED, 1), F.lit(f"](https://{host}/img/"), link(p), F.lit(")"), F.regexp_replace(p, f"^{_HOTLINKED}", ""))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(f"^{_HOTLINKED}"), done(p)).otherwise(p)), "")


def wrapped(text: Column, width: int = 40, lines: int = 3) -> Column:
    """Greedy word wrap: at most ``lines`` lines of about ``width`` characters, as an array."""
    words = F.filter(F.split(collapse(text), " "), lambda w: w != "")
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))

    def add(state, word):
        joined = F.when(state["line"] == "", word).otherwise(F.concat(state["line"], F.lit(" "), word))
        fits = (F.length(joined) <= width) | (state["line"] == "")
        return F.struct(F.when(fits, state["done"]).otherwise(F.array_append(state["done"], state["line"])).alias("done"), F.when(fits, joined).otherwise(word).alias("line"))

    return F.slice(F.aggregate(words, empty, add, lambda s: F.when(s["line"] == "", s["done"]).otherwise(F.array_append(s["done"], s["line"]))), 1, lines)
