"""The link graph of a table of pages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import whatwg
from ..html.dom import parse
from ..html.select import select
from ..session import kept

EDGES = "src string, pos int, dst string, anchor string"


def links_of(html: str | None, base: str) -> list[tuple[str, str | None]]:
    """Absolute http(s) targets without fragment, and trimmed anchor texts, in document order."""
    if not html or not html.strip():
        return []
    out = []
    for a in select(parse(html), "a[href]"):
        href = a.get("href")
        target = whatwg.normalize(href, base) if href else None
        if target:
            out.append((target, a.text_content().strip() or None))
    return out


def edges(pages: DataFrame) -> DataFrame:
    """(src, pos, dst, anchor) of ``pages`` (url, html): parsed where the pages lie, nothing is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(u, i, dst, text) for u, h in zip(b["url"], b["html"], strict=True) if u for i, (dst, text) in enumerate(links_of(h, u))]
            yield pd.DataFrame(rows, columns=["src", "pos", "dst", "anchor"])

    return pages.select("url", "html").mapInPandas(run, EDGES)


#: Characters of the parts by which a path is looked for in other texts.
GRAM = 8


def _parts(text: Column, size: Column) -> Column:
    """Every substring of ``size`` characters."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1))), lambda i: F.substring(text, i, size))


def containing(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(text, pattern) of ``texts`` (text) and ``patterns`` (pattern), both distinct, where the text contains the pattern.

    An index of parts: a pattern of ``GRAM`` characters or more is filed under its rarest
    part, by counts over all patterns, and met only by texts that hold this part; a
    shorter one is met by equality with the texts' short substrings. No text meets a
    pattern that shares nothing with it. Nulls and empty patterns match nothing.
    """
    texts, patterns = texts.where("text is not null"), patterns.where("pattern <> ''")
    size, wide = F.lit(GRAM), F.length("pattern") >= GRAM
    grams = patterns.where(wide).select("pattern", F.explode(F.array_distinct(_parts(F.col("pattern"), size))).alias("gram"))
    postings = grams.groupBy("gram").agg(F.count("*").alias("n"))
    filed = grams.join(postings, "gram").groupBy("pattern").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    held = texts.where(F.length("text") >= GRAM).select("text", F.explode(F.array_distinct(_parts(F.col("text"), size))).alias("gram"))
    long = held.join(filed, "gram").where(F.contains("text", "pattern")).select("text", "pattern")
    short = F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.lit(GRAM - 1), F.greatest(F.length("text"), F.lit(1)))), lambda n: _parts(F.col("text"), n)))
    small = texts.select("text", F.explode(F.array_distinct(short)).alias("pattern")).join(patterns.where(~wide), "pattern").select("text", "pattern")
    return long.unionByName(small)


def resolve_images(images: DataFrame, known: DataFrame) -> DataFrame:
    """Each image (id, src) with the stored key of ``known`` (src, key): by exact URL, then by path, then by either containing the other's path.

    Two equality joins take what they can; the distinct addresses that neither matched
    are looked up in an index of parts, both ways. Of several keys the least is taken;
    a null src has none; repeated rows stay.
    """
    path = lambda c: F.regexp_replace(F.regexp_replace(c, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    exact = images.join(known.groupBy("src").agg(F.min("key").alias("by_url")), "src", "left")
    paths = kept(known.groupBy(path(F.col("src")).alias("p")).agg(F.min("key").alias("by_path")))
    two = kept(exact.join(paths, path(F.col("src")) == F.col("p"), "left").select("id", "src", "by_url", "by_path"))
    rest = two.where("by_url is null and by_path is null").select("src").distinct()
    holds = containing(rest.withColumnRenamed("src", "text"), paths.select(F.col("p").alias("pattern"))).join(paths, F.col("pattern") == F.col("p"))
    holds = holds.groupBy(F.col("text").alias("src")).agg(F.min("by_path").alias("key"))
    full = known.groupBy("src").agg(F.min("key").alias("key"))
    asked = rest.select("src", path(F.col("src")).alias("pattern"))
    inside = containing(full.select(F.col("src").alias("text")), asked.select("pattern").distinct()).join(full, F.col("text") == F.col("src"))
    inside = asked.join(inside.groupBy("pattern").agg(F.min("key").alias("key")), "pattern").select("src", "key")
    near = holds.unionByName(inside).groupBy("src").agg(F.min("key").alias("by_part"))
    return two.join(near, "src", "left").select("id", "src", F.coalesce("by_url", "by_path", "by_part").alias("key"))
