"""Site adapters: which pages they take, where those are fetched, and how their HTML is cleaned.

An adapter is a row of Columns, so a list of them is one CASE in the plan; a caller's own
adapters go before the given ones.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import pages as P
from ..functions import urls
from ..functions.regex import first_case, has_any
from ..html import social

GENERIC = "generic"


@F.pandas_udf(T.StringType())
def social_article(html: pd.Series) -> pd.Series:
    """One platform's article rebuilt; nulls and other pages stay as they are."""
    return html.map(lambda h: h if h is None else social.article(h))


@dataclass(frozen=True)
class Adapter:
    """``match`` and ``transform_url`` take a URL Column, ``post_process`` an HTML Column."""

    name: str
    match: Callable[[Column], Column]
    always_browser: bool = False
    transform_url: Callable[[Column], Column] | None = None
    post_process: Callable[[Column], Column] | None = None


def scaffold(name: str, marks: Sequence[str], **parts) -> Adapter:
    """An adapter of the URLs that hold one of ``marks``; ``parts`` are its other fields."""
    if not name or name == GENERIC or not marks or not all(marks):
        raise ValueError("An adapter needs a name of its own and marks of its URLs.")
    return Adapter(name, lambda url: has_any(url, list(marks)), **parts)


def _suite(url: Column) -> Column:
    return F.coalesce(P.is_document_suite(urls.plain_parts(url)[1], F.try_parse_url(url, F.lit("PATH"))), F.lit(False))


_OWN = {
    "wechat": {"post_process": social_article},
    "netease": {"post_process": P.without_news_noise},
    "reddit": {"transform_url": P.forum_url, "post_process": P.forum_post},
}
ADAPTERS = (Adapter("feishu", _suite, True), *(scaffold(n, m, always_browser=n in P.ALWAYS_BROWSER, **_OWN.get(n, {})) for n, m in P.ADAPTER_MARKS.items()))


def register(*new: Adapter, known: Sequence[Adapter] = ADAPTERS) -> tuple[Adapter, ...]:
    """``new`` before ``known``, whose adapters of the same name they replace."""
    names = {a.name for a in new}
    if len(names) < len(new):
        raise ValueError("Adapters must have names of their own.")
    return (*new, *(a for a in known if a.name not in names))


def name_of(url: Column, adapters: Sequence[Adapter] = ADAPTERS) -> Column:
    """The first adapter that takes a URL."""
    return first_case([(F.coalesce(a.match(url), F.lit(False)), a.name) for a in adapters], GENERIC)


def _by_name(value: Column, name: Column, adapters: Sequence[Adapter], part: str) -> Column:
    """Each adapter's part over the values of its own rows; the part sees null for all others, so that Python skips them."""
    out = value
    for a in adapters:
        if f := getattr(a, part):
            mine = name == a.name
            out = F.when(mine, f(F.when(mine, value))).otherwise(out)
    return out


def site_url(url: Column, adapters: Sequence[Adapter] = ADAPTERS) -> Column:
    """Where a URL's page is fetched."""
    return _by_name(url, name_of(url, adapters), adapters, "transform_url")


def post_processed(html: Column, name: Column, adapters: Sequence[Adapter] = ADAPTERS) -> Column:
    return _by_name(html, name, adapters, "post_process")


def always_browser(name: Column, adapters: Sequence[Adapter] = ADAPTERS) -> Column:
    return name.isin([a.name for a in adapters if a.always_browser])


def fetched(requests: DataFrame, pages: DataFrame, adapters: Sequence[Adapter] = ADAPTERS) -> DataFrame:
    """``requests`` (url) with the page that lies at the place where each is fetched; nulls where there is none."""
    rest = [c for c in pages.columns if c != "url"]
    there = pages.select(F.col("url").alias("__at"), *rest)
    return requests.join(there, site_url(F.col("url"), adapters) == F.col("__at"), "left").select(*requests.columns, *rest)
