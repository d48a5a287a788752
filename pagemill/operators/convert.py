"""Pages to Markdown, HTML, text or JSON, with typed errors and fallbacks by column."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..frames import one_each
from ..functions import pages as P
from ..functions import text as X
from ..functions import urls
from ..functions.regex import first_case, has_any
from ..html.blocks import leaf_blocks
from ..html.render import html_to_markdown
from ..session import kept
from ..sources.pages import ARCHIVE_CHARS, reader_answer, scrape_answer
from .adapters import ADAPTERS, Adapter, name_of, post_processed, site_url

RESULT = T.StructType([T.StructField(x, T.StringType()) for x in ("markdown", "title", "content_html")])
THIN = 500


def rendered(html: Column, url: Column, selector: str | None = None, rules: dict | None = None) -> Column:
    """struct(markdown, title, content_html): of a selector's element, or of the main content; ``rules`` write elements by tag."""

    @F.pandas_udf(RESULT)
    def run(pages: pd.Series, bases: pd.Series) -> pd.DataFrame:
        def one(h, u):
            try:
                return html_to_markdown(h, u or "", selector, rules)
            except RecursionError:  # far too deep a tree: its text is all there is
                return _TAGS.sub(" ", h).strip(), "", h

        return pd.DataFrame([one(h, u) for h, u in zip(pages, bases, strict=True)], columns=RESULT.names, dtype=object)

    return run(html, url)


_TAGS = re.compile(r"<[^>]+>")


def to_text(html: Column, url: Column, selector: str | None = None) -> Column:
    """Rendered content as plain text."""
    return X.stripped_text(rendered(html, url, selector)["markdown"])


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())])))
def leaves(html: pd.Series) -> pd.Series:
    """Leaf blocks of every page, as they stand."""
    return html.map(lambda h: [] if h is None else [{"kind": k, "value": v} for k, v in leaf_blocks(h)])


#: How the text of a block is written, by its kind; others stay as they are.
MARKS = {"image": ("{{IMG:", "}}"), "item": ("- ", ""), "quote": ("> ", ""), "code": ("\n```\n", "\n```\n"), **{f"h{n}": ("#" * n + " ", "") for n in range(1, 7)}}


def harvested(blocks: Column) -> Column:
    """The distinct texts of ``leaves`` in document order, marked by their kind, without boilerplate; a picture counts as repeated by its path."""
    kind = lambda b: b["kind"]
    said = lambda b: (F.length(b["value"]) > 1) & ((kind(b) == "caption") | ~P.is_ui_text(b["value"]))
    shown = F.filter(blocks, lambda b: (kind(b) == "image") | said(b))
    path = lambda b: F.regexp_replace(b["value"], r"^[a-z]+://[^/]+|[?#].*$", "")
    keys = F.transform(shown, lambda b: F.when(kind(b) == "image", F.concat(F.lit("IMG:"), path(b))).otherwise(b["value"]))
    first = F.filter(F.arrays_zip(shown.alias("b"), keys.alias("k"), F.sequence(F.lit(1), F.greatest(F.size(keys), F.lit(1))).alias("n")), lambda x: F.array_position(keys, x["k"]) == x["n"])

    def written(x):
        return first_case([(kind(x["b"]) == k, F.concat(F.lit(a), x["b"]["value"], F.lit(z))) for k, (a, z) in MARKS.items()], x["b"]["value"])

    return F.transform(first, written)


def block_markdown(blocks: Column) -> Column:
    """Harvested ``leaves`` as Markdown, pictures as such."""
    return F.array_join(F.transform(harvested(blocks), lambda b: F.regexp_replace(b, r"^\{\{IMG:(.*)\}\}$", "![]($1)")), "\n\n")


def fetch_errors(pages: DataFrame) -> DataFrame:
    """Pages (url, html[, status, content_type]) with error_code and error: of status, content type, size and verification pages, the first."""
    have = pages.columns
    status = F.col("status") if "status" in have else F.lit(200)
    kind = F.lower(F.coalesce(F.col("content_type") if "content_type" in have else F.lit(None).cast("string"), F.lit("text/html")))
    readable = kind.contains("html") | kind.contains("text/plain") | kind.contains("markdown") | kind.contains("json") | kind.contains("xml")
    faults = [
        (status.isNull(), 504, "Timeout"),
        (status >= 400, 502, "Fetch Failed"),
        (~readable, 415, "Unsupported Content Type"),
        (F.trim(F.coalesce("html", F.lit(""))) == "", 502, "Fetch Failed"),
        (F.col("url").contains("mp.weixin.qq.com") & P.is_verification(F.col("html")), 502, "Fetch Failed"),
        (~P.within_limit(F.col("html")), 413, "Content Too Large"),
    ]
    pick = lambda k: F.coalesce(*(F.when(F.coalesce(f[0], F.lit(False)), f[k]) for f in faults))
    return pages.withColumns({"error_code": pick(1), "error": pick(2)})


def copies(archives: DataFrame) -> DataFrame:
    """(url, wayback, archive) of archived pages (url, html[, source, at]): of either source the copy captured last, or the longest; short copies don't count.

    Copies without a source are the archive's.
    """
    have = archives.columns
    source = F.col("source") if "source" in have else F.lit("archive")
    order = F.struct(*([F.col("at")] if "at" in have else []), F.length("html"), F.xxhash64("html"))
    of = lambda name: F.max_by("html", F.when(source == name, order)).alias(name)
    return archives.where(F.length("html") > ARCHIVE_CHARS).groupBy("url").agg(of("wayback"), of("archive"))


def convert(
    pages: DataFrame,
    kind: str = "markdown",
    selector: str | None = None,
    rules: DataFrame | None = None,
    archives: DataFrame | None = None,
    json_ld_raw: bool = True,
    timestamp: Column | None = None,
    amp: DataFrame | None = None,
    answers: DataFrame | None = None,
    adapters: Sequence[Adapter] = ADAPTERS,
    image_host: str | None = None,
) -> DataFrame:
    """(url, content, title, method, fallbacks, paywall_detected, error_code, error) of every page.

    Faulty pages never reach Python: the table is split by the JVM's predicates first.
    Adapters say where a page lies and clean it. A walled page under one of ``rules`` is
    replaced by its copy in ``amp`` (url, html) where that is open and at least half as
    long. A thin page that looks paywalled is replaced by its JSON-LD article, or the
    copies in ``archives``, where those are longer; a thin page without any of these by
    what providers say in ``answers`` (url, scrape, reader: JSON). ``json_ld_raw`` reads
    JSON-LD before scripts are stripped, which is what the fallback needs to find any.
    ``image_host`` serves images of a host that refuses other pages.

    Null or empty pages and pages of null status are errors; repeated rows are converted
    as often as they occur; an empty table gives no rows. Other columns are ignored,
    whatever their names; of several answers or copies of a page the choice is always the same.
    """
    made = fetch_errors(pages.select(*(c for c in ("url", "html", "status", "content_type") if c in pages.columns)))
    ok = made.where("error_code is null").withColumn("__site", name_of(F.col("url"), adapters)).withColumn("__base", site_url(F.col("url"), adapters))
    raw = F.col("html")
    body = post_processed(P.without_scripts(raw), F.col("__site"), adapters)
    if rules is not None:
        own = sorted(r[0] for r in rules.select(F.explode("remove_selectors")).distinct().collect())  # a few a rule
        ok = P.with_paywall_rule(ok.withColumn("__host", urls.plain_parts(F.col("__base"))[1]), rules, "__host").withColumn("__rule", F.col("domain").isNotNull())
        clean = P.without_paywall(body, own, F.coalesce("remove_selectors", F.array().cast("array<string>")))
    else:
        ok, own, clean = ok.withColumn("__rule", F.lit(False)), [], P.without_paywall(body)
    ok = ok.withColumn("__clean", clean).withColumn("__ruled", F.col("__rule") & P.looks_paywalled(F.col("__clean")))
    ok = ok.withColumn("__amp", F.lit(None).cast("string")) if amp is None else _with_amp(ok, amp)
    ok = ok.withColumn("__by_amp", F.col("__amp").isNotNull()).withColumn("__clean", F.coalesce("__amp", "__clean"))
    ok = ok.withColumn("__ld", P.json_ld_article(raw if json_ld_raw else F.col("__clean"))).withColumn("__wall", P.looks_paywalled(F.col("__clean")))
    ok = ok.withColumns({"wayback": F.lit(None).cast("string"), "archive": F.lit(None).cast("string")}) if archives is None else ok.join(copies(archives).withColumnRenamed("url", "__base"), "__base", "left")
    cleaned = lambda c: P.without_paywall(P.without_scripts(F.col(c)), own, F.coalesce("remove_selectors", F.array().cast("array<string>")) if own else None)
    ok = ok.withColumn("__blocks", leaves(F.when(F.col("__site") == "feishu", raw)))
    blocks = block_markdown(F.col("__blocks"))
    harvest = F.struct(blocks.alias("markdown"), F.lit("").alias("title"), X.basic_html(blocks).alias("content_html"))
    ok = ok.withColumn("__m", rendered(F.when(F.col("__site") != "feishu", F.col("__clean")).otherwise(""), F.col("__base"), selector))
    ok = ok.withColumn("__m", F.when(F.col("__site") == "feishu", harvest).otherwise(F.col("__m")))
    # written once: both branches below read the rendering, and neither works the patterns out again
    ok = kept(ok.select("url", "__base", "__ld", "__wall", "__ruled", "__rule", "__by_amp", F.length("__clean").alias("__size"), cleaned("wayback").alias("__w"), cleaned("archive").alias("__a"), "__m"))
    # only thin, walled pages are rendered again
    thin = F.coalesce(F.col("__wall") & (F.length("__m.markdown") < THIN), F.lit(False))
    every = ["url", "__base", "__size", (F.col("__wall") | F.col("__ruled")).alias("wall"), F.array_compact(F.array(F.when(F.col("__by_amp"), "amp"))).alias("fallbacks")]
    usual = ok.where(~thin).select(*every, F.col("__m").alias("m"))
    poor = ok.where(thin).select("__rule", *every, F.col("__m").alias("m"), *(rendered(F.col(c), F.col("__base"), selector).alias(c) for c in ("__ld", "__w", "__a")))
    poor = _longer(poor, "__ld", "jsonld", F.lit(True))
    poor = _longer(poor, "__w", "wayback_post_convert", F.col("__rule"))
    poor = _longer(poor, "__a", "archive_post_convert", F.col("__rule"))
    both = usual.unionByName(poor.select(usual.columns)).withColumn("method", F.lit("readability"))
    if answers is not None:
        both = _with_answers(both, answers)
    given = F.col("method") != "readability"
    markdown, title = F.col("m.markdown"), F.col("m.title")
    formatted = X.formatted(F.lit(kind), markdown, F.col("url"), title, F.col("method"), timestamp if timestamp is not None else F.lit(""))
    content = F.when(F.lit(kind == "html") & ~given, F.col("m.content_html")).otherwise(formatted)
    if image_host and kind == "markdown":
        guarded = has_any(F.col("__base"), ["mmbiz.qpic.cn", "mp.weixin.qq.com"])
        content = F.when(guarded, X.proxied_images(content, image_host)).otherwise(content)
    empty = F.trim(F.coalesce(markdown, F.lit(""))) == ""
    good = both.select("url", F.when(~empty, content).alias("content"), "m.title", "method", "fallbacks", F.col("wall").alias("paywall_detected"), F.when(empty, 422).alias("error_code"), F.when(empty, "No Content").alias("error"))
    bad = made.where("error_code is not null").select("url", F.lit(None).cast("string").alias("content"), F.lit("").alias("title"), F.lit("").alias("method"), F.array().cast("array<string>").alias("fallbacks"), F.lit(False).alias("paywall_detected"), "error_code", "error")
    return good.unionByName(bad)


def _with_amp(ok: DataFrame, amp: DataFrame) -> DataFrame:
    """``__amp``: the AMP copy of a walled page under a rule, if it is open and at least half as long."""
    link = urls.normalized(F.when(F.col("__ruled"), P.amp_link(F.col("__clean"))), F.col("__base"))
    copies = amp.groupBy(F.col("url").alias("__link")).agg(P.without_amp_controls(F.max_by("html", F.struct(F.length("html"), F.xxhash64("html")))).alias("__copy"))
    made = ok.withColumn("__link", link).join(copies, "__link", "left")
    usable = ~P.looks_paywalled(F.col("__copy")) & (F.length("__copy") > F.length("__clean") / 2)
    return made.withColumn("__amp", F.when(usable, F.col("__copy"))).drop("__copy", "__link")


def _longer(rows: DataFrame, other: str, name: str, allowed: Column) -> DataFrame:
    """``m`` replaced by a longer rendering while it is thin, with the fallback's name."""
    size = lambda c: F.length(F.coalesce(F.col(f"{c}.markdown"), F.lit("")))
    go = F.coalesce(allowed & (size("m") < THIN) & (size(other) > size("m")), F.lit(False))
    titled = F.struct(F.col(f"{other}.markdown"), F.coalesce(F.nullif(F.col(f"{other}.title"), F.lit("")), "m.title").alias("title"), F.col(f"{other}.content_html"))
    return rows.withColumns({"fallbacks": F.when(go, F.array_append("fallbacks", F.lit(name))).otherwise(F.col("fallbacks")), "m": F.when(go, titled).otherwise(F.col("m"))})


def _with_answers(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Thin pages without any fallback, by the scrape service's longer answer, else the reader's."""
    told = answers.select(F.col("url").alias("__base"), scrape_answer(F.col("scrape")).alias("__s"), reader_answer(F.col("reader")).alias("__r"))
    made = rows.join(one_each(told, "__base"), "__base", "left")
    size = lambda c: F.length(F.coalesce(F.col(f"{c}.markdown"), F.lit("")))
    asks = (size("m") < THIN) & (F.size("fallbacks") == 0) & (F.col("__size") > 2000)
    by_scrape = F.coalesce(asks & (size("__s") > size("m")), F.lit(False))
    by_reader = F.coalesce(asks & ~by_scrape & (size("__r") > size("m")), F.lit(False))
    told_by = lambda c: F.struct(F.col(f"{c}.markdown"), F.coalesce(F.nullif(F.col(f"{c}.title"), F.lit("")), "m.title").alias("title"), F.lit("").alias("content_html"))
    return made.withColumns(
        {
            "method": F.when(by_scrape, "firecrawl").when(by_reader, "jina").otherwise(F.col("method")),
            "fallbacks": F.when(by_scrape, F.array(F.lit("firecrawl_fallback"))).when(by_reader, F.array(F.lit("jina_fallback"))).otherwise(F.col("fallbacks")),
            "m": F.when(by_scrape, told_by("__s")).when(by_reader, told_by("__r")).otherwise(F.col("m")),
        }
    ).drop("__s", "__r")


def by_ladder(requests: DataFrame) -> DataFrame:
    """The first source that answers of cached, scrape, reader, provider and page columns (Markdown or null), and its method.

    A source that was asked for by name goes before all but the cache.
    """
    asked = lambda name: F.when(F.col("engine") == name, F.col(name))
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    order = [("cached", F.col("cached")), ("firecrawl", asked("firecrawl")), ("jina", asked("jina")), ("cf", F.col("cf")), ("readability", F.col("page"))]
    found = [(n, filled(c)) for n, c in order]
    method = F.coalesce(*(F.when(c.isNotNull(), n) for n, c in found))
    return requests.withColumns({"content": F.coalesce(*(c for _, c in found)), "method": method})
