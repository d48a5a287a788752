"""Extraction over a column of pages: rows out, errors beside them, never a failed job."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import collapse
from ..html.extract import MAX_BYTES, ExtractionError, count_matches, extract, regex_schema, structured_schema
from .adapters import fetched
from .convert import RESULT as MARKDOWN
from .convert import convert, rendered

RESULT = T.StructType(
    [
        T.StructField("data", T.StringType()),
        T.StructField("item_count", T.IntegerType()),
        T.StructField("matches", T.IntegerType()),
        T.StructField("error_code", T.StringType()),
        T.StructField("error_message", T.StringType()),
    ]
)
OPTION_KINDS = {"dedupe": bool, "includeEmpty": bool, "regexFlags": str}


def checked_options(options: dict | None) -> dict:
    """Allowed keys of the right kind; flags unique, known and eight at most."""
    for key, value in (options or {}).items():
        if key not in OPTION_KINDS or not isinstance(value, OPTION_KINDS[key]):
            raise ExtractionError("INVALID_REQUEST", f"Unsupported extraction option: {key}.", field=key)
    flags = (options or {}).get("regexFlags", "")
    if len(flags) > 8 or len(set(flags)) != len(flags) or set(flags) - set("dgimsuvy"):
        raise ExtractionError("INVALID_REQUEST", "regexFlags must be unique valid flags.", field="regexFlags")
    return options or {}


def checked_schema(strategy: str, schema: dict) -> dict:
    """The schema, checked on the driver before any page is read."""
    if strategy == "regex":
        regex_schema(schema)
    elif strategy in ("css", "xpath"):
        structured_schema(schema)
    else:
        raise ExtractionError("UNSUPPORTED_STRATEGY", f"Unsupported extraction strategy: {strategy}")
    return schema


def extracted(html: Column, strategy: str, schema: dict, options: dict | None = None, selector: str | None = None) -> Column:
    """A struct: data (JSON), item_count, matches, or error_code and error_message."""

    @F.pandas_udf(RESULT)
    def run(pages: pd.Series) -> pd.DataFrame:
        out = []
        for html in pages:
            try:
                data = extract(strategy, html, schema, options, selector)
                out.append((json.dumps(data, ensure_ascii=False), len(data) if isinstance(data, list) else 1, count_matches(data), None, None))
            except ExtractionError as e:
                out.append((None, None, None, e.code, str(e)))
            except RecursionError:
                out.append((None, None, None, "EXTRACTION_FAILED", "The page is nested too deeply."))
        return pd.DataFrame(out, columns=RESULT.names).astype({"item_count": "Int32", "matches": "Int32"})

    return run(html)


def extract_pages(pages: DataFrame, strategy: str, schema: dict, options: dict | None = None, selector: str | None = None, html: str = "html") -> DataFrame:
    """``pages`` without the HTML, with the result's columns."""
    checked_schema(strategy, schema)
    made = pages.withColumn("__x", extracted(F.col(html), strategy, schema, checked_options(options), selector))
    return made.select(*(c for c in pages.columns if c != html), "__x.*")


def extract_sources(items: DataFrame, pages: DataFrame, strategy: str, schema: dict, options: dict | None = None, selector: str | None = None, with_markdown: bool = False, **settings) -> DataFrame:
    """``items`` (url, html; either may be null) with the result's columns, title and, if asked for, markdown.

    An item without HTML is its URL's page in ``pages``, converted to reduced HTML first
    (``settings`` go to ``convert``); what conversion says is wrong is the item's error.
    Items without any source, and those whose page is not there, have errors too.
    """
    blank = F.trim(F.coalesce("html", F.lit(""))) == ""
    asked = items.where(blank & (F.trim(F.coalesce("url", F.lit(""))) != "")).select("url").distinct()
    read = convert(fetched(asked, pages.withColumn("__there", F.lit(True))).withColumn("status", F.when(F.col("__there"), F.lit(200))).drop("__there"), "html", selector, **settings)
    read = read.select("url", F.col("content").alias("__html"), F.col("title").alias("__title"), F.col("error").alias("__fault"))
    made = items.join(read, "url", "left").withColumn("__by_url", blank).withColumn("__source", F.when(blank, F.col("__html")).otherwise(F.col("html")))
    made = made.withColumn("__x", extracted(F.when(F.col("__source").isNotNull(), F.col("__source")).otherwise(""), strategy, checked_schema(strategy, schema), checked_options(options), selector))
    fault = F.when(F.col("__by_url") & F.col("__fault").isNotNull(), "UPSTREAM_FETCH_FAILED")
    out = [F.coalesce(fault, F.col("__x.error_code")).alias("error_code"), F.when(fault.isNotNull(), F.col("__fault")).otherwise(F.col("__x.error_message")).alias("error_message")]
    text = rendered(F.coalesce("__source", F.lit("")), F.coalesce("url", F.lit("https://example.invalid/")), selector)
    made = made.withColumn("__m", text) if with_markdown else made.withColumn("__m", F.lit(None).cast(MARKDOWN))
    title = F.coalesce(F.nullif("__title", F.lit("")), "__m.title", F.lit(""))
    return made.select(*(c for c in items.columns if c != "html"), F.octet_length("__source").alias("html_bytes"), "__x.data", "__x.item_count", "__x.matches", *out, title.alias("title"), *([F.col("__m.markdown").alias("markdown")] if with_markdown else []))


def extract_rows(pages: DataFrame, strategy: str, schema: dict, options: dict | None = None, selector: str | None = None, html: str = "html") -> DataFrame:
    """One row for each extracted item, a column for each field; ``row`` is its place on the page.

    Field columns are strings, or arrays of strings for multiple fields and labels.
    """
    fields = checked_schema(strategy, schema)["fields"] if strategy != "regex" else [{"name": k, "multiple": True} for k in regex_schema(schema)[0]]
    kind = ", ".join(f"`{f['name']}` {'array<string>' if f.get('multiple') else 'string'}" for f in fields)
    done = extract_pages(pages, strategy, schema, options, selector, html)
    many = F.when(F.col("data").startswith("["), F.col("data")).otherwise(F.concat(F.lit("["), F.col("data"), F.lit("]")))
    rows = F.posexplode(F.from_json(many, f"array<struct<{kind.replace('` ', '`:')}>>"))
    own = [c for c in pages.columns if c != html]
    return done.where("error_code is null").select(*own, rows.alias("row", "item")).select(*own, "row", "item.*")


def regex_column(html: Column, pattern: str, group: int = 0, dedupe: bool = False) -> Column:
    """The JVM path for one pattern with at most one group: all non-empty matches, white space collapsed."""
    hits = F.filter(F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(group)), collapse), lambda x: x != "")
    return F.array_distinct(hits) if dedupe else hits


def request_errors(items: DataFrame) -> DataFrame:
    """Extraction requests (strategy, url, html, schema as VARIANT or null) with the first fault of each as error_code, error_message."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    faults = [
        (F.col("strategy").isNull() | ~F.col("strategy").isin("css", "xpath", "regex"), "UNSUPPORTED_STRATEGY", "strategy must be one of: css, xpath, regex."),
        (F.col("schema").isNull(), "INVALID_SCHEMA", "schema must be an object."),
        (blank("url") & blank("html"), "INVALID_REQUEST", "A non-empty url or html source is required."),
        (F.octet_length("html") > MAX_BYTES, "INVALID_REQUEST", f"Input HTML is too large (max {MAX_BYTES} bytes)."),
    ]
    pick = lambda k: F.coalesce(*(F.when(F.coalesce(f[0], F.lit(False)), f[k]) for f in faults))
    return items.withColumns({"error_code": pick(1), "error_message": pick(2)})
