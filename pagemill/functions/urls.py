"""URL predicates and parts. Host rules are Columns on the host of one parsing UDF."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import whatwg
from .regex import ends_any, first_case, has_any, literal
from .text import strip

MAX_URL = 4096
# --- fixed values ------------------------------------------------------------------
INTERNAL_ENDS = [".local", ".internal", ".localhost", ".home.arpa", ".localdomain", ".test", ".invalid"]
REBINDING_ENDS = [".nip.io", ".sslip.io", ".xip.io", ".localtest.me"]
OWN_PARAMETERS = ["raw", "force_browser", "no_cache", "format", "selector", "token", "engine", "debug_trace"]
TWO_PART_SUFFIXES = ["co.uk", "com.au", "co.jp", "co.kr", "com.br", "com.cn"]
LONG_TTL_MARKS = ["mp.weixin.qq.com", ".feishu.cn/", ".larksuite.com/"]
SHORT_TTL_MARKS = ["zhihu.com", "juejin.cn", "twitter.com", "x.com"]
PLATFORM_HOSTS = [
    # label, hosts, ends of hosts
    ("wechat", ["mp.weixin.qq.com"], []),
    ("zhihu", [], ["zhihu.com"]),
    ("juejin", [], ["juejin.cn"]),
    ("xiaohongshu", [], ["xiaohongshu.com", "xhslink.com"]),
    ("weibo", [], ["weibo.com"]),
    ("x", ["x.com"], [".x.com", "twitter.com"]),
    ("github", [], ["github.com"]),
    ("linkedin", [], ["linkedin.com"]),
    ("youtube", ["youtu.be"], ["youtube.com"]),
    ("medium", [], ["medium.com"]),
    ("substack", [], ["substack.com"]),
    ("notion", [], ["notion.site", "notion.so"]),
    ("google_docs", [], ["docs.google.com"]),
]
# -----------------------------------------------------------------------------------

PARTS = T.StructType([T.StructField(x, T.StringType()) for x in ("url", "scheme", "host", "netloc", "path", "query", "canonical")])


@F.pandas_udf(PARTS)
def parsed(text: pd.Series) -> pd.DataFrame:
    """url (no fragment), scheme, host, netloc (with port), path, query and canonical (no query); nulls where it does not parse."""
    rows = [whatwg.parse(t) if isinstance(t, str) else None for t in text]
    made = [(u.text(), u.scheme, u.host, u.netloc, u.path, u.query, u.text(query=False)) if u else (None,) * 7 for u in rows]
    return pd.DataFrame(made, columns=PARTS.names, dtype=object)


@F.pandas_udf(T.StringType())
def normalized(text: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([whatwg.normalize(t, b) if isinstance(t, str) else None for t, b in zip(text, base, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def normalized_alone(text: pd.Series) -> pd.Series:
    return pd.Series([whatwg.normalize(t) if isinstance(t, str) else None for t in text], dtype=object)


def with_parts(df: DataFrame, url: str = "url", name: str = "parts") -> DataFrame:
    """``df`` with the struct of its URL's parts."""
    return df.withColumn(name, parsed(F.col(url)))


def plain_parts(url: Column) -> tuple[Column, Column]:
    """(scheme, host) by the JVM's parser: for corpora of clean, encoded URLs. No Python."""
    return F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), F.lower(F.try_parse_url(url, F.lit("HOST")))


def is_http(url: Column, scheme: Column) -> Column:
    return F.coalesce((F.length(url) <= MAX_URL) & scheme.isin("http", "https"), F.lit(False))


def bare_host(host: Column) -> Column:
    """Lower case, without one closing dot."""
    return F.regexp_replace(F.lower(host), r"\.$", "")


_PRIVATE = r"^(?:127\.|10\.|172\.(?:1[6-9]|2\d|3[01])\.|192\.168\.|169\.254\.|100\.(?:6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.)|^0\.0\.0\.0$"


def _dotted(high: Column, low: Column) -> Column:
    number = lambda c: F.conv(c, 16, 10).cast("int")
    byte = lambda c, k: F.shiftright(number(c), k).bitwiseAND(F.lit(255)).cast("string")
    return F.concat_ws(".", byte(high, 8), byte(high, 0), byte(low, 8), byte(low, 0))


def is_safe_host(scheme: Column, host: Column) -> Column:
    """False for loopback, private, link-local, metadata, mapped and numeric addresses, internal names and rebinding services."""
    h = bare_host(host)
    bare = F.regexp_replace(h, r"^\[|\]$", "")
    dotted = F.regexp_extract(bare, r"(?i)^(?:0*:)*:?(?:ffff:?)?((?:\d{1,3}\.){3}\d{1,3})$", 1)
    groups = r"(?i)^(?:0*:)*:?(?:ffff:)?([0-9a-f]{1,4}):([0-9a-f]{1,4})$"
    mapped = F.when(bare.rlike(groups), _dotted(F.regexp_extract(bare, groups, 1), F.regexp_extract(bare, groups, 2))).otherwise("")
    unsafe = [
        h.isin("localhost", "::1", "[::1]", "home.arpa", "localdomain"),
        h.rlike(_PRIVATE),
        bare.rlike(r"(?i)^(?:fc|fd|fe80)"),
        bare.rlike(r"^(?:0*:){7}0*1$") | (bare == "::1"),
        dotted.rlike(_PRIVATE),
        mapped.rlike(_PRIVATE),
        ends_any(h, INTERNAL_ENDS + REBINDING_ENDS),
        h.rlike(r"^\d+$") | h.rlike(r"(?i)^0x[0-9a-f]+$"),
        ~scheme.isin("http", "https"),
    ]
    return F.coalesce(~reduce(lambda a, b: a | b, unsafe), F.lit(False))


#: URLs that every parser reads alike: lower-case names ending in letters, and encoded paths.
_CLEAN = r"^https?://(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,63}(?:[/?#][A-Za-z0-9/?#&=%._~+,;:@!$*()-]*)?$"


def is_safe(url: Column, parts: Column) -> Column:
    """Valid and not internal, by the struct of the URL's parts."""
    return is_http(url, parts["scheme"]) & is_safe_host(parts["scheme"], parts["host"])


def safe_pages(pages: DataFrame, url: str = "url") -> DataFrame:
    """Rows whose URL is valid and safe to fetch. Clean URLs are read in the JVM; the parsing UDF sees only the others."""
    clean = F.coalesce(F.col(url).rlike(_CLEAN), F.lit(False))
    scheme, host = plain_parts(F.col(url))
    made = pages.withColumn("__parts", parsed(F.when(~clean, F.col(url))))
    made = made.withColumn("__parts", F.struct(F.when(clean, scheme).otherwise(F.col("__parts.scheme")).alias("scheme"), F.when(clean, host).otherwise(F.col("__parts.host")).alias("host")))
    return made.where(is_safe(F.col(url), F.col("__parts"))).drop("__parts")


def _parameters(search: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(search, r"^\?", ""), "&"), lambda p: p != "")


def target_url(path: Column, search: Column) -> Column:
    """The target of a request path and its query, or null: decode, repair the scheme, drop our own parameters."""
    raw = F.substring(path, 2, 1 << 30)
    decoded = F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))
    raw = F.when(F.coalesce(decoded.rlike("^https?://"), F.lit(False)), decoded).otherwise(raw)
    raw = F.regexp_replace(raw, r"^(https?)//", "$1://")
    raw = F.when(raw.rlike("^https?://"), raw).when(raw.contains(".") & ~raw.startswith("."), F.concat(F.lit("https://"), raw))
    kept = F.filter(_parameters(F.coalesce(search, F.lit(""))), lambda p: ~F.substring_index(p, "=", 1).isin(OWN_PARAMETERS))
    pairs = F.transform(kept, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))))
    joined = F.array_join(pairs, "&")
    out = F.when(F.size(kept) > 0, F.concat(raw, F.when(raw.contains("?"), "&").otherwise("?"), joined)).otherwise(raw)
    return F.when((F.length(path) > 1) & (F.length(out) <= MAX_URL), out)


def _encoded(text: Column) -> Column:
    """Percent-encoded as a path part: spaces as %20, and !'()*~ as they are."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def request_path(url: Column, **options: Column) -> Column:
    """``/<encoded url>?raw=true&...``; options selector, force_browser, no_cache, engine, token where they are set."""
    tail = [F.when(F.coalesce(options[k] != "", F.lit(False)), F.concat(F.lit(f"&{k}="), F.url_encode(options[k]))).otherwise("") for k in ("selector", "force_browser", "no_cache", "engine", "token") if k in options]
    return F.concat(F.lit("/"), _encoded(url), F.lit("?raw=true"), *tail)


def registrable(host: Column) -> Column:
    """The last two labels, or three below the listed two-part suffixes; short hosts as they are."""
    parts = F.split(F.regexp_replace(host, r"\.+$", ""), r"\.")
    last = lambda n: F.array_join(F.slice(parts, -n, n), ".")
    return F.when(F.size(parts) <= 2, host).when(last(2).isin(TWO_PART_SUFFIXES), last(3)).otherwise(last(2))


def matches_glob(text: Column, patterns: list[str]) -> Column:
    """Whole-text, case-insensitive match of any glob of * and ?; no pattern passes all."""
    globs = [p.strip() for p in patterns if p.strip()]
    if not globs:
        return F.lit(True)
    regex = ["".join(".*" if c == "*" else "." if c == "?" else literal(c) for c in g) for g in globs]
    return F.coalesce(text.rlike("(?i)^(?:" + "|".join(regex) + ")$"), F.lit(False))


def configured_domain(domain: str) -> str:
    """A configured domain, or URL, as a bare lower-case host."""
    text = domain.strip()
    if not text:
        return ""
    url = whatwg.parse(text if "://" in text else f"https://{text}")
    return url.host.rstrip(".") if url else text.rpartition("://")[2].split("/")[0].split(":")[0].strip().lower().rstrip(".")


def in_domains(host: Column, domains: list[str]) -> Column:
    return reduce(lambda a, d: a | (host == d) | host.endswith("." + d), [d for d in map(configured_domain, domains) if d], F.lit(False))


def passes_domains(host: Column, allow: list[str] = (), block: list[str] = ()) -> Column:
    """Block beats allow; no allowed domain allows all; a host that did not parse fails."""
    h = F.regexp_replace(F.lower(host), r"\.+$", "")
    allowed = in_domains(h, list(allow)) if any(map(configured_domain, allow)) else F.lit(True)
    return F.coalesce(~in_domains(h, list(block)) & allowed, F.lit(False))


def domain_matches(df: DataFrame, host: str, domains: DataFrame, key: str = "domain") -> DataFrame:
    """Rows of ``df`` joined to every row of ``domains`` that names their host or a parent of it.

    The suffix test becomes an equality: each host's own suffixes are exploded, so a
    long list of domains is hash-joined however many hosts there are.
    """
    parts = F.split(F.lower(F.col(host)), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return df.withColumn("__suffix", F.explode(suffixes)).join(domains.withColumnRenamed(key, "__domain"), F.col("__suffix") == F.col("__domain")).withColumnRenamed("__domain", key).drop("__suffix")


def passes_content_type(content_type: Column, allowed: list[str]) -> Column:
    kinds = [a.strip().lower() for a in allowed if a.strip()]
    if not kinds:
        return F.lit(True)
    return F.coalesce(content_type, F.lit("")).isin("") | has_any(F.lower(content_type), kinds)


def all_of(*conditions: Column) -> Column:
    """The conjunction; each part must be total, since Spark does not promise their order."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def composite_score(*scores: Column) -> Column:
    """The sum of scorers' Columns; nothing scores zero."""
    return reduce(lambda a, b: a + b, scores, F.lit(0.0))


def keyword_score(url: Column, anchor: Column, keywords: list[str], weight: float = 1.0) -> Column:
    """``weight`` for each distinct-position keyword in the URL or its anchor text."""
    words = [k.strip().lower() for k in keywords if k.strip()]
    text = F.lower(F.concat_ws(" ", url, F.coalesce(anchor, F.lit(""))))
    return reduce(lambda a, k: a + text.contains(k).cast("double"), words, F.lit(0.0)) * F.lit(float(weight))


def ttl_seconds(url: Column) -> Column:
    return F.when(has_any(url, LONG_TTL_MARKS), 3600).when(has_any(url, SHORT_TTL_MARKS), 600).otherwise(3600)


def platform(host: Column, path: Column) -> Column:
    """The target platform by the first host rule that holds; null hosts are invalid."""
    named = lambda exact, ends: reduce(lambda a, b: a | b, [*(host == x for x in exact), *(host.endswith(x) for x in ends)])
    rules = [(named(exact, ends), label) for label, exact, ends in PLATFORM_HOSTS]
    return first_case([(host.isNull(), "invalid_url"), *rules, (F.lower(path).endswith(".pdf"), "pdf")], "generic")


def pacing_domain(netloc: Column) -> Column:
    return F.when(F.coalesce(netloc, F.lit("")) == "", "__default__").otherwise(netloc)


def job_path(path: Column) -> Column:
    """struct(id, action) of ``/api/jobs/<id>[/<action>]``; nulls for other paths."""
    found = F.regexp_extract(path, r"^/api/jobs/([^/]+)(?:/([^/]+))?/?$", 1)
    action = F.regexp_extract(path, r"^/api/jobs/([^/]+)(?:/([^/]+))?/?$", 2)
    return F.struct(F.nullif(found, F.lit("")).alias("id"), F.nullif(action, F.lit("")).alias("action"))


def cookie(header: Column, name: str) -> Column:
    """A cookie's value from a Cookie header, or null."""
    pairs = F.filter(F.split(F.coalesce(header, F.lit("")), ";"), lambda p: F.trim(F.substring_index(p, "=", 1)) == name)
    return F.trim(F.regexp_replace(F.get(pairs, F.lit(0)), "^[^=]*=", ""))


MAX_ITEM = 512


def string_list(values: Column, field: str, most: int, longest: int = MAX_ITEM) -> Column:
    """struct(items, error): trimmed and distinct, in order; or the first reason to reject a list. Null is an empty list."""
    trimmed = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: strip(v))
    error = F.coalesce(
        F.when(F.size(trimmed) > most, f"{field} supports at most {most} items."),
        F.when(F.exists(trimmed, lambda v: v.isNull()), f"{field} must only contain strings."),
        F.when(F.exists(trimmed, lambda v: v == ""), f"{field} must only contain non-empty strings."),
        F.when(F.exists(trimmed, lambda v: F.length(v) > longest), f"{field} items must be at most {longest} characters."),
    )
    return F.struct(F.when(error.isNull(), F.array_distinct(trimmed)).alias("items"), error.alias("error"))


def provider_eligible(df: DataFrame, rules: DataFrame, blocked: DataFrame, host: str = "host", adapter: str = "adapter") -> DataFrame:
    """Rows of the generic adapter whose domain has no paywall rule and whose host (``blocked``: host) was not refused before."""
    plain = df.where(F.col(adapter) == "generic")
    plain = plain.join(rules.select(F.col("domain").alias("__d")), registrable(F.col(host)) == F.col("__d"), "left_anti")
    return plain.join(blocked.select(F.col("host").alias("__h")), F.col(host) == F.col("__h"), "left_anti")
