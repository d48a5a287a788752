"""Redaction, dimensions and identifiers: what may be stored of a request."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import BOUNDARY as B
from .text import collapse, strip

# --- fixed values: patterns of secrets ------------------------------------------------
_EMAIL = r"[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
_BEARER = r"Bearer\s+[A-Za-z0-9._~+/-]+=*"
REDACTIONS = [
    (r"https?://[^\s\"'<>]+", "[url]"),
    (r"\bAuthorization\s*:\s*(?:Bearer|Basic|Digest)\s+[A-Za-z0-9._~+/-]+=*", "Authorization: [redacted]"),
    (r"\b((?:Cookie|Set-Cookie)\s*):\s*[^\r\n<>]+", "$1: [redacted]"),
    (rf"\b{_BEARER}", "Bearer [redacted]"),
    (r"\b(authorization|bearer|token|access_token|refresh_token|api_key|apikey|key|secret|password|passwd|session|cookie|code|signature)=([^&\s\"'<>]+)", "$1=[redacted]"),
    (r"[\"']?\b([A-Za-z0-9_.-]*(?:access_token|refresh_token|api_key|apikey|authorization|bearer|token|secret|key|password|passwd|session|cookie|csrf|xsrf|jwt|sid|clearance|signature|sig|code)[A-Za-z0-9_.-]*)\b[\"']?\s*[:=]\s*[\"']?([^\"'\s,;}<>]+)", "$1=[redacted]"),
    (rf"\b{_EMAIL}\b", "[email]"),
]
SENSITIVE = [
    r"https?://",
    rf"\b{_EMAIL}\b",
    rf"\b{_BEARER}",
    r"\b(?:sk|pk|mk|fc|ghp|gho|ghu|ghs|xoxb|xoxp)[_-][A-Za-z0-9_-]{8,}\b",
    r"\b(?:access_token|refresh_token|api_key|apikey|authorization|bearer|token|secret|password|passwd|session|cookie|csrf|xsrf|jwt|signature)\b",
    r"(?:^|[^A-Za-z0-9])(?:access_token|refresh_token|api_key|apikey|auth|authorization|bearer|token|secret|password|passwd|session|cookie|csrf|xsrf|jwt|sid|signature|sig)[_-][A-Za-z0-9_-]{8,}",
    r"[A-Za-z0-9_-]{40,}",
]
_SENSITIVE_KEY = "^(?:access_token|auth|authorization|bearer|code|cookie|email|key|password|passwd|refresh_token|secret|session|signature|sig|token)$"
_SENSITIVE_HOST = "token|secret|key|auth|session|jwt|password|passwd|email|phone|login|signin|verify|reset|magic"
_EXTENSIONS = "html?|md|txt|pdf|docx?|xlsx?|csv|json"
ENGINES = ["native", "jina", "firecrawl", "cf"]
# --------------------------------------------------------------------------------------


def _java(pattern: str) -> str:
    return "(?i)" + pattern.replace(r"\b", B)


#: What a text must hold for each of REDACTIONS to find anything: tests that cost little beside the pattern.
_NEEDS = [r"(?i)http", r"(?i)authorization", r"(?i)cookie", r"(?i)bearer", r"=", r"(?i)(?:token|key|author|bearer|secret|passw|session|cookie|[cx]srf|jwt|sid|clearance|sig|code)[A-Za-z0-9_.-]*+[\"']?\s*[:=]", r"@"]


def redacted(text: Column) -> Column:
    """URLs, credentials, key=value secrets and e-mail addresses replaced, in that order.

    No replacement brings in what a later pattern needs, so the needs are tested on the
    text as it came.
    """
    steps = zip(_NEEDS, REDACTIONS, strict=True)
    return reduce(lambda c, s: F.when(text.rlike(s[0]), F.regexp_replace(c, _java(s[1][0]), s[1][1])).otherwise(c), steps, text)


def redacted_sql(text: str) -> str:
    """The same in DuckDB, whose word boundary is ASCII as it stands."""
    quoted = lambda p: p.replace("'", "''")
    return reduce(lambda c, s: f"regexp_replace({c}, '{quoted(s[0])}', '{quoted(s[1].replace('$1', chr(92) + '1'))}', 'gi')", REDACTIONS, text)


def is_sensitive(text: Column) -> Column:
    t = strip(text)
    return F.coalesce((t != "") & reduce(lambda a, p: a | t.rlike(_java(p)), SENSITIVE, F.lit(False)), F.lit(False))


def error_text(message: Column, most: int = 240) -> Column:
    return F.substring(collapse(redacted(message)), 1, most)


def debug_text(text: Column, most: int = 2000) -> Column:
    return F.substring(strip(F.replace(redacted(text), F.lit("\r"), F.lit(""))), 1, most)


def dimension(value: Column) -> Column:
    """Lower case, other characters as one underscore, none at the ends, 120 characters."""
    lowered = F.lower(strip(F.coalesce(value.cast("string"), F.lit(""))))
    return F.substring(F.regexp_replace(F.regexp_replace(lowered, "[^a-z0-9_+.-]+", "_"), "^_+|_+$", ""), 1, 120)


def error_code(title: Column, outcome: Column, status: Column) -> Column:
    source = F.coalesce(F.nullif(title, F.lit("")), F.nullif(outcome, F.lit("")), F.concat(F.lit("status_"), status.cast("string")))
    code = F.substring(F.replace(dimension(source), F.lit("-"), F.lit("_")), 1, 80)
    return F.when(outcome == "success", "").when(code == "", "error").otherwise(code)


def engine(value: Column) -> Column:
    d = dimension(value)
    return F.when(d == "", "").when(d.isin(ENGINES), d).otherwise("custom")


def fallback_list(values: Column) -> Column:
    """The first eight as dimensions, blanks dropped after the cut."""
    return F.filter(F.transform(F.slice(values, 1, 8), lambda v: F.substring(dimension(v), 1, 80)), lambda v: v != "")


def clamped(text: Column, most: int) -> Column:
    short = F.substring(text, 1, most) if most <= 3 else F.concat(F.substring(text, 1, most - 3), F.lit("..."))
    return F.when(F.length(text) <= most, text).otherwise(short)


def redacted_host(host: Column) -> Column:
    h = F.lower(F.coalesce(host, F.lit("")))
    labels = F.filter(F.split(h, r"\."), lambda x: x != "")
    odd = (h == "") | h.contains("@") | h.rlike(_SENSITIVE_HOST) | h.rlike("^[a-f0-9:.]+$") | F.exists(labels, lambda x: (F.length(x) > 63) | x.rlike("^[A-Za-z0-9_-]{24,}$"))
    return F.when(odd, "[host]").when(F.size(labels) <= 2, h).otherwise(F.concat(F.lit("*."), F.array_join(F.slice(labels, -2, 2), ".")))


def safe_extension(segment: Column) -> Column:
    found = F.regexp_extract(F.lower(F.coalesce(F.try_url_decode(segment), segment)), r"\.([a-z0-9]{1,8})$", 1)
    return F.when(found.rlike(f"^(?:{_EXTENSIONS})$"), F.concat(F.lit("."), found)).otherwise("")


def redacted_path(path: Column) -> Column:
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    n = F.least(F.size(parts), F.lit(99)).cast("string")
    return F.when(F.size(parts) == 0, "/").otherwise(F.concat(F.lit("/[path:"), n, F.lit("]"), safe_extension(F.get(parts, F.size(parts) - 1))))


def debug_url(scheme: Column, host: Column, path: Column, query: Column) -> Column:
    """A URL's outline: redacted host and path, and positions in place of parameters."""
    parts = F.filter(F.split(F.coalesce(query, F.lit("")), "&"), lambda p: p != "")

    def outline(p, i):
        key = F.coalesce(F.try_url_decode(F.substring_index(p, "=", 1)), F.substring_index(p, "=", 1))
        hidden = key.rlike("(?i)" + _SENSITIVE_KEY) | is_sensitive(key)
        n = (i + 1).cast("string")
        return F.when(hidden, F.concat(F.lit("redacted_"), n, F.lit("=%5Bredacted%5D"))).otherwise(F.concat(F.lit("param_"), n, F.lit("=%5Bvalue%5D")))

    joined = F.array_join(F.transform(parts, outline), "&")
    tail = F.when(joined == "", "").otherwise(F.concat(F.lit("?"), joined))
    text = F.concat(scheme, F.lit("://"), redacted_host(host), redacted_path(path), tail)
    return F.coalesce(clamped(text, 512), F.lit("[invalid-url]"))


def request_id(incoming: Column) -> Column:
    """The caller's id, cleaned, if it is long enough and no secret; otherwise a new one."""
    trimmed = strip(F.coalesce(incoming, F.lit("")))
    clean = F.substring(F.regexp_replace(trimmed, "[^A-Za-z0-9._:-]", ""), 1, 80)
    return F.when(~is_sensitive(trimmed) & ~is_sensitive(clean) & (F.length(clean) >= 8), clean).otherwise(F.uuid())


def hmac_sha256(salt: str, value: Column, chars: int = 32) -> Column:
    """Hex HMAC-SHA-256, shortened; empty without a salt or a value. Two nested digests, no UDF."""
    if not salt:
        return F.lit("")
    import hashlib

    key = salt.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    digest = F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(value, "UTF-8")), 256))), 256)
    return F.when(F.coalesce(value, F.lit("")) == "", "").otherwise(F.substring(digest, 1, chars))


def url_hash(text: Column) -> Column:
    """The first 16 hex digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def cache_key(url: Column, kind: Column, selector: Column, engine_name: Column) -> Column:
    blank = lambda c: F.coalesce(c, F.lit(""))
    name = F.when(blank(engine_name) == "", "default").otherwise(engine_name)
    return F.concat_ws("/", F.lit("https://md-cache/v1"), kind, name, url_hash(F.concat_ws("|", url, blank(selector), blank(engine_name))))


def image_key(url: Column, content_type: Column) -> Column:
    """``images/<sha256 of the URL>.<extension>``."""
    ext = F.trim(F.split_part(F.split_part(content_type, F.lit("/"), F.lit(2)), F.lit(";"), F.lit(1)))
    ext = F.when(ext == "", "bin").otherwise(ext)
    fmt = F.regexp_extract(url, r"wx_fmt=([A-Za-z0-9_]+)", 1)
    ext = F.when(ext.isin("bin", "octet-stream") & url.contains("mmbiz.qpic.cn") & (fmt != ""), fmt).otherwise(ext)
    return F.concat(F.lit("images/"), F.sha2(url, 256), F.lit("."), ext)
