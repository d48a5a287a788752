"""Buckets, classes and clamps of requests and events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import first_case, has_any

# --- fixed values -------------------------------------------------------------------
CREDIT_COSTS = {"convert": 1, "stream": 1, "batch": 1, "extract": 3, "deepcrawl": 2}
ROUTE_LIMITS = {"batch": 10, "stream": 30}
DEFAULT_LIMIT = 20
KEYLESS_ENGINES = ["jina", "firecrawl"]
TRANSIENT_MARKS = ["timed out", "timeout", "econnreset", "connection reset", "socket hang up", "temporarily unavailable", "service unavailable", "internal error", "network"]
STATUS_MOVES = [("queued", "running"), ("queued", "canceled"), ("queued", "failed"), ("running", "succeeded"), ("running", "failed"), ("running", "canceled")]
# ------------------------------------------------------------------------------------


def _steps(value: Column, edges: list[tuple[float, str]], last: str, inclusive: bool) -> Column:
    return first_case([(value <= e if inclusive else value < e, label) for e, label in edges], last)


def duration_bucket(ms: Column) -> Column:
    return _steps(ms, [(250, "lt_250ms"), (1000, "250ms_1s"), (3000, "1s_3s"), (10000, "3s_10s"), (30000, "10s_30s")], "gte_30s", False)


def size_bucket(size: Column) -> Column:
    edges = [(1 << 10, "lt_1kb"), (10 << 10, "1kb_10kb"), (100 << 10, "10kb_100kb"), (1 << 20, "100kb_1mb")]
    return F.when(size.isNull() | F.isnan(size.cast("double")), "unknown").otherwise(_steps(size, edges, "gte_1mb", False))


def selector_bucket(selector: Column) -> Column:
    n = F.length(selector)
    return F.when(F.coalesce(selector, F.lit("")) == "", "none").otherwise(_steps(n, [(32, "1_32"), (128, "33_128")], "129_plus", True))


def quota_bucket(value: Column) -> Column:
    edges = [(0, "none"), (10, "1_10"), (100, "11_100"), (1000, "101_1000")]
    return F.when(value.isNull(), "unknown").otherwise(_steps(value, edges, "gt_1000", True))


def user_agent_family(agent: Column) -> Column:
    ua = F.lower(F.coalesce(agent, F.lit("")))
    any_of = lambda *x: has_any(ua, list(x))
    rules = [
        (ua == "", "unknown"),
        (any_of("curl/"), "curl"),
        (any_of("python"), "python"),
        (any_of("postmanruntime"), "postman"),
        (any_of("axios", "undici", "node"), "node"),
        (any_of("bot", "crawler", "spider"), "bot"),
        (any_of("mozilla/", "chrome/", "safari/", "firefox/", "edg/"), "browser"),
    ]
    return first_case(rules, "other")


def route_limit(route: Column) -> Column:
    return first_case([(route == k, F.lit(v)) for k, v in ROUTE_LIMITS.items()], F.lit(DEFAULT_LIMIT))


def credit_cost(route: Column) -> Column:
    return first_case([(route == k, F.lit(v)) for k, v in CREDIT_COSTS.items()], F.lit(1))


def policy(tier: Column, quota_limit: Column, quota_used: Column, route: Column) -> Column:
    """Capabilities and cost of a tier on a route, as a struct."""
    known = tier != "anonymous"
    return F.struct(
        F.when(known, F.when(tier == "free", "free").otherwise("pro")).otherwise("anonymous").alias("tier"),
        known.alias("browser_allowed"),
        (known & (tier != "free")).alias("proxy_allowed"),
        (known & (tier != "free")).alias("engine_selection_allowed"),
        (known & (tier != "free")).alias("no_cache_allowed"),
        F.when(known, F.greatest(F.lit(0), quota_limit - quota_used)).otherwise(0).alias("quota_remaining"),
        F.when(known, credit_cost(route)).otherwise(0).alias("credit_cost"),
    )


def policy_violation(rules: Column, force_browser: Column, no_cache: Column, engine: Column) -> Column:
    """The first rule that a request breaks, or null."""
    wants = F.coalesce(engine, F.lit("")) != ""
    return F.coalesce(
        F.when(force_browser & ~rules["browser_allowed"], "force_browser requires an API key."),
        F.when(no_cache & ~rules["no_cache_allowed"], "no_cache requires a Pro API key."),
        F.when(wants & ~rules["engine_selection_allowed"] & ~engine.isin(KEYLESS_ENGINES), "engine selection requires a Pro API key."),
    )


def retry_delay_ms(attempt: Column, base: int = 80, most: int = 400) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2), attempt), F.lit(most)).cast("long")


def half_up(value: Column, digits: int = 3) -> Column:
    """Rounded with halves toward plus infinity."""
    p = 10**digits
    return F.floor(value * p + 0.5) / p


def _clamped(value: Column, low: int, high: int, default: int, rounded: bool) -> Column:
    number = F.floor(value + 0.5) if rounded else F.floor(value)
    usable = value.isNotNull() & ~F.isnan(value.cast("double")) & (F.abs(value) < float("inf"))
    return F.when(usable if rounded else usable & (value > 0), F.least(F.greatest(number, F.lit(low)), F.lit(high))).otherwise(default).cast("int")


def priority(value: Column) -> Column:
    return _clamped(value.cast("double"), 1, 100, 10, True)


def max_retries(value: Column) -> Column:
    return _clamped(value.cast("double"), 0, 10, 2, True)


def retention_days(value: Column) -> Column:
    return _clamped(value.try_cast("double"), 1, 14, 7, False)


def excerpt_limit(value: Column) -> Column:
    return _clamped(value.try_cast("double"), 256, 5000, 2000, False)


def flag(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value)).isin("1", "true", "yes", "on"), F.lit(False))


def as_int(value: Column) -> Column:
    return value.cast("int")


def retryable_status(status: Column) -> Column:
    return (status == 429) | status.between(500, 599)


def transient_error(message: Column) -> Column:
    return has_any(F.lower(message), TRANSIENT_MARKS)


def valid_move(before: Column, after: Column) -> Column:
    """Whether a job's status may follow another."""
    out = before == after
    for a, b in STATUS_MOVES:
        out = out | ((before == a) & (after == b))
    return out


def remaining_retries(most: Column, used: Column) -> Column:
    return F.greatest(F.lit(0), most - F.greatest(F.lit(0), F.coalesce(used, F.lit(0))))


def runnable(status: Column, most: Column, used: Column) -> Column:
    return (status == "queued") | ((status == "failed") & (remaining_retries(most, used) > 0))


def source_content_type(method: Column, given: Column) -> Column:
    markdown = method.isin("jina", "firecrawl", "native")
    return F.coalesce(F.nullif(given, F.lit("")), F.when(markdown, "text/markdown").otherwise("text/html"))


def wants_json(accept: Column) -> Column:
    return F.coalesce(has_any(accept, ["application/json", "text/markdown"]), F.lit(False))


def is_navigation(method: Column, accept: Column, fetch_dest: Column) -> Column:
    """A browser's document navigation, by its headers."""
    page = F.coalesce(accept.contains("text/html") & ~wants_json(accept), F.lit(False))
    return (method == "GET") & (F.coalesce(fetch_dest == "document", F.lit(False)) | page)
