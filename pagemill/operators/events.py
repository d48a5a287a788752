"""Conversion events: privacy-safe rows, hourly roll-ups, service metrics and expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify, privacy, urls

DIMENSIONS = ["date", "hour", "route", "outcome", "status_code", "error_code", "auth_tier", "account_hash", "key_hash", "target_platform", "target_host_hash", "country", "format", "engine_requested", "method_used", "cache_status", "browser_rendered", "paywall_detected", "duration_bucket", "output_size_bucket", "selector_present", "selector_length_bucket", "force_browser", "no_cache"]
LATENCY_WINDOW = 1024
SLO = {"conversion_success_rate_min": 0.95, "convert_p95_max_ms": 12_000, "job_retry_rate_max": 0.15, "browser_queue_max_multiple_of_capacity": 2}


def sanitized(requests: DataFrame, salt: str = "") -> DataFrame:
    """The 32 fields that may be kept of each raw request.

    Input columns: request_id, route, outcome, status_code, error_title, auth_tier,
    account_id, key_id, target_url, user_agent, country, colo, format, engine, method,
    no_cache, cache_hit, browser_rendered, paywall_detected, fallbacks, latency_ms,
    output_chars, selector, force_browser, credit_cost, quota_remaining; ``ts`` passes through.
    """
    r = urls.with_parts(requests, "target_url", "__p")
    c, no = F.col, lambda x: F.coalesce(F.col(x), F.lit(False))
    ms = F.greatest(F.lit(0), F.floor(c("latency_ms") + 0.5)).cast("long")
    return r.select(
        *(["ts"] if "ts" in requests.columns else []),
        "request_id",
        "route",
        "outcome",
        "status_code",
        privacy.error_code(c("error_title"), c("outcome"), c("status_code")).alias("error_code"),
        F.coalesce("auth_tier", F.lit("anonymous")).alias("auth_tier"),
        F.coalesce(c("account_id") != "", F.lit(False)).alias("has_account"),
        F.coalesce(c("key_id") != "", F.lit(False)).alias("has_key"),
        privacy.hmac_sha256(salt, c("account_id")).alias("account_hash"),
        privacy.hmac_sha256(salt, c("key_id")).alias("key_hash"),
        urls.platform(c("__p.host"), c("__p.path")).alias("target_platform"),
        privacy.hmac_sha256(salt, c("__p.host")).alias("target_host_hash"),
        privacy.hmac_sha256(salt, c("__p.canonical")).alias("target_url_hash"),
        classify.user_agent_family(c("user_agent")).alias("user_agent_family"),
        privacy.dimension(c("country")).alias("country"),
        privacy.dimension(c("colo")).alias("colo"),
        privacy.dimension(F.coalesce("format", F.lit("markdown"))).alias("format"),
        privacy.engine(c("engine")).alias("engine_requested"),
        privacy.dimension(c("method")).alias("method_used"),
        F.when(no("no_cache"), "bypass").when(no("cache_hit"), "hit").otherwise("miss").alias("cache_status"),
        no("browser_rendered").alias("browser_rendered"),
        no("paywall_detected").alias("paywall_detected"),
        privacy.fallback_list(F.coalesce("fallbacks", F.array().cast("array<string>"))).alias("fallbacks"),
        ms.alias("duration_ms"),
        classify.duration_bucket(ms).alias("duration_bucket"),
        classify.size_bucket(c("output_chars")).alias("output_size_bucket"),
        F.coalesce(c("selector") != "", F.lit(False)).alias("selector_present"),
        classify.selector_bucket(c("selector")).alias("selector_length_bucket"),
        no("force_browser").alias("force_browser"),
        no("no_cache").alias("no_cache"),
        F.greatest(F.lit(0), F.floor(F.coalesce("credit_cost", F.lit(0)))).cast("long").alias("credit_cost"),
        classify.quota_bucket(c("quota_remaining")).alias("quota_remaining_bucket"),
    )


def with_hour(events: DataFrame, ts: str = "ts") -> DataFrame:
    return events.withColumns({"date": F.date_format(ts, "yyyy-MM-dd"), "hour": F.date_format(ts, "yyyy-MM-dd'T'HH")})


def rollup(events: DataFrame, dimensions: list[str] | None = None) -> DataFrame:
    """Hourly counts and sums of sanitised events over the dimensions they have; null dimensions group as empty."""
    have = [d for d in dimensions or DIMENSIONS if d in events.columns]
    kinds = dict(events.dtypes)
    blank = {d: F.coalesce(d, F.lit("")) for d in have if kinds[d] == "string"} | {d: F.coalesce(F.col(d).cast("int"), F.lit(0)) for d in have if kinds[d] == "boolean"}
    measures = [F.count("*").alias("request_count"), F.count_if(F.col("outcome") != "success").alias("error_count"), F.sum("duration_ms").alias("duration_ms_sum"), F.sum("credit_cost").alias("credit_cost_sum"), F.max("ts").alias("updated_at")]
    return events.withColumns(blank).groupBy(*have).agg(*measures)


def merged_rollup(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Two roll-ups of the same dimensions as one."""
    keys = [c for c in stored.columns if c not in ("request_count", "error_count", "duration_ms_sum", "credit_cost_sum", "updated_at")]
    sums = [F.sum(c).alias(c) for c in ("request_count", "error_count", "duration_ms_sum", "credit_cost_sum")]
    return stored.unionByName(fresh).groupBy(*keys).agg(*sums, F.max("updated_at").alias("updated_at"))


def debug_traces(requests: DataFrame, salt: str = "", days: int = 7, excerpt: int = 2000) -> DataFrame:
    """Opt-in trace rows of requests (also created_at, content, error_message, source_content_type, trace_source, trace_allowed): redacted, with their expiry."""
    r = urls.with_parts(requests.where("trace_allowed"), "target_url", "__p")
    extra = r.select("request_id", "created_at", F.expr(f"created_at + interval {int(days)} days").alias("expires_at"), privacy.debug_url(F.col("__p.scheme"), F.col("__p.host"), F.col("__p.path"), F.col("__p.query")).alias("target_url_redacted"), F.length("content").alias("output_chars"), privacy.debug_text(F.col("content"), excerpt).alias("output_excerpt"), privacy.error_text(F.col("error_message")).alias("error_message_short"), "source_content_type", F.coalesce("trace_source", F.lit("unknown")).alias("trace_source"))
    safe = sanitized(requests.where("trace_allowed"), salt).drop("ts", "has_account", "has_key", "country", "colo", "target_host_hash")
    return extra.join(safe, "request_id")


def trace_source(header: Column, query: Column) -> Column:
    h, q = classify.flag(header), classify.flag(query)
    return F.when(h & q, "both").when(h, "header").when(q, "query").otherwise("none")


def last_latencies(events: DataFrame, value: str, ts: str = "ts", tie: str = "event_id", most: int = LATENCY_WINDOW) -> DataFrame:
    """The most recent samples, rounded and not below zero: a top-k, not a sort of all."""
    ms = F.greatest(F.lit(0), F.floor(F.coalesce(value, F.lit(0)) + 0.5)).cast("long")
    return events.orderBy(F.desc(ts), F.desc(tie)).limit(most).select(ts, tie, ms.alias("latency_ms"))


def latency_summary(events: DataFrame, value: str = "latency_ms", by: list[str] = ()) -> DataFrame:
    """count, avg (two digits), nearest-rank p50 and p95; zeros of nothing."""
    kind = dict(events.dtypes)[value]
    rank = lambda p: F.coalesce(F.expr(f"percentile_disc({p}) within group (order by {value})"), F.lit(0)).cast(kind)
    return events.groupBy(*by).agg(F.count(value).alias("count"), F.coalesce(classify.half_up(F.avg(value), 2), F.lit(0.0)).alias("avg"), rank(0.5).alias("p50"), rank(0.95).alias("p95"))


def service_snapshot(counters: DataFrame) -> DataFrame:
    """Throughput, rates and backlog of rows of uptime_ms, requests, conversions, failures, created_tasks, executed_tasks, retries, queued."""
    minutes = F.greatest(F.lit(1 / 60), F.col("uptime_ms") / 60_000)
    tries = F.greatest(F.lit(0), F.col("conversions") + F.col("failures"))
    jobs = F.greatest(F.lit(0), F.col("created_tasks") - F.col("executed_tasks"))
    queue = F.greatest(F.lit(0), F.floor("queued"))
    return counters.select(
        classify.half_up(F.col("requests") / minutes).alias("requests_per_min"),
        classify.half_up(F.col("conversions") / minutes).alias("conversions_per_min"),
        classify.half_up(F.when(tries > 0, F.col("conversions") / tries).otherwise(1.0), 4).alias("success_rate"),
        tries.alias("conversion_attempts"),
        classify.half_up(F.when(F.col("executed_tasks") > 0, F.col("retries") / F.col("executed_tasks")).otherwise(0.0), 4).alias("retry_rate"),
        queue.alias("browser_queue"),
        jobs.alias("estimated_job_tasks"),
        (queue + jobs).alias("backlog_total"),
    )


def counters(events: DataFrame, kinds: list[str], column: str = "event_type") -> DataFrame:
    """One row with the count of each kind of event."""
    return events.agg(*(F.count_if(F.col(column) == k).alias(k) for k in kinds))


def live(rows: DataFrame, now: Column, expires: str = "expires_at") -> DataFrame:
    """Rows that have not expired."""
    return rows.where(F.col(expires) > now)


def expired_counts(tables: dict[str, DataFrame], now: Column, expires: str = "expires_at") -> DataFrame:
    """(table, removed, kept) of a cleanup."""
    out = None
    for name, rows in tables.items():
        one = rows.agg(F.count_if(F.col(expires) <= now).alias("removed"), F.count_if(F.col(expires) > now).alias("kept")).select(F.lit(name).alias("table"), "removed", "kept")
        out = one if out is None else out.unionByName(one)
    return out


def failure_streaks(events: DataFrame, key: str, ts: str, failed: Column, tie: str, threshold: int = 3, minutes: int = 15) -> DataFrame:
    """Failure counts that reset at each success and at every ``threshold`` failures, when the key is disabled for a while.

    Gaps and islands: successes so far number the islands, the place in one gives the count.
    """
    order = Window.partitionBy(key).orderBy(ts, tie)
    made = events.withColumn("failed", failed).withColumn("island", F.sum((~F.col("failed")).cast("int")).over(order))
    within = F.sum(F.col("failed").cast("int")).over(Window.partitionBy(key, "island").orderBy(ts, tie))
    made = made.withColumn("streak", within)
    full = F.col("failed") & (F.col("streak") % threshold == 0)
    return made.withColumn("failure_count", F.when(F.col("failed"), F.col("streak") % threshold).otherwise(0)).withColumn("disabled_until", F.when(full, F.expr(f"{ts} + interval {minutes} minutes"))).drop("island", "streak")
