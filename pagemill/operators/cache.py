"""The result cache, session profiles and bounded stores, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pages, privacy, urls

HOT, KEYS, RETRIES = 256, 512, 256
MAX_COOKIES, MAX_ITEMS, MAX_VALUE = 200, 200, 4096
FAILURES, DISABLE_MINUTES = 3, 15


def lookups(requests: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """Requests (url, format, selector, engine) with the live, usable payload of their key, and ``hit``."""
    key = privacy.cache_key(F.col("url"), F.col("format"), F.col("selector"), F.col("engine"))
    live = cache.where(F.col("expires_at") > now).select("key", "content", "method", "title", "source_content_type")
    made = requests.withColumn("key", key).join(live, "key", "left")
    ok = pages.is_usable(F.col("url"), F.col("content"), F.col("method"))
    shown = [F.when(ok, F.col(c)).alias(c) for c in ("content", "method", "title", "source_content_type")]
    return made.select(*requests.columns, "key", ok.alias("hit"), *shown)


def entries(results: DataFrame, now: Column) -> DataFrame:
    """Cache rows of results (url, format, selector, engine, content, method, title, source_content_type) that can be served; the time to live follows the URL."""
    key = privacy.cache_key(F.col("url"), F.col("format"), F.col("selector"), F.col("engine"))
    ttl = urls.ttl_seconds(F.col("url"))
    made = results.where(pages.is_usable(F.col("url"), F.col("content"), F.col("method")))
    return made.select(key.alias("key"), "content", "method", "title", "source_content_type", (now + F.make_dt_interval(secs=ttl)).alias("expires_at"), now.alias("written_at"))


def latest(stored: DataFrame, fresh: DataFrame, key: str = "key", at: str = "written_at") -> DataFrame:
    """Upsert: of all rows of a key, the one written last. An aggregation, so a hot key is combined before it is moved."""
    rest = [c for c in stored.columns if c not in (key, at)]
    both = stored.unionByName(fresh)
    top = both.groupBy(key).agg(F.max_by(F.struct(at, *rest), at).alias("__t"))
    return top.select(key, "__t.*").select(*stored.columns)


def most_recent(entries: DataFrame, at: str, most: int, now: Column | None = None, expires: str = "expires_at") -> DataFrame:
    """A bounded store: live rows, and of them the ``most`` touched last."""
    kept = entries if now is None else entries.where(F.col(expires) > now)
    return kept.orderBy(F.desc(at)).limit(most)


def profile_scope(scope: Column) -> Column:
    return F.nullif(F.substring(F.regexp_replace(F.trim(F.coalesce(scope, F.lit(""))), "[^A-Za-z0-9._:-]", "_"), 1, 128), F.lit(""))


def profile_key(scope: Column, scheme: Column, host: Column, prefix: str = "session:profile:") -> Column:
    """prefix, scope and host, or null for a blank scope or no web address."""
    return F.when(scheme.isin("http", "https"), F.concat(F.lit(prefix), profile_scope(scope), F.lit(":"), host))


def clipped(value: Column, most: int = MAX_VALUE) -> Column:
    """At most ``most`` bytes of UTF-8; a cut character reads as the replacement character."""
    data = value.cast("binary")
    cut = F.substring(data, 1, most).cast("string")
    # the next byte says whether a character is cut; only then are the bytes looked at
    inside = F.substring(data, most + 1, 1).between(F.lit(b"\x80"), F.lit(b"\xbf"))
    return F.when(F.octet_length(value) <= most, value).when(inside, F.make_valid_utf8(cut)).otherwise(cut)


def snapshot(profiles: DataFrame) -> DataFrame:
    """Profiles (cookies ARRAY<STRUCT<name, value, ...>>, local_storage MAP) within the caps."""
    cookies = F.slice(F.filter("cookies", lambda c: c["name"].isNotNull() & c["value"].isNotNull()), 1, MAX_COOKIES)
    items = F.slice(F.filter(F.map_entries("local_storage"), lambda e: e["value"].isNotNull()), 1, MAX_ITEMS)
    stored = F.map_from_entries(F.transform(items, lambda e: F.struct(e["key"].alias("key"), clipped(e["value"]).alias("value"))))
    return profiles.withColumns({"cookies": cookies, "local_storage": stored})


def saved(existing: DataFrame, fresh: DataFrame, now: Column) -> DataFrame:
    """Fresh snapshots over existing profiles (key, created_at, updated_at, failure_count, disabled_until, ...): creation dates stay, failures clear."""
    old = existing.select("key", F.col("created_at").alias("__created"))
    made = fresh.join(old, "key", "left").withColumns({"created_at": F.coalesce("__created", now), "updated_at": now, "failure_count": F.lit(0), "disabled_until": F.lit(None).cast("timestamp")}).drop("__created")
    return existing.join(fresh.select("key"), "key", "left_anti").unionByName(made.select(existing.columns))


def cleared(profiles: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    """Profiles with the failures of the given keys cleared."""
    hit = F.col("__hit").isNotNull()
    made = profiles.join(keys.select("key").distinct().withColumn("__hit", F.lit(True)), "key", "left")
    return made.withColumns({"failure_count": F.when(hit, 0).otherwise(F.col("failure_count")), "disabled_until": F.when(~hit, F.col("disabled_until")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))}).drop("__hit")


def is_disabled(until: Column, now: Column) -> Column:
    """Whether a profile is disabled; a bad date disables nothing."""
    return F.coalesce(F.try_to_timestamp(until) > now, F.lit(False))
