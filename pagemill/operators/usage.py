"""Keys, accounts, quotas and daily usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frames import one_each
from ..functions import classify

# --- fixed values --------------------------------------------------------------------
TIER_QUOTAS = {"anonymous": 0, "free": 1000, "pro": 50_000}
KEY_PREFIX, MAX_KEYS = "mk_", 10
MEASURES = ["requests", "credits", "browser_calls", "cache_hits"]
# -------------------------------------------------------------------------------------


def tier_quota(tier: Column) -> Column:
    return F.when(tier == "pro", TIER_QUOTAS["pro"]).when(tier == "free", TIER_QUOTAS["free"]).otherwise(TIER_QUOTAS["anonymous"])


def resolved_keys(requests: DataFrame, keys: DataFrame, accounts: DataFrame, now: Column) -> DataFrame:
    """Requests (key_hash) with tier, account_id, key_id, quota_limit, quota_used; unknown and revoked keys are anonymous.

    Usage counts from zero once the reset date has passed.
    """
    known = keys.where("revoked_at is null").join(accounts, "account_id")
    one = known.groupBy("key_hash").agg(F.min(F.struct("key_id", "account_id", "tier", "monthly_credits_used", "monthly_credits_reset_at")).alias("k"))
    made = requests.join(one, "key_hash", "left")
    there = F.col("k").isNotNull()
    tier = F.when(there, F.when(F.col("k.tier") == "pro", "pro").otherwise("free")).otherwise("anonymous")
    used = F.when(there, F.when(now >= F.col("k.monthly_credits_reset_at"), 0).otherwise(F.col("k.monthly_credits_used"))).otherwise(0)
    return made.select(*requests.columns, tier.alias("tier"), F.col("k.account_id").alias("account_id"), F.col("k.key_id").alias("key_id"), tier_quota(tier).alias("quota_limit"), used.alias("quota_used"))


def resolved_sessions(requests: DataFrame, sessions: DataFrame, accounts: DataFrame, now: Column) -> DataFrame:
    """Requests (token_hash) that belong to a live session, with its account."""
    live = one_each(sessions.where(F.col("expires_at") >= now), "token_hash")
    return requests.join(live, "token_hash").join(accounts, "account_id")


def daily(events: DataFrame) -> DataFrame:
    """(key_id, date) sums of events (key_id, ts, credit_cost, browser, cache_hit); events without a key don't count."""
    made = events.where(F.coalesce("key_id", F.lit("")) != "").withColumn("date", F.date_format("ts", "yyyy-MM-dd"))
    return made.groupBy("key_id", "date").agg(F.count("*").alias("requests"), F.sum("credit_cost").alias("credits"), F.count_if("browser").alias("browser_calls"), F.count_if("cache_hit").alias("cache_hits"))


def added(stored: DataFrame, fresh: DataFrame, keys: list[str] = ("key_id", "date"), measures: list[str] = tuple(MEASURES)) -> DataFrame:
    """Upsert by addition: one aggregation of both, on the keys."""
    return stored.unionByName(fresh).groupBy(*keys).agg(*(F.sum(m).alias(m) for m in measures))


def account_credits(accounts: DataFrame, keys: DataFrame, usage: DataFrame, since: Column) -> DataFrame:
    """Accounts with the credits their keys used on or after a date, the quota and what is left of it."""
    spent = usage.where(F.col("date") >= since).join(keys.select("key_id", "account_id"), "key_id").groupBy("account_id").agg(F.sum("credits").alias("used"))
    made = accounts.join(spent, "account_id", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    quota = tier_quota(F.when(F.col("tier").isin("pro", "enterprise"), "pro").otherwise("free"))
    return made.withColumn("quota", quota).withColumn("remaining", F.greatest(F.lit(0), F.col("quota") - F.col("used")))


def usage_of(usage: DataFrame, keys: DataFrame, account: Column, since: Column) -> DataFrame:
    """Daily rows of one account's keys from a date on, in order of date."""
    own = keys.where(F.col("account_id") == account).select("key_id")
    return usage.where(F.col("date") >= since).join(own, "key_id", "left_semi").orderBy("date")


def keys_over_cap(keys: DataFrame, most: int = MAX_KEYS) -> DataFrame:
    """Accounts with as many active keys as the cap allows, or more."""
    return keys.where("revoked_at is null").groupBy("account_id").agg(F.count("*").alias("active")).where(F.col("active") >= most)


def listed_keys(keys: DataFrame, account: Column) -> DataFrame:
    return keys.where(F.col("account_id") == account).orderBy(F.desc("created_at"))


def with_policy(requests: DataFrame, route: str = "route") -> DataFrame:
    """Requests (tier, quota_limit, quota_used, force_browser, no_cache, engine) with their policy and the rule they break."""
    made = requests.withColumn("policy", classify.policy(F.col("tier"), F.col("quota_limit"), F.col("quota_used"), F.col(route)))
    return made.withColumn("violation", classify.policy_violation(F.col("policy"), F.col("force_browser"), F.col("no_cache"), F.col("engine")))
