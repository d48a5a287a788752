"""The registered queries on the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, pages, privacy, text, urls
from ..functions.regex import has_any
from ..operators import cache, convert, crawl, events, extract, jobs, links, ratelimit, usage
from ..session import table
from ..sources import pages as sources
from .registry import ORACLE_SQL, QUERIES, SALT, q, query, rows_sql, values  # noqa: F401

# --- events as a request log -----------------------------------------------------------
OUTCOME_SQL = "CASE WHEN event_type = 'error' THEN 'convert_error' ELSE 'success' END"
MS_SQL = "CAST(floor(greatest(0, value * 10) + 0.5) AS BIGINT)"
DURATION_SQL = "CASE WHEN {0} < 250 THEN 'lt_250ms' WHEN {0} < 1000 THEN '250ms_1s' WHEN {0} < 3000 THEN '1s_3s' WHEN {0} < 10000 THEN '3s_10s' WHEN {0} < 30000 THEN '10s_30s' ELSE 'gte_30s' END"


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events read as requests: outcome, duration_ms, credit_cost."""
    e = table(spark, sf_dir, "events")
    ms = F.floor(F.greatest(F.lit(0.0), F.col("value") * 10) + 0.5).cast("long")
    return e.select("event_id", "ts", "user_id", "event_type", "value", F.when(F.col("event_type") == "error", "convert_error").otherwise("success").alias("outcome"), ms.alias("duration_ms"), F.when(F.col("event_type") == "purchase", 3).otherwise(1).cast("long").alias("credit_cost"))


@query(f"""SELECT strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%Y-%m-%dT%H') AS hour, {OUTCOME_SQL} AS outcome, {DURATION_SQL.format(MS_SQL)} AS duration_bucket,
count(*) AS request_count, count(*) FILTER (event_type = 'error') AS error_count, CAST(sum({MS_SQL}) AS BIGINT) AS duration_ms_sum, CAST(sum(CASE WHEN event_type = 'purchase' THEN 3 ELSE 1 END) AS BIGINT) AS credit_cost_sum, max(ts) AS updated_at
FROM events GROUP BY ALL""")
def events_hourly_rollup(spark, sf_dir):
    made = events.with_hour(log(spark, sf_dir)).withColumn("duration_bucket", classify.duration_bucket(F.col("duration_ms")))
    return events.rollup(made)


@query("""SELECT CAST(user_id AS VARCHAR) AS key_id, strftime(ts, '%Y-%m-%d') AS date, count(*) AS requests, CAST(sum(CASE WHEN event_type = 'purchase' THEN 3 ELSE 1 END) AS BIGINT) AS credits,
count(*) FILTER (event_type = 'signup') AS browser_calls, count(*) FILTER (event_type = 'view') AS cache_hits FROM events GROUP BY ALL""")
def events_usage_daily(spark, sf_dir):
    e = log(spark, sf_dir).select(F.col("user_id").cast("string").alias("key_id"), "ts", "credit_cost", (F.col("event_type") == "signup").alias("browser"), (F.col("event_type") == "view").alias("cache_hit"))
    return usage.daily(e)


@query(f"""SELECT event_type, count(ms) AS count, floor(avg(ms) * 100 + 0.5) / 100 AS avg, quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.95) AS p95 FROM (SELECT event_type, {MS_SQL} AS ms FROM events) GROUP BY 1""")
def events_latency_summary(spark, sf_dir):
    return events.latency_summary(log(spark, sf_dir), "duration_ms", ["event_type"])


@query(f"""WITH last AS (SELECT {MS_SQL} AS ms FROM events ORDER BY ts DESC, event_id DESC LIMIT 1024)
SELECT count(ms) AS count, floor(avg(ms) * 100 + 0.5) / 100 AS avg, quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.95) AS p95 FROM last""")
def events_last_1024_latency(spark, sf_dir):
    e = log(spark, sf_dir).withColumn("latency", F.col("duration_ms"))
    return events.latency_summary(events.last_latencies(e, "latency"))


SNAPSHOT_KINDS = ["click", "error", "purchase", "signup", "view"]


@query("""WITH c AS (SELECT count(*) AS n, count(*) FILTER (event_type <> 'error') AS ok, count(*) FILTER (event_type = 'error') AS bad, count(*) FILTER (event_type = 'purchase') AS made, count(*) FILTER (event_type = 'signup') AS ran, greatest(1/60.0, date_diff('millisecond', min(ts), max(ts)) / 60000.0) AS minutes FROM events)
SELECT floor(n / minutes * 1000 + 0.5) / 1000 AS requests_per_min, floor(ok / minutes * 1000 + 0.5) / 1000 AS conversions_per_min, floor(ok / (ok + bad) * 10000 + 0.5) / 10000 AS success_rate, ok + bad AS conversion_attempts,
floor(made / ran * 10000 + 0.5) / 10000 AS retry_rate, CAST(7 AS BIGINT) AS browser_queue, greatest(0, made - ran) AS estimated_job_tasks, 7 + greatest(0, made - ran) AS backlog_total FROM c""")
def events_success_snapshot(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    n = lambda k: F.count_if(F.col("event_type") == k)
    up = (F.unix_millis(F.max("ts").cast("timestamp")) - F.unix_millis(F.min("ts").cast("timestamp"))).alias("uptime_ms")
    one = e.agg(up, F.count("*").alias("requests"), F.count_if(F.col("event_type") != "error").alias("conversions"), n("error").alias("failures"), n("purchase").alias("created_tasks"), n("signup").alias("executed_tasks"), n("purchase").alias("retries"), F.lit(7).alias("queued"))
    return events.service_snapshot(one)


@query("SELECT " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS \"{k}\"" for k in SNAPSHOT_KINDS) + " FROM events")
def events_counters(spark, sf_dir):
    return events.counters(table(spark, sf_dir, "events"), SNAPSHOT_KINDS)


@query("""WITH b AS (SELECT event_id, user_id, event_type, ts, epoch_us(ts) AS us, CAST(floor(epoch_us(ts) / 3600000000.0) AS BIGINT) AS bucket FROM events),
h AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id, bucket ORDER BY ts, event_id) AS hit FROM b)
SELECT event_id, bucket, CAST(hit AS INTEGER) AS hit, 1 AS "limit", hit > 1 AS exceeded, CAST(greatest(0, 1 - hit) AS INTEGER) AS remaining, CAST(greatest(1, ceil(((bucket + 1) * 3600000000 - us) / 1000000.0)) AS BIGINT) AS retry_after_s FROM h""")
def rate_limit_fixed_window(spark, sf_dir):
    made = ratelimit.fixed_window(table(spark, sf_dir, "events"), ["event_type", "user_id"], "ts", 1, 3600)
    return made.select("event_id", "bucket", "hit", "limit", "exceeded", "remaining", "retry_after_s")


@query("""WITH RECURSIVE o AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT event_id, user_id, n, t + 86400000000 AS e, 1::BIGINT AS hit FROM o WHERE n = 1
UNION ALL SELECT o.event_id, o.user_id, o.n, CASE WHEN o.t >= w.e THEN o.t + 86400000000 ELSE w.e END, CASE WHEN o.t >= w.e THEN 1 ELSE w.hit + 1 END FROM w JOIN o ON o.user_id = w.user_id AND o.n = w.n + 1)
SELECT user_id, event_id, hit, hit > 2 AS blocked FROM w""")
def rate_limit_anchored(spark, sf_dir):
    return ratelimit.anchored_window(table(spark, sf_dir, "events"), "user_id", "ts", 2, 86400).select("user_id", "event_id", "hit", "blocked")


@query("""SELECT user_id, event_id, event_type AS status, previous FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events) WHERE previous IS NULL OR previous <> event_type""")
def status_changes(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("at"), F.col("event_type").alias("status"))
    return jobs.changes(e, "user_id", "at").select("user_id", "event_id", "status", "previous")


@query("""WITH a AS (SELECT event_id, user_id, ts, event_type = 'error' AS failed, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events),
b AS (SELECT *, sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS s FROM a)
SELECT event_id, failed, CAST(CASE WHEN failed THEN s % 2 ELSE 0 END AS BIGINT) AS failure_count, CASE WHEN failed AND s % 2 = 0 THEN ts + INTERVAL 15 MINUTE END AS disabled_until FROM b""")
def failure_streak_disable(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    made = events.failure_streaks(e, "user_id", "ts", F.col("event_type") == "error", "event_id", threshold=2)
    return made.select("event_id", "failed", F.col("failure_count").cast("long").alias("failure_count"), "disabled_until")


@query("SELECT event_type AS \"table\", count(*) FILTER (ts <= TIMESTAMP '2024-01-15') AS removed, count(*) FILTER (ts > TIMESTAMP '2024-01-15') AS kept FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def ttl_cleanup_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    return events.expired_counts({k: e.where(F.col("event_type") == k) for k in ("click", "view")}, cut, "ts")


# --- keys, accounts, quotas ------------------------------------------------------------
TIER_SQL = "CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'pro' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'anonymous' ELSE 'free' END"


def accounts_of(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    tier = F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "pro").when(F.col("c_mktsegment") == "HOUSEHOLD", "anonymous").otherwise("free")
    return c.select(F.col("c_custkey").alias("account_id"), tier.alias("tier"), F.floor(F.greatest(F.lit(0.0), "c_acctbal")).cast("long").alias("monthly_credits_used"), F.lit("1996-01-01").cast("timestamp_ntz").alias("monthly_credits_reset_at"))


def keys_of(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    revoked = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))
    return o.select(F.col("o_orderkey").alias("key_id"), F.col("o_custkey").alias("account_id"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("key_hash"), revoked.alias("revoked_at"), F.col("o_orderdate").alias("created_at"))


@query(f"""SELECT o_orderkey AS key_id, CASE WHEN o_orderstatus = 'F' THEN 'anonymous' WHEN {TIER_SQL} = 'pro' THEN 'pro' ELSE 'free' END AS tier, CASE WHEN o_orderstatus <> 'F' THEN o_custkey END AS account_id,
CASE WHEN o_orderstatus = 'F' THEN 0 WHEN {TIER_SQL} = 'pro' THEN 50000 ELSE 1000 END AS quota_limit, CAST(CASE WHEN o_orderstatus = 'F' OR o_orderdate >= TIMESTAMP '1996-01-01' THEN 0 ELSE floor(greatest(0, c_acctbal)) END AS BIGINT) AS quota_used FROM orders JOIN customer ON o_custkey = c_custkey""")
def auth_lookup_join(spark, sf_dir):
    k = keys_of(spark, sf_dir)
    requests = k.select(F.col("key_id").alias("asked"), "key_hash", F.col("created_at").alias("now"))
    made = usage.resolved_keys(requests, k, accounts_of(spark, sf_dir), F.col("now"))
    return made.select(F.col("asked").alias("key_id"), "tier", "account_id", "quota_limit", F.col("quota_used").cast("long").alias("quota_used"))


@query(f"""WITH r AS (SELECT c_custkey, {TIER_SQL} AS tier, CAST(floor(greatest(0, c_acctbal)) AS BIGINT) AS used, c_custkey % 3 = 0 AS fb, c_custkey % 4 = 0 AS nc, CASE c_custkey % 5 WHEN 0 THEN 'jina' WHEN 1 THEN 'cf' ELSE '' END AS eng, CASE WHEN c_custkey % 2 = 0 THEN 'extract' ELSE 'convert' END AS route FROM customer),
p AS (SELECT *, CASE tier WHEN 'anonymous' THEN 0 WHEN 'free' THEN greatest(0, 1000 - used) ELSE greatest(0, 50000 - used) END AS rem FROM r)
SELECT c_custkey AS account_id, tier, rem AS quota_remaining, CASE WHEN tier = 'anonymous' THEN 0 WHEN route = 'extract' THEN 3 ELSE 1 END AS credit_cost,
CASE WHEN rem <= 0 THEN 'none' WHEN rem <= 10 THEN '1_10' WHEN rem <= 100 THEN '11_100' WHEN rem <= 1000 THEN '101_1000' ELSE 'gt_1000' END AS bucket,
CASE WHEN fb AND tier = 'anonymous' THEN 'force_browser requires an API key.' WHEN nc AND tier <> 'pro' THEN 'no_cache requires a Pro API key.' WHEN eng <> '' AND tier <> 'pro' AND eng <> 'jina' THEN 'engine selection requires a Pro API key.' END AS violation FROM p""")
def quota_policy(spark, sf_dir):
    a = accounts_of(spark, sf_dir)
    i = F.col("account_id")
    r = a.select("account_id", "tier", usage.tier_quota(F.col("tier")).alias("quota_limit"), F.col("monthly_credits_used").alias("quota_used"), (i % 3 == 0).alias("force_browser"), (i % 4 == 0).alias("no_cache"), F.when(i % 5 == 0, "jina").when(i % 5 == 1, "cf").otherwise("").alias("engine"), F.when(i % 2 == 0, "extract").otherwise("convert").alias("route"))
    made = usage.with_policy(r)
    left = F.col("policy.quota_remaining").cast("long")
    return made.select("account_id", "tier", left.alias("quota_remaining"), F.col("policy.credit_cost").alias("credit_cost"), classify.quota_bucket(left).alias("bucket"), "violation")


@query("""SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, count(*) AS requests, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 3 ELSE 1 END) AS BIGINT) AS credits FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) AND o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY 1""")
def usage_semi_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.when(F.col("o_orderpriority") == "1-URGENT", 3).otherwise(1).alias("credits"))
    k = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key_id"), F.col("c_nationkey").alias("account_id"))
    return usage.usage_of(o, k, F.lit(3), F.lit("1995-01-01")).groupBy("date").agg(F.count("*").alias("requests"), F.sum("credits").alias("credits"))


@query(f"""WITH u AS (SELECT o_custkey AS id, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 3 ELSE 1 END) AS BIGINT) AS s FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY 1)
SELECT c_custkey AS account_id, coalesce(s, 0) AS used, CASE WHEN {TIER_SQL} = 'pro' THEN 50000 ELSE 1000 END AS quota, CAST(greatest(0, CASE WHEN {TIER_SQL} = 'pro' THEN 50000 ELSE 1000 END - coalesce(s, 0)) AS BIGINT) AS remaining FROM customer LEFT JOIN u ON id = c_custkey""")
def account_month_credits(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.when(F.col("o_orderpriority") == "1-URGENT", 3).otherwise(1).alias("credits"))
    made = usage.account_credits(accounts_of(spark, sf_dir), keys_of(spark, sf_dir), o, F.lit("1995-01-01"))
    return made.select("account_id", "used", "quota", "remaining")


@query("SELECT o_custkey AS account_id, count(*) AS active FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1 HAVING count(*) >= 10")
def active_keys_over_cap(spark, sf_dir):
    return usage.keys_over_cap(keys_of(spark, sf_dir))


# --- jobs ------------------------------------------------------------------------------
STATUS_SQL = "CASE turn % 5 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'failed' WHEN 2 THEN 'succeeded' WHEN 3 THEN 'canceled' ELSE 'queued' END"


def tasks_of(spark, sf_dir) -> DataFrame:
    c, t = table(spark, sf_dir, "conversations"), F.col("turn") % 5
    status = F.when(t.isin(0, 2), "succeeded").when(t == 1, "failed").when(t == 3, "canceled").otherwise("queued")
    return c.select(F.col("conv_id").alias("job_id"), F.concat_ws("-", "conv_id", "turn").alias("task_id"), status.alias("status"), (F.length("text") % 4).alias("retry_count"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("result"))


@query(f"""WITH t AS (SELECT conv_id, {STATUS_SQL} AS s, length(text) % 4 AS r FROM conversations),
c AS (SELECT conv_id AS job_id, count(*) AS total, count(*) FILTER (s = 'succeeded') AS succeeded, count(*) FILTER (s = 'failed') AS failed, count(*) FILTER (s = 'queued') AS queued, count(*) FILTER (s = 'running') AS running, count(*) FILTER (s = 'canceled') AS canceled, CAST(sum(r) AS BIGINT) AS retries FROM t GROUP BY 1)
SELECT *, CASE WHEN running > 0 THEN 'running' WHEN succeeded = total THEN 'succeeded' WHEN failed > 0 AND queued = 0 THEN 'failed' WHEN canceled = total THEN 'canceled' ELSE 'queued' END AS status FROM c""")
def job_status_recount(spark, sf_dir):
    return jobs.recount(tasks_of(spark, sf_dir))


ATTEMPT_SQL = "SELECT conv_id AS task_id, CAST(turn + 1 AS INTEGER) AS attempt, CASE length(text) % 6 WHEN 0 THEN 200 WHEN 1 THEN 429 WHEN 2 THEN 503 WHEN 3 THEN 400 WHEN 4 THEN NULL ELSE 429 END AS status_code, length(text) % 6 = 0 AS success FROM conversations"


def attempts_of(spark, sf_dir) -> DataFrame:
    c, k = table(spark, sf_dir, "conversations"), F.length("text") % 6
    code = F.when(k == 0, 200).when(k.isin(1, 5), 429).when(k == 2, 503).when(k == 3, 400)
    return c.select(F.col("conv_id").alias("task_id"), (F.col("turn") + 1).cast("int").alias("attempt"), code.alias("status_code"), (k == 0).alias("success"))


@query(f"""WITH a AS ({ATTEMPT_SQL}), e AS (SELECT *, success OR NOT (status_code IS NULL OR status_code IN (429, 503)) OR attempt > 2 AS fin FROM a),
s AS (SELECT task_id, min(attempt) FILTER (fin) AS stop, max(attempt) AS last FROM e GROUP BY 1)
SELECT s.task_id, e.attempt AS attempts, e.success, e.status_code FROM s JOIN e ON e.task_id = s.task_id AND e.attempt = coalesce(s.stop, s.last)""")
def job_retry_outcome(spark, sf_dir):
    return jobs.outcomes(attempts_of(spark, sf_dir), 2)


@query(f"""WITH t AS (SELECT conv_id, turn, {STATUS_SQL} AS s, length(text) % 4 AS r FROM conversations)
SELECT conv_id || '-' || turn AS task_id, s = 'queued' OR (s = 'failed' AND greatest(0, 2 - r) > 0) AS runnable, CAST(greatest(0, 2 - r) AS INTEGER) AS remaining FROM t""")
def runnable_tasks(spark, sf_dir):
    t = tasks_of(spark, sf_dir)
    return t.select("task_id", classify.runnable(F.col("status"), F.lit(2), F.col("retry_count")).alias("runnable"), classify.remaining_retries(F.lit(2), F.col("retry_count")).alias("remaining"))


@query("""WITH d AS (SELECT doc_id, source || '-' || (doc_id % 50) AS k, sha256(coalesce(text, '')) AS h FROM documents), f AS (SELECT k, min(doc_id) AS first, arg_min(h, doc_id) AS fh FROM d GROUP BY 1)
SELECT d.doc_id, CASE WHEN d.doc_id = f.first THEN 'created' WHEN d.h = f.fh THEN 'replayed' ELSE 'conflict' END AS outcome FROM d JOIN f USING (k)""")
def idempotent_first_wins(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("-", "source", F.col("doc_id") % 50).alias("idem_key"), F.col("doc_id").alias("ts"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("payload_hash"))
    return jobs.idempotent(d).select("doc_id", "outcome")


@query("""WITH RECURSIVE a AS (SELECT CAST(conv_id % 20 AS VARCHAR) AS domain, conv_id * 1000 + turn AS seq, coalesce(length(text) % 3 <> 0, false) AS success FROM conversations),
o AS (SELECT *, 0.75::DOUBLE + CAST('0x' || left(md5('0:' || domain || ':' || seq), 8) AS BIGINT) / 8589934592::DOUBLE AS jitter, row_number() OVER (PARTITION BY domain ORDER BY seq, success) AS n FROM a),
w AS (SELECT domain, 0::BIGINT AS n, NULL::BIGINT AS seq, NULL::BOOLEAN AS success, 1000::BIGINT AS delay FROM (SELECT DISTINCT domain FROM a)
UNION ALL SELECT o.domain, o.n, o.seq, o.success, CASE WHEN o.success THEN greatest(1000, CAST(floor(w.delay * 0.75::DOUBLE) AS BIGINT)) ELSE least(30000, CAST(floor(w.delay * 2 * o.jitter) AS BIGINT)) END FROM w JOIN o ON o.domain = w.domain AND o.n = w.n + 1)
SELECT domain, seq, success, delay AS delay_ms, CASE WHEN success THEN least(1000, delay) ELSE delay END AS wait_ms FROM w WHERE n > 0""")
def job_pacing(spark, sf_dir):
    a = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 20).cast("string").alias("domain"), F.col("conv_id") * 1000 + F.col("turn"), (F.length("text") % 3 != 0).alias("success")).toDF("domain", "seq", "success")
    return jobs.paced(a)


# --- URLs and pages --------------------------------------------------------------------
HOST_SQL = "lower(regexp_extract(url, '^https?://([^/?#:]+)', 1))"
HOSTILE = ["http://localhost/", "http://127.0.0.1:80/x", "http://10.1.2.3/", "http://172.20.0.1/", "http://192.168.1.1/", "http://169.254.169.254/latest", "http://100.64.0.1/", "http://0.0.0.0/", "http://[::1]/", "http://[fe80::1]/", "http://[::ffff:10.0.0.1]/", "http://[::ffff:7f00:1]/", "http://2130706433/", "http://0x7f000001/", "http://a.nip.io/", "http://db.internal/", "http://x.test/", "ftp://example.com/", "not a url", "https://example.com/ok", "http://8.8.8.8/", "HTTP://EXAMPLE.com:80/a b", "http://localhost./", "http://fdic.gov/"]


@query(f"""SELECT page_id, {HOST_SQL} AS host, array_to_string(list_slice(string_split({HOST_SQL}, '.'), -2, -1), '.') AS domain, length(url) <= 4096 AND url LIKE 'http%' AS valid FROM pages""")
def page_url_parts(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    scheme, host = urls.plain_parts(F.col("url"))
    return p.select("page_id", host.alias("host"), urls.registrable(host).alias("domain"), urls.is_http(F.col("url"), scheme).alias("valid"))


@query("SELECT page_id, url FROM pages WHERE url LIKE 'http%' UNION ALL SELECT * FROM (VALUES (-1, 'https://example.com/ok'), (-2, 'http://8.8.8.8/'), (-3, 'HTTP://EXAMPLE.com:80/a b')) v(page_id, url)")
def page_safe_filter(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    good = ["https://example.com/ok", "http://8.8.8.8/", "HTTP://EXAMPLE.com:80/a b"]
    odd = values(spark, [(-1 - good.index(u) if u in good else -100 - i, u) for i, u in enumerate(HOSTILE) if u != "http://fdic.gov/"], "page_id long, url string")
    return urls.safe_pages(p.unionByName(odd))


RULE_DOMAINS = ["example.com", "example.net"]


@query(f"""SELECT page_id, d.domain, d.rank FROM pages p JOIN (VALUES ('example.com', 1), ('example.net', 2), ('co.uk', 3)) d(domain, rank) ON {HOST_SQL} = d.domain OR ends_with({HOST_SQL}, '.' || d.domain)""")
def page_domain_suffix_join(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", urls.plain_parts(F.col("url"))[1].alias("host"))
    rules = values(spark, [("example.com", 1), ("example.net", 2), ("co.uk", 3)], "domain string, rank int")
    return urls.domain_matches(p, "host", rules).select("page_id", "domain", "rank")


@query(f"""SELECT page_id, ends_with({HOST_SQL}, '.example.com') OR ends_with({HOST_SQL}, '.example.net') AS passes FROM pages""")
def page_domain_filter(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", urls.passes_domains(urls.plain_parts(F.col("url"))[1], RULE_DOMAINS, ["blocked.example.com"]).alias("passes"))


@query(f"""SELECT page_id, d.referer, d.domain IS NOT NULL AS has_rule FROM pages LEFT JOIN (VALUES ('example.org', 'https://www.google.com/'), ('example.com', NULL)) d(domain, referer) ON array_to_string(list_slice(string_split({HOST_SQL}, '.'), -2, -1), '.') = d.domain""")
def page_registrable_rule(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", urls.plain_parts(F.col("url"))[1].alias("host"))
    rules = pages.paywall_rules(spark, [{"domains": ["example.org", " EXAMPLE.com"], "referer": "https://www.google.com/"}, {"domains": ["example.com"]}])
    return pages.with_paywall_rule(p, rules).select("page_id", "referer", F.col("domain").isNotNull().alias("has_rule"))


@query("SELECT page_id FROM pages WHERE regexp_matches(url, '(?i)^(https?://.*/en/.*|.*example\\.net/.*7.)$')")
def page_glob_filter(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.where(urls.matches_glob(F.col("url"), [" http://*/EN/* ", "https://*/en/*", "*example.net/*7?", ""])).select("page_id")


PLATFORMS = ["https://mp.weixin.qq.com/s/1", "https://www.zhihu.com/q", "https://juejin.cn/post/1", "https://xhslink.com/a", "https://weibo.com/1", "https://x.com/a", "https://mobile.twitter.com/a", "https://github.com/a", "https://www.linkedin.com/", "https://youtu.be/1", "https://blog.medium.com/", "https://a.substack.com/p", "https://a.notion.site/b", "https://docs.google.com/d", "https://a.org/f.PDF", "https://a.org/", "nonsense", "https://netflix.com/"]
LABELS = ["wechat", "zhihu", "juejin", "xiaohongshu", "weibo", "x", "x", "github", "linkedin", "youtube", "medium", "substack", "notion", "google_docs", "pdf", "generic", "invalid_url", "generic"]


@query(f"SELECT url, 'generic' AS platform FROM pages UNION ALL SELECT * FROM (VALUES {rows_sql(list(zip(PLATFORMS, LABELS, strict=True)))}) v(url, platform)")
def page_platform(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("url").union(values(spark, [(u,) for u in PLATFORMS], "url string"))
    return urls.with_parts(p).select("url", urls.platform(F.col("parts.host"), F.col("parts.path")).alias("platform"))


AGENTS = [("curl/8.0", "curl"), ("python-requests/2", "python"), ("PostmanRuntime/7", "postman"), ("axios/1", "node"), ("Googlebot/2.1", "bot"), ("Mozilla/5.0 Chrome/1", "browser"), ("", "unknown"), ("Lynx", "other"), (None, "unknown")]


@query(f"SELECT * FROM (VALUES {rows_sql(AGENTS)}) v(agent, family)")
def ua_family(spark, sf_dir):
    a = values(spark, [(x,) for x, _ in AGENTS], "agent string")
    return a.select("agent", classify.user_agent_family(F.col("agent")).alias("family"))


VISIBLE_SQL = "trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"""SELECT page_id, contains(lower(html), 'captcha') AND length(html) < 10000 OR contains(lower(html), 'cf-challenge') OR (length(html) < 2000 AND (contains(lower(html), 'window.location') OR contains(lower(html), 'document.location')) AND length(trim(regexp_replace(html, '<[^>]+>', '', 'g'))) < 200) AS needs_browser,
contains(lower(html), 'cf-challenge') OR contains(lower(html), 'login_type') OR (contains(lower(html), 'verify') AND contains(lower(html), 'captcha') AND length(html) < 5000) AS challenge,
(length({VISIBLE_SQL}) < 500 AND length(html) > 10000) OR {" OR ".join(f"contains(lower(html), {q(p)})" for p in pages.PAYWALL_PHRASES)} AS paywalled, octet_length(encode(html)) <= 5242880 AS within_limit FROM pages""")
def page_flags(spark, sf_dir):
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", pages.needs_browser(h).alias("needs_browser"), pages.is_challenge(h).alias("challenge"), pages.looks_paywalled(h).alias("paywalled"), pages.within_limit(h).alias("within_limit"))


@query("""SELECT CASE WHEN n < 1024 THEN 'lt_1kb' WHEN n < 10240 THEN '1kb_10kb' WHEN n < 102400 THEN '10kb_100kb' WHEN n < 1048576 THEN '100kb_1mb' ELSE 'gte_1mb' END AS bucket, count(*) AS pages FROM (SELECT length(html) AS n FROM pages) GROUP BY 1""")
def page_size_buckets(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(classify.size_bucket(F.length("html")).alias("bucket")).agg(F.count("*").alias("pages"))


@query("SELECT page_id, 'https://md-cache/v1/markdown/default/' || left(sha256(url || '||'), 16) AS key, CASE WHEN contains(url, 'x.com') OR contains(url, 'zhihu.com') THEN 600 ELSE 3600 END AS ttl FROM pages")
def page_cache_key(spark, sf_dir):
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "pages").select("page_id", privacy.cache_key(F.col("url"), F.lit("markdown"), none, none).alias("key"), urls.ttl_seconds(F.col("url")).alias("ttl"))


def hmac_sql(value: str) -> str:
    key = SALT.encode().ljust(64, b"\0")
    blob = lambda pad: "'" + "".join(f"\\x{b ^ pad:02X}" for b in key) + "'::BLOB"
    return f"left(sha256({blob(0x5C)} || unhex(sha256({blob(0x36)} || encode({value})))), 32)"


@query(f"SELECT page_id, {hmac_sql(HOST_SQL)} AS host_hash FROM pages")
def host_hmac(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", privacy.hmac_sha256(SALT, urls.plain_parts(F.col("url"))[1]).alias("host_hash"))


@query("SELECT page_id, trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\\s+', ' ', 'g')) AS title FROM pages")
def page_title_regex(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(F.get(extract.regex_column(F.col("html"), "<title>([^<]*)</title>", 1), F.lit(0)), F.lit("")).alias("title"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+')) AS emails, len(regexp_extract_all(text, '[0-9]{3}')) AS triples FROM documents")
def page_regex_extract(spark, sf_dir):
    t = F.col("text")
    n = lambda p: F.size(extract.regex_column(t, p)).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", n(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").alias("emails"), n("[0-9]{3}").alias("triples"))


# --- texts ------------------------------------------------------------------------------
PLAIN_SQL = "replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10))"
for pattern, replacement in text.PLAIN_STEPS[1:]:
    flags = "gm" if "(?md)" in pattern else "g"
    PLAIN_SQL = f"regexp_replace({PLAIN_SQL}, {q(pattern.replace('(?md)', '(?m)'))}, {q(replacement.replace('$1', chr(92) + '1'))}, 'g')"
SNIPPET_SQL = "coalesce(text, '')"
for pattern, replacement in text.SNIPPET_STEPS:
    SNIPPET_SQL = f"regexp_replace({SNIPPET_SQL}, {q(pattern.replace('(?md)', '(?m)'))}, {q(replacement.replace('$1', chr(92) + '1'))}, 'g')"


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))


@query(f"SELECT doc_id, regexp_replace({PLAIN_SQL}, '^\\s+|\\s+$', '', 'g') AS plain FROM documents")
def page_plain_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.plain_text(F.col("text")).alias("plain"))


@query(f"WITH s AS (SELECT doc_id, regexp_replace({SNIPPET_SQL}, '^\\s+|\\s+$', '', 'g') AS p FROM documents) SELECT doc_id, CASE WHEN length(p) > 160 THEN left(p, 159) || '…' ELSE p END AS snippet FROM s")
def doc_snippet(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.snippet(F.col("text")).alias("snippet"))


@query("""SELECT doc_id, '<pre>' || replace(replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#039;') || '</pre>' AS html FROM documents""")
def doc_basic_html(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.basic_html(F.col("text")).alias("html"))


@query("SELECT doc_id, CAST(to_json({url: source, title: lang, markdown: coalesce(text, ''), method: 'native', timestamp: '2024-01-01T00:00:00.000Z'}) AS VARCHAR) AS output FROM documents")
def doc_json_output(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.formatted(F.lit("json"), F.col("text"), F.col("source"), F.col("lang"), F.lit("native"), F.lit("2024-01-01T00:00:00.000Z")).alias("output"))


@query(f"SELECT doc_id, {privacy.redacted_sql('text')} AS redacted FROM documents")
def doc_redact(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", privacy.redacted(F.col("text")).alias("redacted"))


@query("""SELECT doc_id, left(regexp_replace(regexp_replace(lower(trim(upper(source) || ' / ' || lang)), '[^a-z0-9_+.-]+', '_', 'g'), '^_+|_+$', '', 'g'), 120) AS dimension FROM documents""")
def doc_dimension(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", privacy.dimension(F.concat_ws(" / ", F.upper("source"), "lang")).alias("dimension"))


@query("SELECT d.doc_id, c.doc_id IS NOT NULL AS hit FROM documents d LEFT JOIN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 2 = 0 AND trim(text) <> '') c USING (doc_id)")
def cache_ttl_live(spark, sf_dir):
    d, now = docs(spark, sf_dir), F.lit("2024-06-01").cast("timestamp")
    r = d.select("doc_id", F.concat(F.lit("https://c.org/"), "doc_id").alias("url"), F.lit("markdown").alias("format"), F.lit(None).cast("string").alias("selector"), F.lit(None).cast("string").alias("engine"), F.col("text").alias("content"), F.lit("native").alias("method"), F.lit("").alias("title"), F.lit("text/markdown").alias("source_content_type"))
    stored = cache.entries(r.where("doc_id % 3 <> 0"), F.when(F.col("url").rlike("[02468]$"), now).otherwise(now - F.expr("interval 2 hours")))
    return cache.lookups(r.select("doc_id", "url", "format", "selector", "engine"), stored, now).select("doc_id", "hit")


@query("SELECT source AS key, max(doc_id) AS written_at, arg_max(lang, doc_id) AS lang FROM documents GROUP BY 1")
def cache_latest_wins(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("key"), F.col("doc_id").alias("written_at"), "lang")
    return cache.latest(d.where("written_at % 2 = 0"), d.where("written_at % 2 = 1"))


# --- link graph -------------------------------------------------------------------------
def derived_graph(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """A graph on the page ids: each links to three others by a fixed rule."""
    p = table(spark, sf_dir, "pages").select("page_id")
    n = p.count()
    site = lambda c: F.concat(F.lit("https://graph.example/"), c.cast("string"))
    edges = p.select("page_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("pos")).withColumn("to", (F.col("page_id") * 7 + F.col("pos") * 3 + 1) % n)
    return p.select(site(F.col("page_id")).alias("url")), edges.select(site(F.col("page_id")).alias("src"), "pos", site(F.col("to")).alias("dst"), F.concat(F.lit("to "), F.col("to").cast("string")).alias("anchor"))


@query("""WITH RECURSIVE n AS (SELECT count(*) AS n FROM pages), w AS (SELECT 0::BIGINT AS id, 0 AS depth UNION SELECT (w.id * 7 + k.k * 3 + 1) % n.n, w.depth + 1 FROM w, n, (VALUES (0), (1), (2)) k(k) WHERE w.depth < 3)
SELECT 'https://graph.example/' || id AS url, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY id""")
def crawl_bfs_depth(spark, sf_dir):
    p, e = derived_graph(spark, sf_dir)
    state = crawl.breadth_first(p, e, "https://graph.example/0", crawl.Settings(max_depth=3, max_pages=200))
    return state.results.select("url", "depth")


@query()
def crawl_best_first(spark, sf_dir):
    p, e = derived_graph(spark, sf_dir)
    seeds = values(spark, [(f"https://graph.example/{i}",) for i in (0, 5, 9)], "seed string")
    return crawl.best_first(p, e, seeds, crawl.Settings(max_depth=4, max_pages=25, keywords=("1", "3", "5")))


# --- sources ----------------------------------------------------------------------------
@query(f"""WITH a AS (SELECT conv_id AS url, CAST(turn AS INTEGER) AS attempt, CASE length(text) % 4 WHEN 0 THEN 200 WHEN 1 THEN 429 WHEN 2 THEN 503 ELSE 404 END AS status FROM conversations), e AS (SELECT *, NOT (status = 429 OR status BETWEEN 500 AND 599) OR attempt >= 2 AS fin FROM a),
s AS (SELECT url, min(attempt) FILTER (fin) AS stop, max(attempt) AS last FROM e GROUP BY 1)
SELECT s.url, CAST(e.attempt + 1 AS INTEGER) AS attempts, e.status, CAST(CASE e.attempt WHEN 0 THEN 0 WHEN 1 THEN 80 ELSE 240 END AS BIGINT) AS delay_ms FROM s JOIN e ON e.url = s.url AND e.attempt = coalesce(s.stop, s.last)""")
def fetch_retry_outcome(spark, sf_dir):
    c, k = table(spark, sf_dir, "conversations"), F.length("text") % 4
    a = c.select(F.col("conv_id").alias("url"), F.col("turn").cast("int").alias("attempt"), F.when(k == 0, 200).when(k == 1, 429).when(k == 2, 503).otherwise(404).alias("status"))
    return sources.with_retries(a)


@query("SELECT list_any, count(*) AS n FROM (SELECT contains(lower(text), 'token') OR contains(lower(text), 'license') AS list_any FROM documents) GROUP BY 1")
def doc_marker_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(has_any(F.lower("text"), ["token", "license"]).alias("list_any")).agg(F.count("*").alias("n"))
