"""Jobs, events, limits, usage, cache, posts and sources on small cases with known answers."""

import datetime as dt
import json

from pyspark.sql import functions as F

from pagemill.functions import classify
from pagemill.operators import cache, events, extract, jobs, ratelimit, threads, usage
from pagemill.plans import catalog, details
from pagemill.plans.registry import QUERIES
from pagemill.sources import pages as sources
from pagemill.sources import sinks

T0 = dt.datetime(2024, 1, 1, 12, 0, 0)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_job_validation(spark):
    rows = {r.job_id: r for r in jobs.validate(spark.createDataFrame(details.PAYLOADS, "job_id string, json string")).collect()}
    want = {
        "no_object": ("Job payload must be a JSON object.", None),
        "bad_json": ("Job payload must be a JSON object.", None),
        "bad_type": ("type must be either crawl or extract.", None),
        "no_tasks": ("tasks must be a non-empty array.", None),
        "blank_url": ("crawl task string entries must be non-empty URLs.", 1),
        "odd_field": ("crawl task contains unsupported field: foo.", 0),
        "bad_format": ("crawl task format must be one of: markdown, html, text, json.", 0),
        "extract_text": ("extract task must be an object.", 0),
        "extract_no_source": ("extract task must include a non-empty url or html source.", 0),
    }
    assert {k: (r.error_message, r.error_index) for k, r in rows.items() if r.error_code} == want
    assert rows["odd_field"].error_field == "foo"
    more = [("many", json.dumps({"type": "crawl", "tasks": ["u"] * 101})), ("second", json.dumps({"type": "extract", "tasks": [{"strategy": "css", "schema": {}, "html": "x"}, {"strategy": "sql", "schema": {}, "html": "x"}]})), ("flag", json.dumps({"type": "crawl", "tasks": [{"url": "u", "no_cache": 1}]})), ("long", json.dumps({"type": "crawl", "tasks": [{"url": "u", "selector": "s" * 257}]}))]
    got = {r.job_id: (r.error_message, r.error_index) for r in jobs.validate(spark.createDataFrame(more, "job_id string, json string")).collect()}
    assert got == {"many": ("Maximum 100 tasks allowed per job.", None), "second": ("extract task strategy must be one of: css, xpath, regex.", 1), "flag": ("crawl task no_cache must be a boolean.", 0), "long": ("crawl task selector is too long (max 256 characters).", 0)}


def test_job_records_and_runs(spark):
    made = jobs.records(spark.createDataFrame(details.PAYLOADS, "job_id string, json string"))
    rows = made.where("job_id = 'crawl_ok'").orderBy("task").collect()
    assert [(r.url, r.priority, r.max_retries, r.status) for r in rows] == [("https://a.test/1", 100, 4, "queued"), ("https://a.test/2", 100, 4, "queued")]
    a = spark.createDataFrame([("x", 1, 429, False), ("x", 2, 200, True), ("y", 1, 400, False), ("y", 2, 200, True), ("z", 1, None, False), ("z", 2, 503, False), ("z", 3, 503, False), ("z", 4, 200, True)], "task_id string, attempt int, status_code int, success boolean")
    got = {r.task_id: (r.attempts, r.success, r.status_code) for r in jobs.outcomes(a, 2).collect()}
    assert got == {"x": (2, True, 200), "y": (1, False, 400), "z": (3, False, 503)}
    tasks = spark.createDataFrame([("j", "x", "running", 0, None, None), ("j", "y", "queued", 1, None, None), ("j", "w", "canceled", 0, None, None)], "job_id string, task_id string, status string, retry_count int, error string, result string")
    results = spark.createDataFrame([("x", 2, True, None, "r" * 20_000), ("y", 1, False, "", None)], "task_id string, attempts int, success boolean, error string, result string")
    done = {r.task_id: r for r in jobs.merged(tasks, results).collect()}
    assert (done["x"].status, done["x"].retry_count, json.loads(done["x"].result)) == ("succeeded", 1, {"truncated": True, "bytes": 20_000})
    assert (done["y"].status, done["y"].error, done["w"].status) == ("failed", "Task failed", "canceled")
    r = jobs.recount(jobs.merged(tasks, results)).first()
    assert (r.total, r.succeeded, r.failed, r.canceled, r.retries, r.status) == (3, 1, 1, 1, 2, "failed")
    back = {r.task_id: (r.status, r.error) for r in jobs.recovered(tasks).collect()}
    assert back["x"] == ("failed", "Previous run was interrupted.") and back["y"] == ("queued", None)


def test_pacing_and_idempotency(spark):
    a = spark.createDataFrame([("d", i, ok) for i, ok in enumerate([True, False, False, True, True])] + [("e", 0, False)], "domain string, seq long, success boolean")
    rows = jobs.paced(a, seed=3).orderBy("domain", "seq").collect()
    d = [r.delay_ms for r in rows if r.domain == "d"]
    assert d[0] == 1000 and 1500 <= d[1] <= 2500 and d[2] > d[1] and d[3] == int(d[2] * 0.75) and d == [r.delay_ms for r in jobs.paced(a, seed=3).orderBy("domain", "seq").collect() if r.domain == "d"]
    c = spark.createDataFrame([("k", 2, '{"b":1,"a":2}'), ("k", 1, '{"a":2,"b":1}'), ("k", 3, '{"a":3}'), (None, 4, "{}")], "idem_key string, ts int, body string").withColumn("payload_hash", jobs.payload_hash(F.col("body")))
    assert {r.ts: r.outcome for r in jobs.idempotent(c).collect()} == {1: "created", 2: "replayed", 3: "conflict", 4: "created"}


def test_metrics(spark):
    lat = spark.createDataFrame([(x,) for x in (100, 200, 300, 400, 500)], "latency_ms long")
    assert tuple(events.latency_summary(lat).first()) == (5, 300.0, 300, 500)
    assert tuple(events.latency_summary(lat.limit(0)).first()) == (0, 0.0, 0, 0)
    c = spark.createDataFrame([(60_000, 100, 90, 10, 10, 6, 3, 3)], "uptime_ms long, requests long, conversions long, failures long, created_tasks long, executed_tasks long, retries long, queued int")
    r = events.service_snapshot(c).first()
    assert (r.success_rate, r.conversion_attempts, r.retry_rate, r.estimated_job_tasks, r.backlog_total, r.requests_per_min) == (0.9, 100, 0.5, 4, 7, 100.0)
    assert events.service_snapshot(c.selectExpr("0L uptime_ms", "0L requests", "0L conversions", "0L failures", "0L created_tasks", "0L executed_tasks", "0L retries", "-1 queued")).first().success_rate == 1.0


def test_rollups_merge(spark, sf):
    made = events.with_hour(catalog.log(spark, sf))
    whole = events.rollup(made)
    parts = events.merged_rollup(events.rollup(made.where("event_id % 2 = 0")), events.rollup(made.where("event_id % 2 = 1")))
    key = lambda d: sorted(map(str, d.select(sorted(d.columns)).collect()))
    assert key(whole) == key(parts)


def test_sanitized_has_no_secrets(spark, sf):
    df = QUERIES["events_sanitized"](spark, sf)
    assert len(df.columns) == 33
    r = df.where("error_code = 'fetch_failed'").first()
    assert r.outcome == "convert_error" and len(r.target_host_hash) == 32 and r.fallbacks == "amp" and r.colo == "sjc_1" and r.format == "markdown"
    assert df.where("target_url_hash like '%example%'").count() == 0
    assert {x.engine_requested for x in df.select("engine_requested").distinct().collect()} == {"jina", "custom"}


def test_limits(spark):
    e = spark.createDataFrame([(i, "u", at(s)) for i, s in enumerate([0, 10, 59, 60, 61, 200])], "event_id int, key string, ts timestamp")
    r = ratelimit.fixed_window(e, ["key"], "ts", 2).orderBy("event_id").collect()
    assert [(x.hit, x.exceeded, x.remaining) for x in r] == [(1, False, 1), (2, False, 0), (3, True, 0), (1, False, 1), (2, False, 0), (1, False, 1)]
    assert [x.retry_after_s for x in r[:3]] == [60, 50, 1]
    a = ratelimit.anchored_window(e.where("event_id > 0"), "key", "ts", 2, 60).orderBy("event_id").collect()
    assert [(x.hit, x.blocked) for x in a] == [(1, False), (2, False), (3, True), (4, True), (1, False)]
    assert a[0].reset_at == at(70)
    streak = spark.createDataFrame([(i, "k", at(i), f) for i, f in enumerate([1, 1, 1, 1, 0, 1])], "event_id int, key string, ts timestamp, f int")
    got = events.failure_streaks(streak, "key", "ts", F.col("f") == 1, "event_id").orderBy("event_id").collect()
    assert [x.failure_count for x in got] == [1, 2, 0, 1, 0, 1] and [x.disabled_until is not None for x in got] == [False, False, True, False, False, False]


def test_usage(spark):
    e = spark.createDataFrame([("k1", at(0), 3, True, False), ("k1", at(5), 1, False, True), (None, at(0), 9, True, True), ("", at(0), 9, True, True)], "key_id string, ts timestamp, credit_cost int, browser boolean, cache_hit boolean")
    day = usage.daily(e)
    assert [tuple(r) for r in day.collect()] == [("k1", "2024-01-01", 2, 4, 1, 1)]
    assert usage.added(day, day).first().credits == 8
    keys = spark.createDataFrame([("k1", "h1", "a1", None), ("k2", "h2", "a1", at(0))], "key_id string, key_hash string, account_id string, revoked_at timestamp")
    acc = spark.createDataFrame([("a1", "pro", 7, at(100))], "account_id string, tier string, monthly_credits_used int, monthly_credits_reset_at timestamp")
    req = spark.createDataFrame([("h1",), ("h2",), ("h3",)], "key_hash string")
    got = {r.key_hash: (r.tier, r.quota_limit, r.quota_used) for r in usage.resolved_keys(req, keys, acc, F.lit(at(0))).collect()}
    assert got == {"h1": ("pro", 50_000, 7), "h2": ("anonymous", 0, 0), "h3": ("anonymous", 0, 0)}
    assert usage.resolved_keys(req, keys, acc, F.lit(at(200))).where("key_hash = 'h1'").first().quota_used == 0
    s = spark.createDataFrame([("t", "a1", at(50))], "token_hash string, account_id string, expires_at timestamp")
    r = spark.createDataFrame([("t",), ("u",)], "token_hash string")
    assert usage.resolved_sessions(r, s, acc, F.lit(at(50))).count() == 1 and usage.resolved_sessions(r, s, acc, F.lit(at(51))).count() == 0
    assert usage.account_credits(acc, keys.drop("key_hash", "revoked_at"), day, F.lit("2024-01-01")).first().remaining == 49_996


def test_cache_and_profiles(spark):
    now = F.lit(at(0))
    res = spark.createDataFrame([("https://zhihu.com/1", "markdown", None, None, "text", "native", "t", ""), ("https://mp.weixin.qq.com/1", "markdown", None, None, "short", "readability", "t", "")], "url string, format string, selector string, engine string, content string, method string, title string, source_content_type string")
    stored = cache.entries(res, now)
    assert [r.expires_at for r in stored.collect()] == [at(600)]
    ask = res.select("url", "format", "selector", "engine")
    assert {r.url[8:13]: r.hit for r in cache.lookups(ask, stored, now).collect()} == {"zhihu": True, "mp.we": False}
    assert cache.lookups(ask, stored, F.lit(at(600))).where("hit").count() == 0
    many = spark.createDataFrame([(i, at(i), at(i + 5)) for i in range(10)], "key int, touched timestamp, expires_at timestamp")
    assert sorted(r.key for r in cache.most_recent(many, "touched", 3, F.lit(at(8))).collect()) == [7, 8, 9]
    one = lambda f, v: spark.createDataFrame([(v,)], "v string").select(f(F.col("v"))).first()[0]
    assert one(lambda c: cache.clipped(c, 5), "ééé") == "éé�" and one(cache.profile_scope, " a b/c ") == "a_b_c" and one(cache.profile_scope, " ") is None
    assert one(lambda c: cache.is_disabled(c, F.lit(at(0))), "2024-01-02T00:00:00Z") and not one(lambda c: cache.is_disabled(c, F.lit(at(0))), "bad")
    old = spark.createDataFrame([("k", at(-9), at(-9), 2, at(9)), ("o", at(-8), at(-8), 1, None)], "key string, created_at timestamp, updated_at timestamp, failure_count int, disabled_until timestamp")
    new = spark.createDataFrame([("k",), ("n",)], "key string")
    got = {r.key: (r.created_at, r.failure_count, r.disabled_until) for r in cache.saved(old, new, now).collect()}
    assert got == {"k": (at(-9), 0, None), "n": (at(0), 0, None), "o": (at(-8), 1, None)}
    assert {r.key: r.failure_count for r in cache.cleared(old, new, now).collect()} == {"k": 0, "o": 1}
    snap = spark.sql("SELECT array_repeat(named_struct('name', 'n', 'value', 'v'), 300) AS cookies, map('a', repeat('x', 5000)) AS local_storage")
    r = cache.snapshot(snap).first()
    assert len(r.cookies) == 200 and len(r.local_storage["a"]) == 4096


def test_posts(spark):
    body = json.dumps({"id_str": "12", "text": "hi <b>\nyou", "user": {"name": "N", "screen_name": "n"}, "mediaDetails": [{"type": "photo", "media_url_https": "p.jpg"}, {"type": "video", "media_url_https": "t.jpg", "video_info": {"variants": [{"content_type": "video/mp4", "bitrate": 1, "url": "low"}, {"content_type": "video/mp4", "bitrate": 5, "url": "high"}, {"content_type": "video/mp4", "bitrate": 5, "url": "tie"}, {"content_type": "x", "bitrate": 9, "url": "no"}]}}], "quoted_tweet": {"user": {"name": "Q", "screen_name": "q"}, "text": "said"}})
    p = spark.createDataFrame([(body,), ("{}",)], "b string").select(threads.reshaped(F.col("b")).alias("post"))
    r = p.where("post is not null").first().post
    assert r.photos == ["p.jpg"] and r.videos[0].url == "high" and p.where("post is null").count() == 1
    html = threads.thread_pages(p.where("post is not null"), spark.createDataFrame([("12", "12", 0)], "target string, id string, place int")).first().html
    assert "<p>hi &lt;b&gt;<br>you</p>" in html and "Video: high" in html and "<blockquote><p><strong>Q (@q)</strong></p><p>said</p></blockquote>" in html
    posts = spark.createDataFrame([("1", "a", None, None, "1"), ("2", "a", "A", "1", "1"), ("3", "a", "a", "2", "1"), ("10", "a", "a", "3", "1"), ("9", "b", "a", "2", "5")], "id string, author string, replying_to string, replying_to_status string, conversation_id string")
    t = threads.threads(posts, spark.createDataFrame([("3",), ("9",)], "id string")).orderBy("target", "place").collect()
    assert [(x.target, x.id) for x in t] == [("3", "1"), ("3", "2"), ("3", "3"), ("3", "10"), ("9", "9")]
    blocks = spark.createDataFrame([("a", 1, "header-one", "H", None), ("a", 2, "ordered-list-item", "x", None), ("a", 3, "ordered-list-item", "y", None), ("a", 4, "atomic", "", "e1")], "article string, pos int, type string, text string, entity_key string")
    got = threads.article_html(blocks, spark.createDataFrame([("a", "e1", "u.png")], "article string, entity_key string, url string")).first().html
    assert got == '<article><h2>H</h2><p>1. x</p><p>2. y</p><figure><img src="u.png" /></figure></article>'


def test_sources(spark, tmp_path):
    moves = [("https://a.org/", "https://b.org/", 301), ("https://b.org/", "https://c.org/", 302), ("https://d.org/", "http://127.0.0.1/", 307), ("https://e.org/", "https://f.org/", 304), *((f"https://l.org/{i}", f"https://l.org/{i + 1}", 301) for i in range(9))]
    starts = spark.createDataFrame([(u,) for u in ("https://a.org/", "https://d.org/", "https://e.org/", "https://l.org/0", "https://z.org/")], "url string")
    r = {x.url: (x.final_url, x.hops, x.error) for x in sources.final_urls(starts, spark.createDataFrame(moves, "src string, dst string, status int")).collect()}
    assert r["https://a.org/"] == ("https://c.org/", 2, None) and r["https://d.org/"][2] == "Redirect target blocked by SSRF protection" and r["https://e.org/"] == ("https://e.org/", 0, None)
    assert r["https://l.org/0"][2] == "Too many redirects (max 5)." and r["https://z.org/"] == ("https://z.org/", 0, None)
    one = lambda f, v: spark.createDataFrame([(v,)], "v string").select(f(F.col("v")).alias("x")).first().x
    assert tuple(one(sources.reader_answer, '{"code":200,"data":{"content":"c","title":"t"}}')) == ("c", "t", None)
    assert one(sources.reader_answer, '{"data":{"content":" "}}').error == "empty content"
    assert one(sources.scrape_answer, '{"data":{"markdown":"m","title":"b","metadata":{"title":"a"}}}').title == "a"
    p = spark.createDataFrame([("u:p@h:80,bad; u:p@H:80\nx:y@[::1]:9,u:p@h:99999",)], "raw string")
    assert [(x.username, x.host, x.port) for x in sources.proxies(p).orderBy("place").collect()] == [("u", "h", 80), ("x", "::1", 9)]
    a = spark.createDataFrame([("u", 0, 1, False, "x"), ("u", 1, 0, True, "y"), ("u", 1, 1, True, "z"), ("v", 0, 0, False, "w")], "url string, proxy int, variant int, accepted boolean, body string")
    got = {x.url: x for x in sources.first_accepted(a.withColumns({"status": F.lit(403), "error": F.when(F.col("url") == "v", "timed out")})).collect()}
    assert {u: x.body for u, x in got.items()} == {"u": "y", "v": None}
    assert got["u"].errors == ["proxy[0]/1: rejected status=403 body_bytes="] and got["u"].attempts == 2
    assert got["v"].errors == ["proxy[0]/0: timed out"] and not got["v"].accepted and sources.first_accepted(a.limit(0)).collect() == []
    spark.createDataFrame([("a", "small"), ("b", "x" * 100)], "url string, html string").write.parquet(str(tmp_path / "p"))
    ok, bad = sources.read_pages(spark, str(tmp_path / "p"), 50)
    assert [x.url for x in ok.collect()] == ["a"] and bad.first().bytes == 100
    pages = spark.createDataFrame([("a",), ("b",)], "url string")
    arch = spark.createDataFrame([("a", "s" * 999), ("b", "o" * 2000)], "url string, html string")
    new = spark.createDataFrame([("a", "n" * 1500)], "url string, html string")
    assert {x.url: x.archive_source for x in sources.with_archives(pages, arch, new).collect()} == {"a": "archive", "b": "wayback"}
    timed = spark.createDataFrame([("a", "z" * 1200, 1), ("a", "a" * 1100, 2)], "url string, html string, at int")
    assert sources.with_archives(pages.limit(1), timed, new).first().archive_html == "a" * 1100
    got = spark.createDataFrame([("s", 1, "full", at(0)), ("s", 0, None, at(0)), ("m", 0, None, at(-4000))], "host string, candidate int, text string, fetched_at timestamp")
    sites = {x.host: (x.text, x.known) for x in sources.site_summaries(spark.createDataFrame([("s",), ("m",)], "host string"), got, F.lit(at(10))).collect()}
    assert sites == {"s": ("full", True), "m": (None, False)}


def test_sinks(spark):
    df = spark.createDataFrame([("html", "<p>", "native", True, ["a", "b"])], "k string, c string, m string, h boolean, f array<string>")
    r = df.select(sinks.response(F.col("k"), F.col("c"), F.col("m"), F.col("h"), F.col("f")).alias("r")).first().r
    assert r.meta == {"Content-Type": "text/html; charset=utf-8", "X-Markdown-Method": "native", "X-Cache-Status": "HIT", "X-Markdown-Fallbacks": "a,b"}
    assert df.select(sinks.event_frame(F.lit("step"), F.struct("k"))).first()[0] == 'event: step\ndata: {"k":"html"}\n\n'
    assert json.loads(sinks.log_lines(df.select("k"), "x").first().value) == {"event": "x", "k": "html"}
    i = spark.createDataFrame([("https://mmbiz.qpic.cn/1?wx_fmt=jpeg", "application/octet-stream", bytearray(b"x"))], "url string, content_type string, data binary")
    key = sinks.stored_images(i).first().key
    assert key.endswith(".jpeg") and sinks.images_by_key(spark.createDataFrame([(key,), ("none",)], "key string"), sinks.stored_images(i)).where("data is null").first().content_type is None


def test_extract_rows_and_errors(spark):
    df = spark.createDataFrame([(1, "<div class=c><h2>A</h2></div><div class=c><h2>B</h2></div>"), (2, ""), (3, None)], "id int, html string")
    rows = extract.extract_rows(df, "css", {"baseSelector": ".c", "fields": [{"name": "t", "selector": "h2"}, {"name": "all", "selector": "*", "multiple": True}]})
    assert [tuple(r) for r in rows.orderBy("row").collect()] == [(1, 0, "A", ["A"]), (1, 1, "B", ["B"])]
    got = {r.id: (r.error_code, r.item_count) for r in extract.extract_pages(df, "regex", {"t": "h2>([A-Z])"}).collect()}
    assert got == {1: (None, 1), 2: ("INVALID_REQUEST", None), 3: ("INVALID_REQUEST", None)}
    items = spark.sql("SELECT 'css' AS strategy, 'u' AS url, '' AS html, parse_json('{}') AS schema UNION ALL SELECT 'x', 'u', '', parse_json('{}') UNION ALL SELECT 'css', ' ', null, parse_json('{}') UNION ALL SELECT 'css', 'u', '', null")
    assert [r.error_code for r in extract.request_errors(items).collect()] == [None, "UNSUPPORTED_STRATEGY", "INVALID_REQUEST", "INVALID_SCHEMA"]


def test_plans(spark, sf):
    """Predicates reach the scan, unused columns are not read, no Python below a JVM filter."""
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan(QUERIES["page_url_parts"](spark, sf))
    assert "Python" not in plan(QUERIES["page_url_parts"](spark, sf)) and "ArrowEvalPython" not in plan(QUERIES["doc_redact"](spark, sf))
    e = spark.read.parquet(f"{sf}/events.parquet").where("event_type = 'error'").select(classify.duration_bucket(F.col("value")))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,error)]" in plan(e)


def test_settled_and_attempted_tasks(spark):
    def run(row):
        if row["place"] % 3 == 0:
            raise ValueError(f"bad {row['place']}")
        return f"done {row['url']}"

    items = spark.createDataFrame([(i, f"u{i}") for i in range(7)], "place long, url string")
    got = jobs.settled(items, run, limit=2).orderBy("place").collect()
    assert [(r.status, r.value, r.reason) for r in got] == [("rejected", None, f"bad {i}") if i % 3 == 0 else ("fulfilled", f"done u{i}", None) for i in range(7)]
    assert jobs.settled(items.limit(0), run).collect() == []

    def execute(row):
        if row["url"] == "down":
            raise TimeoutError("timed out")
        return {"ok": (200, "r"), "gone": (404, None), "busy": (503, None)}[row["url"]]

    tasks = spark.createDataFrame([(n,) * 2 for n in ("ok", "gone", "busy", "down")], "task_id string, url string")
    tried = jobs.attempted(tasks, execute, most=1)
    assert {(r.task_id, r.attempt, r.success, r.status_code, r.error) for r in tried.collect()} == {("ok", 1, True, 200, None), ("gone", 1, False, 404, "HTTP 404"), ("busy", 1, False, 503, "HTTP 503"), ("busy", 2, False, 503, "HTTP 503"), ("down", 1, False, None, "timed out"), ("down", 2, False, None, "timed out")}
    assert {(r.task_id, r.attempts, r.success) for r in jobs.outcomes(tried, 1).collect()} == {("ok", 1, True), ("gone", 1, False), ("busy", 2, False), ("down", 2, False)}


def test_run_lock(spark):
    rows = [("j", "a", 0), ("j", "b", 30), ("j", "c", 60), ("j", "d", 119), ("k", "e", 5)]
    df = spark.createDataFrame(rows, "job_id string, run_id string, s long").select("job_id", "run_id", F.timestamp_seconds("s").alias("ts"))
    assert {r.run_id for r in jobs.claims(df, 60).where("granted").collect()} == {"a", "c", "e"}


def test_extraction_of_urls(spark):
    pages = spark.createDataFrame([("https://a.org/1", "<article><h1>One</h1>" + "<p>long enough text, with commas, for the main content.</p>" * 9 + "</article>"), ("https://a.org/2", " ")], "url string, html string")
    items = spark.createDataFrame([(1, "https://a.org/1", None), (2, "https://a.org/2", None), (3, "https://a.org/none", None), (4, None, "<h1>Own</h1>"), (5, None, None)], "id int, url string, html string")
    schema = {"fields": [{"name": "p", "selector": "p", "multiple": True}]}
    got = {r.id: r for r in extract.extract_sources(items, pages, "css", schema, with_markdown=True).collect()}
    assert got[1].error_code is None and got[1].matches == 9 and "long enough" in got[1].markdown
    assert [(got[i].error_code, got[i].error_message) for i in (2, 3)] == [("UPSTREAM_FETCH_FAILED", "Fetch Failed"), ("UPSTREAM_FETCH_FAILED", "Timeout")]
    assert got[4].error_code is None and got[4].matches == 0 and got[5].error_code == "INVALID_REQUEST"


def test_equal_creates_make_one(spark):
    rows = [("k", 1, "h"), ("k", 1, "h"), ("k", 1, "h"), ("k", 2, "x"), (None, 1, "h"), (None, 1, "h"), ("n", 3, None), ("n", 3, None)]
    df = spark.createDataFrame(rows, "idem_key string, ts int, payload_hash string").repartition(3)
    got = sorted((str(r.idem_key), r.ts, r.outcome) for r in jobs.idempotent(df).collect())
    assert got == sorted([("k", 1, "created"), ("k", 1, "replayed"), ("k", 1, "replayed"), ("k", 2, "conflict"), ("None", 1, "created"), ("None", 1, "created"), ("n", 3, "created"), ("n", 3, "replayed")])
    tied = df.withColumn("n", F.when(F.col("payload_hash") == "x", 0).otherwise(1)).withColumn("ts", F.lit(1))
    assert {(r.payload_hash, r.outcome) for r in jobs.idempotent(tied, tie="n").where("idem_key = 'k'").collect()} == {("x", "created"), ("h", "conflict")}


def test_one_of_several_is_always_the_same(spark):
    from pagemill.frames import numbered, one_each
    from pagemill.sources import sinks

    images = spark.createDataFrame([("https://a.org/x.png", "image/webp", b"2"), ("https://a.org/x.png", "image/webp", b"1")], "url string, content_type string, data binary")
    assert [bytes(r.data) for r in sinks.stored_images(images).collect()] == [b"1"]
    rows = spark.createDataFrame([(1, "b", 2), (1, "a", 3), (None, "z", 1), (None, None, 1)], "k int, a string, b int")
    assert sorted(map(str, one_each(rows, "k").collect())) == ["Row(k=1, a='a', b=3)", "Row(k=None, a=None, b=1)"]
    made = numbered(spark.range(1000).repartition(90), "n")
    assert sorted(r.n for r in made.collect()) == list(range(1000))
    assert numbered(rows.where("false"), "n").collect() == []


def test_convert_takes_any_columns(spark):
    from pagemill.operators import convert

    html = "<html><head><title>T</title></head><body><article><p>" + "Some words of text here. " * 30 + "</p></article></body></html>"
    pages = spark.createDataFrame([("https://a.org/1", html, "d", "w", "x", 1)], "url string, html string, domain string, wayback string, archive string, __rule int")
    rules = spark.createDataFrame([("a.org", [".ad"])], "domain string, remove_selectors array<string>")
    (row,) = convert.convert(pages, rules=rules).collect()
    assert row.error_code is None and "Some words" in row.content


def test_session_snapshots_use_every_core(spark, sf):
    made = QUERIES["session_snapshots"](spark, sf)  # one small file, much to do for each row
    assert made.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    cut = lambda text, most: spark.createDataFrame([(text,)], "t string").select(cache.clipped(F.col("t"), most)).first()[0]
    assert [cut("aé€😀z", n) for n in range(1, 12)] == ["a", "a�", "aé", "aé�", "aé�", "aé€", "aé€�", "aé€�", "aé€�", "aé€😀", "aé€😀z"]
