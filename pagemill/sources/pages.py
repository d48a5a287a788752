"""What fetchers leave behind, read as tables: attempts, redirects, provider answers, archives, rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..frames import one_each
from ..functions import classify, pages, urls

REDIRECTS = (301, 302, 303, 307, 308)
MAX_HOPS, ARCHIVE_CHARS = 5, 1000
LLMS_TTL_S, LLMS_MISSING_TTL_S = 24 * 3600, 3600


def read_pages(spark: SparkSession, path: str, most: int = pages.MAX_PAGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(pages, rejects) of a table with url and html; pages beyond the limit are rejects with an error."""
    table = spark.read.parquet(path)
    ok = F.coalesce(pages.within_limit(F.col("html"), most), F.lit(False))
    return table.where(ok), table.where(~ok).select("url", F.octet_length("html").alias("bytes"), F.lit("Content Too Large").alias("error"))


def decoded(body: Column, charset: str = "UTF-8") -> Column:
    return F.decode(body, charset)


def final_urls(starts: DataFrame, redirects: DataFrame, hops: int = MAX_HOPS) -> DataFrame:
    """(url, final_url, hops, error) along redirects (src, dst, status): each hop must be safe, and there are at most ``hops``."""
    moves = urls.with_parts(redirects.where(F.col("status").isin(*REDIRECTS)), "dst", "p")
    safe = urls.is_http(F.col("dst"), F.col("p.scheme")) & urls.is_safe_host(F.col("p.scheme"), F.col("p.host"))
    moves = one_each(moves.select("src", "dst", safe.alias("safe")), "src")
    at = starts.select("url").distinct().select("url", F.col("url").alias("final_url"), F.lit(0).alias("hops"), F.lit(None).cast("string").alias("error"))
    for hop in range(1, hops + 2):
        go = F.col("dst").isNotNull() & F.col("error").isNull()
        blocked = go & ~F.col("safe")
        over = go & F.lit(hop > hops)
        at = at.join(moves, at.final_url == moves.src, "left").select(
            "url",
            F.when(go & ~blocked & ~over, F.col("dst")).otherwise(F.col("final_url")).alias("final_url"),
            F.when(go & ~blocked & ~over, hop).otherwise(F.col("hops")).alias("hops"),
            F.when(over, f"Too many redirects (max {hops}).").when(blocked, "Redirect target blocked by SSRF protection").otherwise(F.col("error")).alias("error"),
        )
    return at


def with_retries(attempts: DataFrame, most: int = 2) -> DataFrame:
    """(url, attempts, status, delay_ms) of logged attempts (url, attempt from 0, status): the first that is not worth a retry, or the last allowed."""
    ends = ~F.coalesce(classify.retryable_status(F.col("status")), F.lit(True)) | (F.col("attempt") >= most)
    end = F.struct("attempt", "status")
    done = attempts.groupBy("url").agg(F.min_by(end, F.when(ends, F.col("attempt"))).alias("stop"), F.max_by(end, "attempt").alias("last"))
    x = F.coalesce("stop", "last")
    waits = F.aggregate(F.when(x["attempt"] > 0, F.sequence(F.lit(0), x["attempt"] - 1)).otherwise(F.array().cast("array<int>")), F.lit(0).cast("long"), lambda a, i: a + classify.retry_delay_ms(i))
    return done.select("url", (x["attempt"] + 1).alias("attempts"), x["status"].alias("status"), waits.alias("delay_ms"))


def reader_answer(body: Column) -> Column:
    """struct(markdown, title, error) of a reader service's JSON."""
    d = F.from_json(body, "code int, data struct<content:string,title:string>")["data"]
    text = F.coalesce(d["content"], F.lit(""))
    return F.struct(F.nullif(text, F.lit("")).alias("markdown"), F.coalesce(d["title"], F.lit("")).alias("title"), F.when(F.trim(text) == "", "empty content").alias("error"))


def scrape_answer(body: Column) -> Column:
    """struct(markdown, title, error) of a scrape service's JSON; the title of the metadata comes first."""
    d = F.from_json(body, "success boolean, data struct<markdown:string,title:string,metadata:struct<title:string>>")["data"]
    text = F.coalesce(d["markdown"], F.lit(""))
    title = F.coalesce(F.nullif(d["metadata"]["title"], F.lit("")), d["title"], F.lit(""))
    return F.struct(F.nullif(text, F.lit("")).alias("markdown"), title.alias("title"), F.when(F.trim(text) == "", "empty content").alias("error"))


def first_accepted(attempts: DataFrame) -> DataFrame:
    """Of attempts (url, proxy, variant, accepted[, status, bytes, error], ...), the first accepted of each url in order of proxy, then variant.

    Adds ``attempts``, how many were made, and ``errors``, what was said of those before
    it: an attempt's own error, or that its answer was rejected. Null counts as not
    accepted; a url without an accepted attempt has all errors and nulls.
    """
    have, order = attempts.columns, F.struct("proxy", "variant")
    rest = [c for c in have if c not in ("url", "accepted")]
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")
    rejected = F.concat(F.lit("rejected status="), text("status"), F.lit(" body_bytes="), text("bytes"))
    said = F.coalesce(F.nullif(text("error"), F.lit("")), rejected)
    line = F.concat(F.lit("proxy["), F.col("proxy").cast("string"), F.lit("]/"), F.col("variant").cast("string"), F.lit(": "), said)
    won = F.coalesce("accepted", F.lit(False))
    made = attempts.groupBy("url").agg(F.min_by(F.struct(*rest), F.when(won, order)).alias("a"), F.array_sort(F.collect_list(F.struct(order.alias("at"), line.alias("line")))).alias("every"))
    mine = F.struct(F.col("a.proxy").alias("proxy"), F.col("a.variant").alias("variant"))
    before = F.filter("every", lambda x: F.col("a").isNull() | (x["at"] < mine))
    n = F.size(before) + F.col("a").isNotNull().cast("int")
    return made.select("url", "a.*", F.col("a").isNotNull().alias("accepted"), n.alias("attempts"), F.transform(before, lambda x: x["line"]).alias("errors"))


def with_archives(table: DataFrame, snapshots: DataFrame, newest: DataFrame) -> DataFrame:
    """Pages with the archived HTML of either source (url, html[, at]), first one first; of a source the copy captured last, or the longest. Short copies don't count."""
    order = lambda d: F.struct(*([F.col("at")] if "at" in d.columns else []), F.length("html"), F.xxhash64("html"))
    one = lambda d, n: d.where(F.length("html") > ARCHIVE_CHARS).groupBy("url").agg(F.max_by("html", order(d)).alias(n))
    made = table.join(one(snapshots, "__a"), "url", "left").join(one(newest, "__b"), "url", "left")
    source = F.when(F.col("__a").isNotNull(), "wayback").when(F.col("__b").isNotNull(), "archive")
    return made.withColumns({"archive_html": F.coalesce("__a", "__b"), "archive_source": source}).drop("__a", "__b")


def site_summaries(sites: DataFrame, fetched: DataFrame, now: Column) -> DataFrame:
    """Each site (host) with the first live text of fetched candidates (host, candidate, text, fetched_at): found texts live a day, misses an hour."""
    ttl = F.when(F.col("text").isNotNull(), LLMS_TTL_S).otherwise(LLMS_MISSING_TTL_S)
    live = fetched.where(F.col("fetched_at") + F.make_dt_interval(secs=ttl) > now)
    first = live.where("text is not null").groupBy("host").agg(F.min_by("text", "candidate").alias("text"))
    return sites.join(first, "host", "left").join(live.select("host").distinct().withColumn("known", F.lit(True)), "host", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def proxies(table: DataFrame, raw: str = "raw") -> DataFrame:
    """Distinct user, password, host, port of lists of ``user:password@host:port`` (commas, semicolons, new lines), in first-seen order of ``place``."""
    item = F.trim(F.col("item"))
    auth = F.regexp_extract(item, r"^(.*)@([^@]*)$", 1)
    target = F.regexp_extract(item, r"^(.*)@([^@]*)$", 2)
    host = F.when(target.startswith("["), F.regexp_extract(target, r"^\[([^\]]+)\]:\d+$", 1)).otherwise(F.regexp_extract(target, r"^(.+):\d+$", 1))
    port = F.regexp_extract(target, r":(\d+)$", 1).try_cast("int")
    made = table.select(F.posexplode(F.split(F.col(raw), r"[\n,;]")).alias("place", "item")).select("place", F.substring_index(auth, ":", 1).alias("username"), F.regexp_extract(auth, r"^[^:]*:(.*)$", 1).alias("password"), host.alias("host"), port.alias("port"))
    latin = r"^[\x21-\x{7e}\x{a1}-\x{ff}]+$"
    ok = F.col("username").rlike(latin) & F.col("password").rlike(latin) & (F.col("host") != "") & ~F.col("host").rlike(r"\s") & F.col("port").between(1, 65535)
    first = Window.partitionBy("username", "password", F.lower("host"), "port").orderBy("place")
    return made.where(ok).withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
