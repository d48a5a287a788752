import pytest
from pyspark.sql import functions as F

from pagemill.functions import urls, whatwg
from pagemill.functions.text import wrapped
from pagemill.operators.crawl import restored_frontier

SAFE = ["https://example.com/", "http://8.8.8.8/", "https://sub.example.co.uk:8443/a?b#c", "http://172.32.0.1/", "http://100.128.0.1/", "http://[2606:4700::1]/", "http://11.0.0.1/"]
UNSAFE = ["http://localhost", "http://LOCALHOST./x", "http://127.0.0.1", "http://127.1", "http://0.0.0.0", "http://10.0.0.1", "http://172.16.0.1", "http://192.168.0.9", "http://169.254.169.254", "http://100.64.1.1", "http://[::1]", "http://[fc00::1]", "http://[fe80::2]", "http://[::ffff:127.0.0.1]", "http://[::ffff:a00:1]", "http://[::7f00:1]", "http://2130706433", "http://0x7f000001", "http://1.2.3.4.nip.io", "http://a.localtest.me", "http://x.internal", "http://printer.local", "http://home.arpa", "http://y.test", "ftp://example.com", "javascript:alert(1)", "", "no url"]


def test_safety(spark):
    df = spark.createDataFrame([(u, True) for u in SAFE] + [(u, False) for u in UNSAFE], "url string, want boolean")
    p = urls.with_parts(df)
    rows = p.select("url", "want", urls.is_safe_host(F.col("parts.scheme"), F.col("parts.host")).alias("got")).collect()
    assert [(r.url, r.got) for r in rows if r.got != r.want] == []
    assert {r.url for r in urls.safe_pages(df).collect()} == set(SAFE)


@pytest.mark.parametrize(
    ("path", "search", "want"),
    [
        ("/https://example.com/a", "", "https://example.com/a"),
        ("/https%3A%2F%2Fexample.com%2Fa", "", "https://example.com/a"),
        ("/https//example.com", "", "https://example.com"),
        ("/example.com/x", "?raw=true&q=1", "https://example.com/x?q=1"),
        ("/https://e.com/?a=1", "?format=json&b=2&selector=.x", "https://e.com/?a=1&b=2"),
        ("/nodots", "", None),
        ("/.hidden", "", None),
        ("/", "", None),
        ("/https://e.com/" + "x" * 5000, "", None),
    ],
)
def test_target_url(spark, path, search, want):
    df = spark.createDataFrame([(path, search)], "p string, s string")
    assert df.select(urls.target_url(F.col("p"), F.col("s"))).first()[0] == want


def test_request_path_round_trip(spark):
    df = spark.createDataFrame([("https://e.com/a b?x=1&y=(2)", ".main")], "u string, s string")
    got = df.select(urls.request_path(F.col("u"), selector=F.col("s"))).first()[0]
    assert got == "/https%3A%2F%2Fe.com%2Fa%20b%3Fx%3D1%26y%3D(2)?raw=true&selector=.main"
    path, _, search = got.partition("?")
    back = spark.createDataFrame([(path, search)], "p string, s string").select(urls.target_url(F.col("p"), F.col("s"))).first()[0]
    assert back == "https://e.com/a b?x=1&y=(2)"


@pytest.mark.parametrize(
    ("text", "base", "want"),
    [
        ("/b?x#f", "https://E.com:443/a/c", "https://e.com/b?x"),
        ("../d", "https://e.com/a/b/c", "https://e.com/a/d"),
        ("//cdn.org/x", "http://e.com", "http://cdn.org/x"),
        ("mailto:a@b.c", "http://e.com", None),
        ("javascript:void(0)", "http://e.com", None),
        ("HTTP://EXAMPLE.com:80/a b", None, "http://example.com/a%20b"),
        ("http://127.1/", None, "http://127.0.0.1/"),
        ("http://münchen.de/ä", None, "http://xn--mnchen-3ya.de/%C3%A4"),
        ("http://a.com/%7Ex", None, "http://a.com/%7Ex"),
        ("http://", None, None),
        ("http://a.com:99999/", None, None),
        ("  http://a.com/\n", None, "http://a.com/"),
        ("http://[::FFFF:1.2.3.4]/", None, "http://[::ffff:102:304]/"),
        ("?q=1", "http://a.com/p", "http://a.com/p?q=1"),
        ("http:b", "http://a.com/p/q", "http://a.com/p/b"),
    ],
)
def test_normalize(text, base, want):
    assert whatwg.normalize(text, base) == want


def test_filters(spark):
    df = spark.createDataFrame([("https://a.example.com/x/1", "a.example.com", "Text/HTML; charset=x"), ("https://bad.example.com/", "bad.example.com", "application/json"), ("https://other.org/", "other.org", None), ("::", None, None)], "u string, h string, t string")
    r = df.select(urls.matches_glob(F.col("u"), [" https://*.EXAMPLE.com/x/? "]).alias("g"), urls.passes_domains(F.col("h"), ["https://Example.com/p"], ["bad.example.com"]).alias("d"), urls.passes_content_type(F.col("t"), ["text/html"]).alias("c"), urls.matches_glob(F.col("u"), [" "]).alias("all")).collect()
    assert [x.g for x in r] == [True, False, False, False]
    assert [x.d for x in r] == [True, False, False, False]
    assert [x.c for x in r] == [True, False, True, True]
    assert all(x["all"] for x in r)


def test_scorer_and_domain(spark):
    df = spark.createDataFrame([("https://x.org/Guide-API", "the api", "www.bbc.co.uk"), ("https://x.org/", None, "a.b.c.org.")], "u string, a string, h string")
    r = df.select(urls.keyword_score(F.col("u"), F.col("a"), ["api", " Guide ", "zzz", ""], 2).alias("s"), urls.registrable(F.col("h")).alias("d")).collect()
    assert [(x.s, x.d) for x in r] == [(4.0, "bbc.co.uk"), (0.0, "c.org")]


def test_small_parts(spark):
    df = spark.createDataFrame([("/api/jobs/j1/run", "a=1; mm_session=x=y; b", [" a ", "b", "a", ""]), ("/api/other", None, [])], "p string, c string, l array<string>")
    r = df.select(urls.job_path(F.col("p")).alias("j"), urls.cookie(F.col("c"), "mm_session").alias("c"), urls.string_list(F.col("l"), "tags", 4).alias("l")).collect()
    assert [(tuple(x.j), x.c, tuple(x.l)) for x in r] == [(("j1", "run"), "x=y", (None, "tags must only contain non-empty strings.")), ((None, None), None, ([], None))]
    rows = spark.createDataFrame([("generic", "a.org"), ("generic", "www.paid.com"), ("generic", "no.org"), ("reddit", "b.org")], "adapter string, host string")
    rules = spark.createDataFrame([("paid.com",)], "domain string")
    assert [x.host for x in urls.provider_eligible(rows, rules, spark.createDataFrame([("no.org",)], "host string")).collect()] == ["a.org"]
    assert spark.createDataFrame([("one two three four five",)], "t string").select(wrapped(F.col("t"), 9, 2)).first()[0] == ["one two", "three"]
    f = spark.createDataFrame([("HTTP://A.org/x#y", None, 9.5, float("inf")), ("bad", None, 0.0, 1.0)], "url string, parent_url string, depth double, score double")
    got = restored_frontier(f, 3).collect()
    assert [(x.url, x.depth, x.score) for x in got] == [("http://a.org/x", 3, 0.0)]
