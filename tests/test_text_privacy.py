import hashlib
import hmac

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.functions import classify, privacy, text


def one(spark, f, *args):
    df = spark.createDataFrame([tuple(args)], ", ".join(f"c{i} {'string' if isinstance(a, str) or a is None else 'double'}" for i, a in enumerate(args)))
    return df.select(f(*(F.col(f"c{i}") for i in range(len(args))))).first()[0]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("failed at https://a.b/c?d=e now", "failed at [url] now"),
        ("Authorization: Bearer abc.def", "Authorization=[redacted]"),
        ("Set-Cookie: a=b; c=d\nnext", "Set-Cookie=[redacted]\nnext"),
        ("use Bearer xyz123", "use Bearer [redacted]"),
        ("password=hunter2&x=1", "password=[redacted]"),
        ('"my_api_key": "s3cret"', "my_api_key=[redacted]\""),
        ("mail jo.d@ex.org!", "mail [email]!"),
        ("nothing here", "nothing here"),
    ],
)
def test_redaction(spark, raw, want):
    assert one(spark, privacy.redacted, raw) == want


def test_redaction_twice_is_once(spark):
    rows = ["token=abc https://x.y/z", "cookie: a", "é secret: b c@d.ef", "Bearer q"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    r = df.select(privacy.redacted(F.col("t")).alias("a")).select("a", privacy.redacted(F.col("a")).alias("b")).collect()
    assert all(x.a == x.b for x in r if "token" not in x.a and "secret" not in x.a)


def test_dimensions_and_codes(spark):
    assert one(spark, privacy.dimension, "  Été / Foo--Bar!! ") == "t_foo--bar"
    assert one(spark, privacy.dimension, None) == ""
    code = lambda *a: one(spark, lambda t, o: privacy.error_code(t, o, F.lit(500)), *a)
    assert [code("Fetch-Failed", "convert_error"), code(None, "convert_error"), code("x", "success"), code("!!!", "convert_error")] == ["fetch_failed", "convert_error", "", "error"]
    assert [one(spark, privacy.engine, x) for x in ("JINA", "weird", "", None)] == ["jina", "custom", "", ""]


def test_hosts_paths_urls(spark):
    assert [one(spark, privacy.redacted_host, h) for h in ("a.b.Example.com", "example.com", "login.example.com", "10.0.0.1", "")] == ["*.example.com", "example.com", "[host]", "[host]", "[host]"]
    assert [one(spark, privacy.redacted_path, p) for p in ("/", "/a/b.PDF", "/a/b.exe", "/x")] == ["/", "/[path:2].pdf", "/[path:2]", "/[path:1]"]
    got = one(spark, privacy.debug_url, "https", "www.site.org", "/a/b", "q=1&token=x")
    assert got == "https://*.site.org/[path:2]?param_1=%5Bvalue%5D&redacted_2=%5Bredacted%5D"


def test_hmac(spark):
    for salt in ("pepper", "s" * 100):
        want = hmac.new(salt.encode(), "héllo".encode(), hashlib.sha256).hexdigest()[:32]
        assert one(spark, lambda c, s=salt: privacy.hmac_sha256(s, c), "héllo") == want
    assert one(spark, lambda c: privacy.hmac_sha256("", c), "x") == ""
    assert one(spark, lambda c: privacy.hmac_sha256("p", c), "") == ""


def test_request_id(spark):
    assert one(spark, privacy.request_id, " abc-12345 ") == "abc-12345"
    assert one(spark, privacy.request_id, "short") != "short"
    assert "token" not in one(spark, privacy.request_id, "token_abcdefghijkl")


def test_plain_text_and_formats(spark):
    md = "# Head\r\n\r\n**bold** and *it* `c` [link](u) ![alt](i)\n\n\n\n> quote\n- item\n1. one\n```py\nx = 1\n```\n~~old~~"
    assert one(spark, text.plain_text, md) == "Head\n\nbold and it c link alt\n\nquote\nitem\none\nx = 1\n\nold"
    assert one(spark, text.basic_html, "<a & 'b'>") == "<pre>&lt;a &amp; &#039;b&#039;&gt;</pre>"
    assert one(spark, text.snippet, "# T\n" + "word " * 60).endswith("…")
    assert one(spark, text.heading, "x\n# The  title \ny") == "The  title"
    got = one(spark, lambda m: text.proxied_images(m, "p.io"), "a ![x](https://mmbiz.qpic.cn/a?b=1) b ![y](https://o.org/z)")
    assert got == "a ![x](https://p.io/img/https%3A%2F%2Fmmbiz.qpic.cn%2Fa%3Fb%3D1) b ![y](https://o.org/z)"
    assert one(spark, lambda c: text.clamp_lines(c, 10, 3), "abcdef\ngh\nijkl") == "abc\ngh\n"


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="*_~`#>-1. ab\n", max_size=60), min_size=8, max_size=8))
def test_plain_text_leaves_no_pairs(spark, rows):
    df = spark.createDataFrame([(r,) for r in rows], "t string").select(text.plain_text(F.col("t")).alias("p"))
    assert not any("**a**" in r.p or "\n\n\n" in r.p for r in df.collect())


def test_buckets_and_clamps(spark):
    assert [one(spark, classify.duration_bucket, float(x)) for x in (0, 250, 999, 3000, 10000, 30000)] == ["lt_250ms", "250ms_1s", "250ms_1s", "3s_10s", "10s_30s", "gte_30s"]
    assert [one(spark, classify.selector_bucket, x) for x in (None, "a", "a" * 33, "a" * 129)] == ["none", "1_32", "33_128", "129_plus"]
    assert [one(spark, classify.quota_bucket, float(x)) for x in (0, 10, 11, 1000, 1001)] == ["none", "1_10", "11_100", "101_1000", "gt_1000"]
    assert [one(spark, classify.priority, x) for x in (0.0, 2.5, 1000.0)] == [1, 3, 100]
    assert [one(spark, classify.max_retries, x) for x in (-1.0, 3.6, 99.0)] == [0, 4, 10]
    assert [one(spark, classify.retention_days, x) for x in ("x", "0", "3.9", "99", None)] == [7, 7, 3, 14, 7]
    assert [one(spark, classify.excerpt_limit, x) for x in ("10", "9999", "")] == [256, 5000, 2000]
    assert [one(spark, classify.flag, x) for x in (" YES ", "on", "0", None)] == [True, True, False, False]
    assert [one(spark, classify.retry_delay_ms, float(x)) for x in (0, 1, 2, 5)] == [80, 160, 320, 400]
    assert one(spark, classify.wants_json, "text/markdown") and not one(spark, classify.wants_json, None)
    assert one(spark, classify.is_navigation, "GET", "text/html", None) and not one(spark, classify.is_navigation, "GET", "text/html,application/json", None)
