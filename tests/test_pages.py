import json

import pytest
from pyspark.sql import functions as F

from pagemill.functions import pages
from pagemill.html import social
from pagemill.operators import adapters, convert


def one(spark, f, html):
    return spark.createDataFrame([(html,)], "h string").select(f(F.col("h"))).first()[0]


def test_paywall_and_challenge(spark):
    look = lambda h: one(spark, pages.looks_paywalled, h)
    assert look("<p>short</p>" + " " * 15_000) and look("<p>Subscribe to CONTINUE reading</p>") and not look("<p>plain paragraph text</p>" * 50)
    need = lambda h: one(spark, pages.needs_browser, h)
    assert need("<div class=cf-challenge>") and need("a captcha here") and need("<script>window.location='/x'</script>")
    assert not need("captcha" + "x" * 10_000) and not need("<script>window.location=1</script>" + "word " * 60)
    assert one(spark, pages.is_challenge, "please VERIFY the captcha") and one(spark, pages.is_challenge, "当前环境异常") and not one(spark, pages.is_challenge, "<p>hello</p>")
    assert one(spark, pages.looks_expired, "please login") and not one(spark, pages.looks_expired, "hello sign in")
    assert one(spark, pages.is_paywall_script, "https://CDN.tinypass.com/a.js")
    assert [one(spark, pages.is_ui_text, t) for t in ("Share", "Last modified: May", "Jan 3", "Modified yesterday", "2024-01-02 x", "An ordinary line of text that goes on")] == [True, True, True, True, True, False]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ('<div class="x paywall y">a</div>b', "b"),
        ('<p data-piano>q</p>k', "k"),
        ('<section id="piano-offer">z</section>t', "t"),
        ("<div data-testid='paywall'>m</div>n", "n"),
        ('<div class="paywall"><div>in</div>rest</div>', "rest</div>"),
        ('<div class="article-body" style="overflow: hidden">t</div>', '<div class="article-body" >t</div>'),
        ('<div class="article-body" style="color:red">t</div>', '<div class="article-body" style="color:red">t</div>'),
    ],
)
def test_overlays(spark, html, want):
    assert one(spark, pages.without_paywall, html) == want


def test_rule_selectors_and_rules(spark):
    assert one(spark, lambda h: pages.without_paywall(h, [".mine"]), '<i class="mine">a</i>b') == "b"
    assert pages.rules_from_json("{bad", [1]) == [1] and pages.rules_from_json(" ", [1]) == pages.PAYWALL_RULES
    assert pages.rules_from_json('[{"domains":[]}]', [1]) == pages.PAYWALL_RULES
    own = pages.rules_from_json('[{"domains":["A.org","b.org"],"referer":"r"},{"domains":["b.org"]}]', [])
    rows = {r.domain: r.referer for r in pages.paywall_rules(spark, own).collect()}
    assert rows == {"a.org": "r", "b.org": None}
    df = spark.createDataFrame([("www.ft.com",), ("ft.com.evil.org",)], "host string")
    assert [r.googlebot for r in pages.with_paywall_rule(df, pages.paywall_rules(spark)).orderBy("host").collect()] == [None, True]


def ld(*items):
    return "".join(f"<script type='application/ld+json'>{x if isinstance(x, str) else json.dumps(x)}</script>" for x in items)


def test_json_ld(spark):
    long, longer = "word " * 50, "more " * 60
    get = lambda *x: one(spark, pages.json_ld_article, ld(*x))
    got = get({"@type": "NewsArticle", "headline": " A & B ", "articleBody": long + "\n\n<next>"}, "{bad")
    assert got.startswith("<html><head><title>A &amp; B</title></head><body><article><h1>A &amp; B</h1>\n<p>word") and "<p>&lt;next&gt;</p>" in got
    assert "more" in get({"@type": "Article", "articleBody": long}, [{"@type": ["Thing", "Report"], "articleBody": longer}])
    assert "word" in get({"@graph": [{"@type": "BlogPosting", "articleBody": long}]})
    assert get({"@type": "Product", "articleBody": long}) is None and get({"@type": "Article", "articleBody": "short"}) is None and get({"@type": "Article", "articleBody": 5}) is None and get("nope") is None


def test_amp_and_sites(spark):
    assert one(spark, pages.amp_link, '<link href="https://a/amp" rel="amphtml">') == "https://a/amp"
    assert one(spark, pages.amp_link, "<link rel=stylesheet>") is None
    assert one(spark, pages.without_amp_controls, '<p subscriptions-section="content-not-granted" amp-access-hide>x</p>') == "<p>x</p>"
    assert one(spark, pages.forum_url, "https://www.reddit.com/r/x") == "https://old.reddit.com/r/x"
    page = "<html><head></head><body><div id='side'>s</div><div id='siteTable'><p>post</p></div><div class='commentarea'>c</div></body></html>"
    assert one(spark, pages.forum_post, page) == "<html><head></head><body><div id='siteTable'><p>post</p></div></body></html>"
    assert one(spark, pages.forum_post, "<p>other</p>") == "<p>other</p>"
    df = spark.createDataFrame([("https://t.feishu.cn/wiki/a", "t.feishu.cn", "/wiki/a"), ("https://www.feishu.cn/wiki/a", "www.feishu.cn", "/wiki/a"), ("https://zhuanlan.zhihu.com/p/1", "zhuanlan.zhihu.com", "/p/1"), ("https://x.com/a", "x.com", "/a"), ("https://box.com/a", "box.com", "/a")], "u string, h string, p string")
    assert [r[0] for r in df.select(pages.adapter(F.col("u"), F.col("h"), F.col("p"))).collect()] == ["feishu", "generic", "zhihu", "twitter", "generic"]


def test_social_article_and_harvest(spark):
    page = "<html><head><title>T</title></head><body><h1 id='activity-name'> Name </h1><a id='js_name'>Me</a><div id='js_content'><img data-src='r.png'><section class=\"code-snippet__fix\" data-lang='js'><ul class=\"code-snippet__line-index\"><li></li></ul><pre data-lang=\"js\"><code>a &lt; b</code><code>ounter(line</code></pre></section></div></body></html>"
    got = social.article(page)
    assert "<h1>Name</h1>" in got and "作者: Me" in got and 'src="r.png"' in got and '<pre data-lang="js"><code>a &lt; b</code></pre>' in got and "ounter" not in got
    assert social.article("<p>x</p>") == "<p>x</p>"
    html = "<div><h2>Head</h2><p>text one</p><p>text one</p><p>Share</p><ul><li>item</li></ul><blockquote>said</blockquote><pre>x=1</pre><figure><img src='/i.png'><figcaption>cap</figcaption></figure><img src='s.png' width=20><img src='https://o.org/i.png?x=1'></div>"
    df = spark.createDataFrame([(html,), ("",), (None,), ("<p>ab</p><img src='/x.png'>",)], "h string").select(convert.leaves("h").alias("b"))
    got = df.select(convert.harvested(F.col("b")), convert.block_markdown(F.col("b"))).collect()
    assert got[0][0] == ["## Head", "text one", "- item", "> said", "\n```\nx=1\n```\n", "{{IMG:/i.png}}", "cap"]
    assert got[1][0] == got[2][0] == [] and got[3][1] == "ab\n\n![](/x.png)"


def test_adapters(spark):
    own = adapters.scaffold("mine", ["mine.org/"], transform_url=lambda u: F.concat(u, F.lit("?print=1")), post_process=lambda h: F.replace(h, F.lit("ad"), F.lit("")))
    every = adapters.register(own)
    df = spark.createDataFrame([("https://mine.org/a", "x ad y"), ("https://www.reddit.com/r/x", "z"), ("https://b.org/", None)], "url string, html string")
    u, h = F.col("url"), F.col("html")
    got = df.select(adapters.name_of(u, every).alias("n"), adapters.site_url(u, every).alias("at"), adapters.post_processed(h, adapters.name_of(u, every), every).alias("h")).collect()
    assert [tuple(r) for r in got] == [("mine", "https://mine.org/a?print=1", "x  y"), ("reddit", "https://old.reddit.com/r/x", "z"), ("generic", "https://b.org/", None)]
    there = spark.createDataFrame([("https://old.reddit.com/r/x", "post")], "url string, html string")
    assert {r.url: r.html for r in adapters.fetched(df.select("url"), there, every).collect()} == {"https://mine.org/a": None, "https://www.reddit.com/r/x": "post", "https://b.org/": None}
    for bad in (("", ["x"]), ("generic", ["x"]), ("a", [])):
        with pytest.raises(ValueError):
            adapters.scaffold(*bad)


def test_convert_amp_rules_providers_and_sites(spark):
    text = "<p>Enough text, with commas, to be the main content of a page.</p>" * 30
    wall = "<div class='own-wall'>x</div><p>subscribe to read</p>" + "<i></i>" * 400
    rows = [
        ("https://www.ft.com/amp", '<link rel="amphtml" href="/amp/1">' + wall),
        ("https://www.ft.com/shut", '<link rel="amphtml" href="/amp/2">' + wall),
        ("https://www.ft.com/own", "<article><h1>T</h1><p class='own-wall'>pay now please</p>" + text + "</article>"),
        ("https://b.org/own", "<article><h1>T</h1><p class='own-wall'>pay now please</p>" + text + "</article>"),
        ("https://b.org/thin", "<p>thin</p>" + "<i></i>" * 400),
        ("https://t.feishu.cn/wiki/a", "<div><h1>Doc</h1><p>first block</p><img src='/p.png'></div>"),
        ("https://mp.weixin.qq.com/s/1", f"<h1 id='activity-name'>Name</h1><div id='js_content'>{text}<img data-src='https://mmbiz.qpic.cn/a b'></div>"),
    ]
    df = spark.createDataFrame(rows, "url string, html string")
    rules = pages.paywall_rules(spark, [{"domains": ["ft.com"], "removeSelectors": [".own-wall"]}])
    amp = spark.createDataFrame([("https://www.ft.com/amp/1", f"<article><p amp-access-hide>open</p>{text}</article>"), ("https://www.ft.com/amp/2", wall)], "url string, html string")
    old = spark.createDataFrame([("https://www.ft.com/shut", f"<article>older{text}{text}</article>", "wayback", 1), ("https://www.ft.com/shut", f"<article>newer{text}</article>", "wayback", 2)], "url string, html string, source string, at int")
    told = spark.createDataFrame([("https://b.org/thin", None, json.dumps({"data": {"content": "what the reader says " * 3, "title": "Told"}}))], "url string, scrape string, reader string")
    got = {r.url: r for r in convert.convert(df, rules=rules, amp=amp, archives=old, answers=told, image_host="i.org").collect()}
    amped, shut, own, other, thin, doc, social_page = (got[u] for u, _ in rows)
    assert "Enough text" in amped.content and amped.fallbacks == ["amp"] and amped.paywall_detected
    assert "newer" in shut.content and shut.fallbacks == ["wayback_post_convert"]
    assert "pay now" not in own.content and "pay now" in other.content
    assert thin.content.startswith("what the reader") and (thin.title, thin.method, thin.fallbacks) == ("Told", "jina", ["jina_fallback"])
    assert doc.content == "# Doc\n\nfirst block\n\n![](/p.png)"
    assert social_page.content.startswith("# Name") and "https://i.org/img/" in social_page.content
    assert convert.convert(df.limit(0), rules=rules, amp=amp, archives=old, answers=told).collect() == []


def test_convert(spark):
    body = "<article><h1>Title</h1>" + "<p>Enough text, with commas, to be the main content of a page.</p>" * 12 + "</article>"
    wall = "<p>subscribe to read</p>" + " " * 200
    rows = [
        ("https://a.org/ok", body, 200, "text/html"),
        ("https://a.org/pdf", body, 200, "application/pdf"),
        ("https://a.org/404", body, 404, "text/html"),
        ("https://a.org/empty", " ", 200, None),
        ("https://a.org/big", "x" * (5 << 20) + "y", 200, "text/html"),
        ("https://www.ft.com/wall", wall, 200, "text/html"),
        ("https://a.org/ld", wall + ld({"@type": "Article", "headline": "H", "articleBody": "rescued " * 90}), 200, "text/html"),
    ]
    df = spark.createDataFrame(rows, "url string, html string, status int, content_type string")
    old = spark.createDataFrame([("https://www.ft.com/wall", "<article>" + "<p>archived text, in full, as it was before the wall went up.</p>" * 30 + "</article>")], "url string, html string")
    got = {r.url.rsplit("/", 1)[1]: r for r in convert.convert(df, rules=pages.paywall_rules(spark), archives=old).collect()}
    assert {k: r.error_code for k, r in got.items()} == {"ok": None, "pdf": 415, "404": 502, "empty": 502, "big": 413, "wall": None, "ld": None}
    assert got["ok"].content.startswith("# Title") and got["ok"].fallbacks == [] and not got["ok"].paywall_detected
    assert "archived text" in got["wall"].content and got["wall"].fallbacks == ["archive_post_convert"] and got["wall"].paywall_detected
    assert "rescued" in got["ld"].content and got["ld"].fallbacks == ["jsonld"]
    assert json.loads(convert.convert(df.limit(1), "json").first().content)["title"] == ""


def test_ladder(spark):
    df = spark.createDataFrame([(None, "f", "j", None, "p", ""), (" ", "f", "j", None, "p", "jina"), ("c", "f", None, None, "p", "firecrawl")], "cached string, firecrawl string, jina string, cf string, page string, engine string")
    assert [(r.content, r.method) for r in convert.by_ladder(df).collect()] == [("p", "readability"), ("j", "jina"), ("c", "cached")]


def test_json_ld_is_read_once(spark):
    made = spark.createDataFrame([("",)], "html string").select(pages.json_ld_article(F.col("html")).alias("x"))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1, plan.count("regexp_extract_all(")
