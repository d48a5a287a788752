import pytest

from pagemill.html import dom, render, select
from pagemill.html.extract import ExtractionError, extract


def md(html, **k):
    return render.html_to_markdown(html, "https://e.com/p", **k)[0]


def test_markdown_of_common_marks():
    got = md("<html><head><title>My  Title</title></head><body><article><h2>Two</h2><p>A <strong>b</strong> <em>c</em> <s>d</s> <a href='/x'>e</a></p><pre><code class='language-js'>let a\n</code></pre><pre data-lang='py'>x = 1</pre><blockquote><p>q</p></blockquote><ol><li>one<li>two</ol><img src='i.png' alt='pic'>" + "<p>filler text, enough of it to count as content of this page.</p>" * 4 + "</article></body></html>")
    for part in ("# My Title\n\n", "## Two", "**b**", "*c*", "~~d~~", "[e](https://e.com/x)", "```js\nlet a\n```", "```py\nx = 1\n```", "> q", "1. one\n2. two", "![pic](https://e.com/i.png)"):
        assert part in got


def test_tables_selector_and_fallbacks():
    assert "| a | b |\n| --- | --- |\n| 1 | x\\|y |" in md("<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>x|y</td></tr></table>")
    assert "colspan" in md("<table><tr><td colspan='2'>z</td></tr></table>")
    got = md("<div class='article'><h1>In</h1></div><div class='side'>Out</div>", selector=".article")
    assert "In" in got and "Out" not in got
    assert md("") == "" and md("   ") == "" and md("just text") == "just text"
    assert "hidden" not in md("<script>hidden()</script><nav>menu</nav><p>shown</p>")
    assert md("<p>" * 300 + "deep").endswith("deep")


def test_own_markdown_rules():
    own = {"mark": lambda node, writer: f"=={writer.children(node)}==", "s": lambda node, writer: writer.children(node)}
    assert md("<p>a <mark>b <b>c</b></mark> <s>d</s> <del>e</del></p>", rules=own) == "a ==b **c**== d ~~e~~"


def test_title_not_repeated():
    page = "<html><head><title>T</title></head><body><article><h1>T</h1><p>" + "long enough text, with commas, for the main content rule. " * 4 + "</p></article></body></html>"
    assert md(page).count("# T") == 1


@pytest.mark.parametrize(
    ("selector", "want"),
    [("li", 4), ("ul > li", 4), ("#a li", 2), (".x.y", 1), ("[data-k]", 2), ("[data-k='1']", 1), ("[data-k*=\"2\"]", 1), ("li:nth-of-type(2)", 2), ("li:first-child", 2), ("p, li", 5), ("ul li + li", 2), ("ul ~ p", 1), ("li:not(.x)", 3), ("*", 9)],
)
def test_select(selector, want):
    tree = dom.parse("<html><head></head><body><ul id=a><li class='x y'>1<li data-k=1>2</ul><ul><li data-k=12>3</li><li>4</li></ul><p>5</p></body></html>")
    assert len(select.select(dom.body_of(tree) if selector == "*" else tree, selector)) == (want if selector != "*" else 7)


@pytest.mark.parametrize("bad", ["", "li[", "a >", ">> b", "li:hover(", "..x", "a,,b"])
def test_bad_selectors(bad):
    with pytest.raises(select.SelectorError):
        select.select(dom.parse("<p>"), bad)


@pytest.mark.parametrize(
    ("path", "css"),
    [("//article[@class='post']", "article.post"), (".//h1", "h1"), ("/html/body//p", "html > body p"), ("//a[2]", "a:nth-of-type(2)"), ("//*[@id='m n']", "*#m\\ n"), ("//a[contains(@href,'x/y')]/text()", 'a[href*="x/y"]'), ("//p[@class='a b']", 'p[class="a b"]')],
)
def test_xpath(path, css):
    """A path finds what the selector of the same meaning finds."""
    tree = dom.parse("<html><head></head><body><article class='post new'><h1>One</h1><p class='a b'>x</p><p class='b a'>y</p><a href='/x/y'>1</a><a href='/x'>2</a></article><div id='m n'><h1>Two</h1><p>z</p></div></body></html>")
    found = select.select_path(tree, path)
    assert found and found == select.select(tree, css)


@pytest.mark.parametrize("path", ["", "//", "text()", "//a[", "//a[1][2]", "//a b", "//a[last()]", "//a[@x=1]", "a()", "///a", "//a[.='x']", "//p[@a='1' and @b='2']"])
def test_paths_beyond_the_subset(path):
    with pytest.raises(select.XPathError):
        select.path_steps(path)


CARDS = "<div class='card'><h2>Alpha</h2><a href='/a'>x</a></div><div class='card'><h2> Beta </h2><a href='/b'>y</a></div>"
FIELDS = [{"name": "t", "selector": "h2"}, {"name": "u", "selector": "a", "type": "attribute"}]


def test_structured():
    assert extract("css", CARDS, {"baseSelector": ".card", "fields": FIELDS}) == [{"t": "Alpha", "u": "/a"}, {"t": "Beta", "u": "/b"}]
    posts = "<article class='post'><h1>One</h1><a href='/one'></a></article><article class='post'><h1>Two</h1><a href='/two'></a></article>"
    rows = extract("xpath", posts, {"baseXPath": "//article[@class='post']", "fields": [{"name": "t", "xpath": ".//h1"}, {"name": "u", "xpath": ".//a", "type": "attribute"}]})
    assert rows == [{"t": "One", "u": "/one"}, {"t": "Two", "u": "/two"}]
    one = extract("css", CARDS, {"fields": [{"name": "t", "selector": "h2"}]}, selector=".missing")
    assert one == {"t": "Alpha"}
    assert extract("xpath", CARDS, {"baseXPath": "//nothing", "fields": [{"name": "t", "xpath": "//h2"}]}) == [{"t": "Alpha"}]
    items = "<ul><li>A</li><li> </li><li>B</li></ul>"
    many = {"fields": [{"name": "v", "selector": "li", "multiple": True}]}
    assert extract("css", items, many) == {"v": ["A", "B"]}
    assert extract("css", items, many, {"includeEmpty": True}) == {"v": ["A", "", "B"]}
    assert extract("css", CARDS, {"fields": [{"name": "h", "selector": ".card", "type": "html"}]})["h"] == '<h2>Alpha</h2><a href="/a">x</a>'


def test_regex():
    text = "a@b.co, C@D.org and A@B.CO, a@b.co"
    assert extract("regex", text, {"patterns": {"m": "[a-z]+@[a-z.]+"}, "flags": "gi"}, {"dedupe": True}) == {"m": ["a@b.co", "C@D.org", "A@B.CO"]}
    assert extract("regex", "aaa", {"z": "(?=a)"}) == {"z": []}
    assert extract("regex", "k=1; k=22", {"k": r"k=(\d+)"}) == {"k": ["1", "22"]}


@pytest.mark.parametrize(
    ("strategy", "html", "schema", "code"),
    [
        ("xpath", "<p>x", {"baseXPath": "//p[@a='1' and @b='2']", "fields": [{"name": "t"}]}, "UNSUPPORTED_XPATH"),
        ("css", "<p>x", {"fields": [{"name": "t", "selector": "h1", "required": True}]}, "EXTRACTION_FAILED"),
        ("css", "<p>x", {"fields": []}, "INVALID_SCHEMA"),
        ("css", "<p>x", {"fields": [{"name": "t", "selector": "p["}]}, "INVALID_SCHEMA"),
        ("regex", "x", {"a": "("}, "INVALID_SCHEMA"),
        ("regex", "x" * 1002, {"a": "x"}, "INVALID_REQUEST"),
        ("regex", "x", {}, "INVALID_SCHEMA"),
        ("css", "", {"fields": [{"name": "t"}]}, "INVALID_REQUEST"),
        ("css", "x" * 2_000_001, {"fields": [{"name": "t"}]}, "INVALID_REQUEST"),
        ("other", "x", {}, "UNSUPPORTED_STRATEGY"),
    ],
)
def test_errors(strategy, html, schema, code):
    with pytest.raises(ExtractionError) as e:
        extract(strategy, html, schema)
    assert e.value.code == code
