import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from pagemill.operators import crawl, links

S = "https://s.example/"


def graph(spark, edges, extra=()):
    pages = {a for a, _ in edges} | {b for _, b in edges} | set(extra)
    html = {p: "".join(f'<a href="/{b}">{b}</a>' for a, b in edges if a == p) for p in pages}
    df = spark.createDataFrame([(S + p, h) for p, h in html.items()], "url string, html string")
    return df.select("url"), links.edges(df)


def order(state):
    return [(r.url.removeprefix(S), r.depth) for r in crawl.ordered(state).orderBy("visit").collect()]


def test_breadth_first_order(spark):
    pages, edges = graph(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("c", "e")])
    state = crawl.breadth_first(pages, edges, S + "a", crawl.Settings(max_depth=2))
    assert order(state) == [("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 2)]
    rows = {r.url: r for r in state.results.collect()}
    assert rows[S + "d"].parent_url == S + "b" and rows[S + "c"].links_discovered == 1
    assert state.stats == {"crawled_pages": 5, "succeeded_pages": 5, "failed_pages": 0, "enqueued_pages": 5, "visited_pages": 5}


def test_links_of_a_page():
    html = '<a href="/p#x">one</a><a href="/p">again</a><a href="https://o.example/">out</a><a href="mailto:a@b.c">m</a><a href="javascript:x()">j</a><a>none</a>'
    assert links.links_of(html, S) == [(S + "p", "one"), (S + "p", "again"), ("https://o.example/", "out")]


def test_external_and_duplicate_links(spark):
    df = spark.createDataFrame([(S, '<a href="/p#x">1</a><a href="/p">2</a><a href="https://o.example/">3</a>'), (S + "p", "")], "url string, html string")
    state = crawl.breadth_first(df.select("url"), links.edges(df), S, crawl.Settings(max_depth=1))
    assert [u for u, _ in order(state)] == ["", "p"] and state.enqueued == 2
    both = crawl.breadth_first(df.select("url"), links.edges(df), S, crawl.Settings(max_depth=1, include_external=True))
    assert [r.error for r in crawl.ordered(both).orderBy("visit").collect()] == [None, None, crawl.NOT_FOUND]


def plain(start, out, there, depth, most):
    queue, seen, rows = [(start, None, 0)], {start}, []
    while queue and len(rows) < most:
        url, parent, d = queue.pop(0)
        n = 0
        if url in there and d < depth:
            for dst in out.get(url, []):
                if dst not in seen:
                    seen.add(dst)
                    queue.append((dst, url, d + 1))
                    n += 1
        rows.append((url, parent, d, url in there, n))
    return rows, len(seen)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_a_queue_on_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = 25
    e = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(60)]
    there = {f"n{i}" for i in range(n) if rng.random() < 0.85} | {"n0"}
    out = {}
    for a, b in e:
        if a in there:
            out.setdefault(a, []).append(b)
    df = spark.createDataFrame([(S + a, "".join(f'<a href="/{b}">{b}</a>' for b in out.get(a, []))) for a in there], "url string, html string")
    depth, most = rng.randint(1, 3), rng.choice([5, 12, 100])
    state = crawl.breadth_first(df.select("url"), links.edges(df), S + "n0", crawl.Settings(max_depth=depth, max_pages=most))
    want, seen = plain("n0", out, there, depth, most)
    got = [(r.url.removeprefix(S), r.parent_url and r.parent_url.removeprefix(S), r.depth, r.success, r.links_discovered) for r in crawl.ordered(state).orderBy("visit").collect()]
    assert got == want and state.visited.count() == state.enqueued == seen


def test_stop_save_and_resume(spark, tmp_path):
    pages, edges = graph(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "e")])
    some, all_ = crawl.Settings(max_depth=2, max_pages=2), crawl.Settings(max_depth=2, max_pages=5)
    folder = str(tmp_path / "c")
    levels = []
    crawl.save(crawl.breadth_first(pages, edges, S + "a", some, on_level=levels.append), folder, S + "a", some)
    assert [x.completed for x in levels] == [False, False, True]
    state = crawl.breadth_first(pages, edges, S + "a", all_, crawl.load(spark, folder, S + "a", all_))
    assert [u for u, _ in order(state)] == ["a", "b", "c", "d", "e"]
    with pytest.raises(crawl.Conflict):
        crawl.load(spark, folder, S + "b", all_)
    with pytest.raises(crawl.Conflict):
        crawl.load(spark, folder, S + "a", crawl.Settings(keywords=("x",)))


def test_filters_and_settings(spark):
    df = spark.createDataFrame([(S + "a", '<a href="/b">k</a><a href="/c">x</a>', "text/html"), (S + "b", "", "image/png"), (S + "c", "", None)], "url string, html string, content_type string")
    state = crawl.breadth_first(df.select("url", "content_type"), links.edges(df), S + "a", crawl.Settings(content_types=("text/html",)))
    assert {r.url.removeprefix(S): r.error for r in state.results.collect()} == {"a": None, "b": crawl.FILTERED, "c": None}
    only = crawl.breadth_first(df.select("url"), links.edges(df), S + "a", crawl.Settings(keywords=("k",), threshold=1.0))
    assert [u for u, _ in order(only)] == ["a", "b"]
    for bad in ({"max_depth": 7}, {"max_pages": 0}, {"keywords": (" ",)}):
        with pytest.raises(ValueError):
            crawl.Settings(**bad)
    with pytest.raises(ValueError):
        crawl.breadth_first(df, links.edges(df), "mailto:x", crawl.Settings())


def test_best_first(spark):
    df = spark.createDataFrame([(S, '<a href="/tie2">key</a><a href="/low">no</a><a href="/high">key word</a><a href="/tie1">key</a>'), *((S + x, "") for x in ("tie1", "tie2", "low", "high"))], "url string, html string")
    seeds = spark.createDataFrame([(S,)], "seed string")
    got = crawl.best_first(df.select("url"), links.edges(df), seeds, crawl.Settings(max_depth=1, max_pages=4, keywords=("key", "word"), threshold=1.0))
    rows = got.orderBy("visit").collect()
    assert [r.url.removeprefix(S) for r in rows] == ["", "high", "tie1", "tie2"] and rows[0].score == 0 and rows[0].links_discovered == 3
    assert len({r.url for r in rows}) == 4


def plain_best_first(seed: str, out: dict[str, list[tuple[str, float]]], pages: dict[str, bool], s) -> list[tuple]:
    """One seed's visits in order: highest score, then least depth, then URL in the root locale's order. ``pages``: known URLs, and whether they pass the filters."""
    heap: list[tuple] = [(-math.inf, 0, (), seed, None, 0.0)]
    seen, rows = {seed}, []
    while heap and len(rows) < s.max_pages:
        _, depth, _, url, parent, score = heapq.heappop(heap)
        ok, count = pages.get(url), 0
        if ok and depth < s.max_depth:
            for dst, points in out.get(url, ()):
                if dst not in seen:
                    seen.add(dst)
                    count += 1
                    heapq.heappush(heap, (-points, depth + 1, crawl.collation_key(dst), dst, url, points))
        rows.append((len(rows) + 1, url, parent, depth, score, bool(ok), count, None if ok else crawl.NOT_FOUND if ok is None else crawl.FILTERED))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_best_first_equals_a_queue(spark, seed):
    """Rounds of fetched links visit what one queue a seed visits: ties, cycles, pages that fail, more links than a queue keeps."""
    r = random.Random(seed)
    names = [f"{c}{i}" for c in "aBé-_" for i in range(12)]
    rows = sorted({(r.choice(names), r.choice(names)) for _ in range(420)})
    pos = [(S + a, i, S + b, "key " * (b[1:] in ("3", "7")) + b) for i, (a, b) in enumerate(rows)]
    edges = spark.createDataFrame(pos, "src string, pos int, dst string, anchor string")
    pages = spark.createDataFrame([(S + n,) for n in names if n[1:] != "5"], "url string")
    s = crawl.Settings(max_depth=4, max_pages=25, keywords=("key", "B"))
    starts = [S + "a0", S + "B1", S + "é2", "no url", S + "a0"]
    got = crawl.best_first(pages, edges, spark.createDataFrame([(x,) for x in starts], "seed string"), s).collect()
    scored = crawl.prepared_edges(edges, s).orderBy("src", "pos").collect()
    out = {}
    for e in scored:
        out.setdefault(e.src, []).append((e.dst, e.score))
    known = {p.url: True for p in pages.collect()}
    want = [(x, *row) for x in starts[:3] for row in plain_best_first(crawl.whatwg.normalize(x), {k: v for k, v in out.items()}, known, s)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_collation_bytes_sort_as_the_key_does():
    words = ["a", "A", "á", "ab", "a-b", "a_b", "a1", "a10", "a2", "b", "", "é", "z", "Z", "ß", "日", "/", "a/", "a//b"]
    assert sorted(words, key=crawl.collation_bytes) == sorted(words, key=crawl.collation_key)


def test_images(spark):
    known = spark.createDataFrame([("https://c.org/a/1.png?x=1", "k1"), ("/b/2.png", "k2"), ("https://c.org/deep/3.png", "k3")], "src string, key string")
    asked = spark.createDataFrame([(1, "https://c.org/a/1.png?x=1"), (2, "https://o.org/b/2.png"), (3, "deep/3.png"), (4, "none.png")], "id int, src string")
    assert {r.id: r.key for r in links.resolve_images(asked, known).collect()} == {1: "k1", 2: "k2", 3: "k3", 4: None}
    inside = spark.createDataFrame([(1, "https://h.org/b/2.png/640"), (2, "/b/2"), (3, None), (4, "https://x.org"), (4, "https://x.org"), (5, "/z"), (6, "https://q.org/cdn/https://c.org/deep/3.png/")], "id int, src string")
    got = sorted((r.id, r.key) for r in links.resolve_images(inside, known).collect())
    assert got == [(1, "k2"), (2, "k2"), (3, None), (4, None), (4, None), (5, None), (6, "k3")]


def test_containing_equals_trying_all(spark):
    r = random.Random(5)
    word = lambda n: "".join(r.choice("ab/") for _ in range(n))
    texts, patterns = sorted({word(r.randrange(30)) for _ in range(150)}), sorted({word(r.randrange(14)) for _ in range(150)} - {""})
    frame = lambda xs, n: spark.createDataFrame([(x,) for x in xs], f"{n} string")
    got = sorted(map(tuple, links.containing(frame([*texts, None], "text"), frame([*patterns, "", None], "pattern")).collect()))
    assert got == sorted((x, p) for x in texts for p in patterns if p in x)


def test_stored_crawls_are_whole_and_end(spark, tmp_path):
    """A crash between the writes leaves the older version; a crawl ends with its time."""
    pages, edges = graph(spark, [("a", "b"), ("b", "c")])
    s, folder = crawl.Settings(max_depth=2, max_pages=1), str(tmp_path / "crawl")
    state = crawl.breadth_first(pages, edges, S + "a", s)
    with pytest.raises(crawl.NotStored):
        crawl.load(spark, folder, S + "a", s)
    crawl.save(state, folder, S + "a", s, ttl_seconds=60, now=1000.0)
    later = crawl.breadth_first(pages, edges, S + "a", crawl.Settings(max_depth=2, max_pages=2))

    class Stop(Exception):
        pass

    class Broken:
        def __getattr__(self, name):
            if name == "visited":
                raise Stop
            return getattr(later, name)

    with pytest.raises(Stop):
        crawl.save(Broken(), folder, S + "a", s, ttl_seconds=60, now=1001.0)
    assert crawl.load(spark, folder, S + "a", s, now=1059.0).results.count() == 1
    crawl.save(later, folder, S + "a", s, ttl_seconds=60, now=1002.0)
    assert crawl.load(spark, folder, S + "a", s, now=1061.0).results.count() == 2
    with pytest.raises(crawl.NotStored):
        crawl.load(spark, folder, S + "a", s, now=1062.0)
    assert not crawl.expire(spark, folder, now=1061.0) and crawl.expire(spark, folder, now=1062.0) and not crawl.expire(spark, folder, now=1063.0)
    for bad in (59, 30 * 86_400 + 1):
        with pytest.raises(ValueError):
            crawl.save(state, folder, S + "a", s, ttl_seconds=bad)


def test_a_foreign_frontier_of_many_partitions_keeps_all_rows(spark):
    rows = spark.range(1300).repartition(130).select(F.concat(F.lit(S), "id").alias("url"), F.lit(None).cast("string").alias("parent_url"), F.lit(1.0).alias("depth"), F.lit(0.0).alias("score"))
    made = crawl.restored_frontier(rows, 3)
    assert made.select("place").distinct().count() == 1300
    state = crawl.resumed(rows, rows.select("url"), crawl.breadth_first(*graph(spark, [("a", "b")]), S + "a", crawl.Settings(max_depth=0)).results, 0, 3)
    more = crawl.breadth_first(rows.select("url"), spark.createDataFrame([], links.EDGES), S + "a", crawl.Settings(max_depth=3, max_pages=6), state)
    assert more.results.count() == 6 and more.frontier.count() == 1295


def test_internal_addresses_are_never_followed(spark):
    df = spark.createDataFrame([(S, '<a href="http://127.0.0.1/">x</a><a href="http://db.internal/">y</a><a href="https://o.example/">z</a>'), ("http://127.0.0.1/", ""), ("https://o.example/", "")], "url string, html string")
    s = crawl.Settings(max_depth=1, include_external=True)
    assert [r.url for r in crawl.ordered(crawl.breadth_first(df.select("url"), links.edges(df), S, s)).orderBy("visit").collect()] == [S, "https://o.example/"]
    inside = crawl.breadth_first(df.select("url"), links.edges(df), "http://127.0.0.1/", s).results.collect()
    assert [(r.success, r.error) for r in inside] == [(False, crawl.FILTERED)]
    seeds = spark.createDataFrame([(S,)], "seed string")
    assert {r.url for r in crawl.best_first(df.select("url"), links.edges(df), seeds, s).collect()} == {S, "https://o.example/"}


def test_own_filters_scorers_and_callbacks(spark):
    pages, edges = graph(spark, [("a", "b"), ("a", "c"), ("a", "d"), ("c", "e"), ("d", "f")])
    mine = {"filters": [lambda url, anchor: ~url.endswith("/b")], "scorers": [lambda url, anchor: F.when(anchor == "d", 5).otherwise(1), lambda url, anchor: F.lit(0.5)]}
    seen, states = [], []
    state = crawl.breadth_first(pages, edges, S + "a", crawl.Settings(max_depth=2), on_results=seen.append, on_level=states.append, every=3, **mine)
    assert [u for u, _ in order(state)] == ["a", "c", "d", "e", "f"]
    assert {r.url.removeprefix(S): r.score for r in state.results.collect()} == {"a": 0.0, "c": 1.5, "d": 5.5, "e": 1.5, "f": 1.5}
    assert [x.count() for x in seen] == [1, 2, 2] and [x.results.count() for x in states] == [3, 5]
    best = crawl.best_first(pages, edges, spark.createDataFrame([(S + "a",)], "seed string"), crawl.Settings(max_depth=2), **mine).orderBy("visit").collect()
    assert [r.url.removeprefix(S) for r in best] == ["a", "d", "c", "e", "f"]


def test_ties_follow_the_root_locale():
    every = ["https://a.example/_x", "https://a.example/-x", "https://a.example/1", "https://a.example/a", "https://a.example/A", "https://a.example/ä", "https://a.example/b", "https://a.example/B"]
    assert sorted(every[::-1], key=crawl.collation_key) == every


def test_resumed_counts(spark):
    pages, edges = graph(spark, [("a", "b"), ("b", "c")])
    state = crawl.breadth_first(pages, edges, S + "a", crawl.Settings(max_depth=2, max_pages=1))
    assert crawl.resumed(state.frontier, state.visited, state.results, 0, 2).enqueued == 2
    assert crawl.resumed(state.frontier, state.visited, state.results, 9, 2).enqueued == 9
    rest = crawl.breadth_first(pages, edges, S + "a", crawl.Settings(max_depth=2), crawl.resumed(state.frontier, state.visited, state.results, 0, 2))
    assert [u for u, _ in order(rest)] == ["a", "b", "c"]
    empty = crawl.breadth_first(pages.limit(0), edges, S + "a", crawl.Settings())
    assert [r.error for r in empty.results.collect()] == [crawl.NOT_FOUND]
