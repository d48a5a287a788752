"""Breadth-first and best-first traversal of a link graph held in tables.

Breadth-first runs in levels: one join of a level to the edges, an anti-join against
what was visited, and a rank by the place of the parent and of the link give the
very order that a queue would. Best-first depends on every step before it, so all
seeds go on in rounds, each of which fetches the links of the pages next in every queue.
"""

from __future__ import annotations

import heapq
import json
import math
import time
import unicodedata
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import folders
from ..frames import numbered
from ..functions import urls, whatwg
from ..session import kept

NODE = "url string, parent_url string, depth int, score double, success boolean, links_discovered int, error string"
FRONTIER = "url string, parent_url string, depth int, score double, place long"
NOT_FOUND, FILTERED = "Page not found.", "Filtered by active filter chain."
MAX_DEPTH, MAX_PAGES = 6, 200


@dataclass(frozen=True)
class Settings:
    """What a crawl may do. Depth 0 to 6, pages 1 to 200."""

    max_depth: int = 2
    max_pages: int = 20
    include_external: bool = False
    patterns: tuple[str, ...] = ()
    allow: tuple[str, ...] = ()
    block: tuple[str, ...] = ()
    content_types: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()
    weight: float = 1.0
    threshold: float = -math.inf

    def __post_init__(self):
        if not 0 <= self.max_depth <= MAX_DEPTH:
            raise ValueError(f"max_depth must be 0 to {MAX_DEPTH}.")
        if not 1 <= self.max_pages <= MAX_PAGES:
            raise ValueError(f"max_pages must be 1 to {MAX_PAGES}.")
        for name in ("patterns", "allow", "block", "content_types", "keywords"):
            items = [x.strip() for x in getattr(self, name)]
            if any(not x for x in items):
                raise ValueError(f"{name} must not hold blanks.")
            object.__setattr__(self, name, tuple(dict.fromkeys(items)))

    def same_plan(self, other: Settings) -> bool:
        """Equal but for depth and pages, which a resumed crawl may change."""
        mine, theirs = asdict(self), asdict(other)
        for k in ("max_depth", "max_pages"):
            mine.pop(k), theirs.pop(k)
        return json.dumps(mine, sort_keys=True) == json.dumps(theirs, sort_keys=True)


@dataclass
class State:
    """A crawl that can go on: frontier, visited and results as tables."""

    results: DataFrame
    frontier: DataFrame
    visited: DataFrame
    enqueued: int
    completed: bool
    stats: dict = field(default_factory=dict)


#: A caller's own rule or score: a Column of a URL and of its anchor text (null for a page).
Rule = Callable[[Column, Column], Column]


def page_filter(url: Column, parts: Column, content_type: Column, s: Settings) -> Column:
    """Validity and safety, then patterns, domains and content types."""
    return urls.all_of(urls.is_safe(url, parts), urls.matches_glob(url, list(s.patterns)), urls.passes_domains(parts["host"], s.allow, s.block), urls.passes_content_type(content_type, list(s.content_types)))


def target_score(s: Settings, scorers: Sequence[Rule] = ()) -> Column:
    """The keyword score of an edge's target and all scorers of the caller, added up."""
    url, anchor = F.col("dst"), F.col("anchor")
    return urls.composite_score(urls.keyword_score(url, anchor, list(s.keywords), s.weight), *(f(url, anchor).cast("double") for f in scorers))


def prepared_edges(edges: DataFrame, s: Settings, filters: Sequence[Rule] = (), scorers: Sequence[Rule] = ()) -> DataFrame:
    """Edges that may be followed, with the ``score`` of their target and its ``to_host``; other columns stay."""
    made = urls.with_parts(edges, "dst", "__p")
    keep = page_filter(F.col("dst"), F.col("__p"), F.lit(None).cast("string"), s)
    keep = urls.all_of(keep, *(F.coalesce(f(F.col("dst"), F.col("anchor")), F.lit(False)) for f in filters))
    return made.withColumns({"score": target_score(s, scorers), "to_host": F.col("__p.netloc")}).where(keep & (F.col("score") >= s.threshold)).drop("__p")


def breadth_first(
    pages: DataFrame,
    edges: DataFrame,
    seed: str,
    s: Settings,
    state: State | None = None,
    on_level: Callable[[State], None] | None = None,
    every: int = 0,
    on_results: Callable[[DataFrame], None] | None = None,
    filters: Sequence[Rule] = (),
    scorers: Sequence[Rule] = (),
) -> State:
    """Crawl ``pages`` (url[, content_type]) along ``edges``.

    ``on_level`` sees the state at the end of each level, or with ``every`` of each
    level in which that many more pages were visited, and at the end; ``on_results`` the
    rows of each level. A level takes one write: its new links. What was visited is at
    most ``max_pages`` rows, which the driver holds; links to choose from stay tables.

    Failed and filtered pages count as pages; the seed is exempt from link rules, not
    from page rules. Null targets and pages without links lead nowhere; of repeated
    pages the least content type counts; without pages the seed is not found.
    """
    spark, start = pages.sparkSession, whatwg.normalize(seed)
    if start is None:
        raise ValueError("Invalid seed URL")
    types = pages.select("url", (F.col("content_type") if "content_type" in pages.columns else F.lit(None).cast("string")).alias("content_type"))
    home, any_page = whatwg.parse(start).netloc, F.lit(None).cast("string")
    results_of = lambda rows: spark.createDataFrame(rows, NODE + ", place long")
    if state is None:
        frontier = spark.createDataFrame([(start, None, 0, 0.0, 0)], FRONTIER)
        rows, visited, enqueued = [], spark.createDataFrame([(start,)], "url string"), 1
    else:
        rows, frontier, visited, enqueued = [tuple(r) for r in state.results.collect()], state.frontier, state.visited, state.enqueued
    begun = len(rows)
    while len(rows) < s.max_pages:
        # a place begins with its depth, so the first are of one level, or end it; at most max_pages rows
        near = frontier.orderBy("place").limit(s.max_pages - len(rows)).collect()
        if not near:
            break
        depth = near[0].depth
        taken = [r for r in near if r.depth == depth]
        asked = F.broadcast(spark.createDataFrame([(r.url,) for r in taken], "url string"))  # as many
        there = urls.with_parts(types.join(asked, "url").groupBy("url").agg(F.min("content_type").alias("content_type")), "url", "p")
        passes = urls.all_of(page_filter(F.col("url"), F.col("p"), F.col("content_type"), s), *(F.coalesce(f(F.col("url"), any_page), F.lit(False)) for f in filters))
        passed = {r.url: r.ok for r in there.select("url", passes.alias("ok")).collect()}
        found: dict[str, int] = {}
        frontier = frontier.where(F.col("place") > taken[-1].place)
        if depth < s.max_depth and any(passed.values()):
            # the last page that the crawl has room for still follows its links: it is counted after
            sources = spark.createDataFrame([(r.url, n) for n, r in enumerate(taken, 1) if passed.get(r.url)], "src string, rank int")
            out = prepared_edges(edges.join(F.broadcast(sources), "src"), s, filters, scorers)
            out = out if s.include_external else out.where(F.col("to_host") == home)
            out = out.join(visited.withColumnRenamed("url", "dst"), "dst", "left_anti")
            # the first link to a target, in the order of the pages and of their links
            link = F.struct("rank", "pos")
            fresh = out.groupBy("dst").agg(F.min_by(F.struct("src", "rank", "pos", "score"), link).alias("x"))
            place = F.lit((depth + 1) << 40) + (F.col("x.rank").cast("long") + len(rows)) * (1 << 20) + F.col("x.pos")
            new = kept(fresh.select(F.col("dst").alias("url"), F.col("x.src").alias("parent_url"), F.lit(depth + 1).alias("depth"), F.col("x.score").alias("score"), place.alias("place")))
            found = {r.parent_url: r["count"] for r in new.groupBy("parent_url").count().collect()}  # a row a page taken
            frontier, visited = frontier.unionByName(new), visited.union(new.select("url"))
            enqueued += sum(found.values())
        fault = {None: NOT_FOUND, False: FILTERED, True: None}
        fresh_rows = [(r.url, r.parent_url, r.depth, r.score, bool(passed.get(r.url)), found.get(r.url, 0), fault[passed.get(r.url)], r.place) for r in taken]
        crossed = not every or (len(rows) - begun) // every < (len(rows) + len(fresh_rows) - begun) // every
        rows += fresh_rows
        if on_results:
            on_results(results_of(fresh_rows))
        if on_level and crossed:
            on_level(State(results_of(rows), frontier, visited, enqueued, False))
    state = State(results_of(rows), frontier, visited, enqueued, True)
    state.stats = crawl_stats(state)
    if on_level:
        on_level(state)
    return state


def crawl_stats(state: State) -> dict:
    r = state.results.agg(F.count("*").alias("crawled"), F.count_if("success").alias("succeeded")).first()
    return {"crawled_pages": r.crawled, "succeeded_pages": r.succeeded, "failed_pages": r.crawled - r.succeeded, "enqueued_pages": state.enqueued, "visited_pages": state.visited.count()}


def ordered(state: State) -> DataFrame:
    """Results in the order of their visits, numbered from 1."""
    return state.results.withColumn("visit", F.row_number().over(Window.orderBy("depth", "place"))).drop("place")


def restored_frontier(frontier: DataFrame, max_depth: int) -> DataFrame:
    """A foreign frontier (url, parent_url, depth, score), made fit to go on with: bad URLs dropped, depth clamped, score 0 where it is none.

    Within a depth its rows keep the order they lie in; each has a place of its own.
    """
    score = F.when(F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf")), 0.0).otherwise(F.col("score"))
    depth = F.least(F.greatest(F.floor(F.coalesce("depth", F.lit(0))), F.lit(0)), F.lit(max_depth)).cast("int")
    made = frontier.select(urls.normalized_alone(F.col("url")).alias("url"), urls.normalized_alone(F.col("parent_url")).alias("parent_url"), depth.alias("depth"), score.alias("score"))
    return numbered(made.where("url is not null"), "place").withColumn("place", F.col("depth").cast("long") * (1 << 40) + F.col("place"))


#: How long a stored crawl lives, in seconds: unless said otherwise, at least, at most.
TTL_SECONDS, MIN_TTL, MAX_TTL = 7 * 86_400, 60, 30 * 86_400


def _versions(spark: SparkSession, folder: str) -> list[tuple[int, object]]:
    """The whole versions stored in ``folder``, oldest first: those whose plan, written last, is complete."""
    found = folders.inside(spark, folder, "v")
    return [(n, path) for n, path in found if folders.whole(spark, f"{path}/meta")]


def save(state: State, folder: str, seed: str, s: Settings, ttl_seconds: int = TTL_SECONDS, now: float | None = None) -> None:
    """Frontier, visited and results as Parquet, and the plan, written last, beside them.

    Every save is a new version; until its plan is complete the one before it counts, so
    a crash between the writes leaves the older state whole. A version two older is removed.
    """
    if not MIN_TTL <= ttl_seconds <= MAX_TTL:
        raise ValueError(f"ttl_seconds must be {MIN_TTL} to {MAX_TTL}.")
    spark = state.results.sparkSession
    number = max((n for n, _ in folders.inside(spark, folder, "v")), default=0) + 1
    path = f"{folder}/v={number:08d}"
    for name in ("results", "frontier", "visited"):
        getattr(state, name).write.parquet(f"{path}/{name}")
    until = (time.time() if now is None else now) + ttl_seconds
    meta = json.dumps({"seed": seed, "enqueued": state.enqueued, "completed": state.completed, "settings": asdict(s), "until": until}, sort_keys=True)
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.text(f"{path}/meta")
    for n, old in folders.inside(spark, folder, "v"):
        if n < number - 1:
            folders.remove(spark, old)


def resumed(frontier: DataFrame, visited: DataFrame, results: DataFrame, enqueued: int, max_depth: int) -> State:
    """A state from stored parts of any age: the frontier made fit to go on with, and as many enqueued as were stored, visited or are there, whichever is most."""
    fit = restored_frontier(frontier, max_depth)
    here = fit.count() + results.count()
    return State(results, fit, visited, max(enqueued, visited.count(), here, 1), False)


class Conflict(ValueError):
    """A stored crawl that belongs to another seed or plan."""


class NotStored(LookupError):
    """No crawl is stored there, or its time has passed."""


def _plan(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/meta").first()[0])


def expire(spark: SparkSession, folder: str, now: float | None = None) -> bool:
    """Remove a stored crawl whose time has passed; whether there was one."""
    versions = _versions(spark, folder)
    gone = bool(versions) and _plan(spark, versions[-1][1])["until"] <= (time.time() if now is None else now)
    if gone:
        folders.remove(spark, folder)
    return gone


def load(spark: SparkSession, folder: str, seed: str, s: Settings, now: float | None = None) -> State:
    """The last whole version of a saved crawl, if it lives and has this seed and plan (depth and pages may differ)."""
    versions = _versions(spark, folder)
    if not versions:
        raise NotStored(f"No crawl is stored in {folder}.")
    folder = versions[-1][1]
    meta = _plan(spark, folder)
    if meta["until"] <= (time.time() if now is None else now):
        raise NotStored("The stored crawl has expired.")
    old = Settings(**{k: tuple(v) if isinstance(v, list) else v for k, v in meta["settings"].items()})
    if meta["seed"] != seed or not old.same_plan(s):
        raise Conflict("The stored crawl has another seed or configuration.")
    read = lambda n: spark.read.parquet(f"{folder}/{n}")
    return State(read("results"), read("frontier"), read("visited"), meta["enqueued"], meta["completed"])


#: Signs of addresses in the order of the root collation, before digits and letters.
_SIGNS = "_-,;:!?.'\"()[]{}@*/\\&#%`^+<=>|~$"


def collation_key(text: str) -> tuple:
    """A key that orders addresses as the root locale does: signs, digits, letters; then accents; then small letters before capitals."""
    plain = unicodedata.normalize("NFD", text)
    base = [c for c in plain if not unicodedata.combining(c)]
    weight = [(0, _SIGNS.find(c), "") if c in _SIGNS else (1, int(c), "") if c in "0123456789" else (2, 0, c.lower()) for c in base]
    return weight, [c for c in plain if unicodedata.combining(c)], [c != c.lower() for c in base], text


def collation_bytes(text: str) -> bytes:
    """``collation_key`` as bytes that sort alike: every part ends in a byte below all others."""
    weight, accents, capitals, plain = collation_key(text)
    code = lambda w: bytes([1, 1 + w[1]]) if w[0] == 0 else bytes([2, 1 + w[1]]) if w[0] == 1 else b"\x03" + b"".join((ord(c) + 1).to_bytes(3, "big") for c in w[2]) + b"\x00"
    signs = lambda cs: b"".join((ord(c) + 1).to_bytes(3, "big") for c in cs)
    return b"".join(map(code, weight)) + b"\x00\x00" + signs(accents) + b"\x00\x00\x00" + bytes(1 + c for c in capitals) + b"\x00" + plain.encode()


#: Pages of a seed whose links are fetched ahead in a round, the next ones of its queue.
AHEAD = 8
#: Rounds after which the tables of links seen are put together.
COMPACT = 16
_QUEUED = "seed string, url string, parent_url string, depth int, score double"
_VISITED = "seed string, visit int, url string, parent_url string, depth int, score double, success boolean, links_discovered int, error string"
_ROUND = f"kind string, {_VISITED}"


def _visits(s: Settings):
    """One seed's round: visits from its queue, as long as the links of the next page are at hand.

    Its rows are its queue (at most ``max_pages``), of which ``ready`` pages have links at
    hand, and those links, without any that it has seen.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        none = lambda v: None if v is None or pd.isna(v) else v
        done = int(rows["done"].iloc[0])
        queue = [(-r.score, r.depth, collation_key(r.url), r.url, none(r.parent_url), bool(r.ready), none(r.ok)) for r in rows[~rows["link"]].itertuples()]
        heapq.heapify(queue)
        out: dict[str, list[tuple[str, float]]] = {}
        for r in rows[rows["link"]].sort_values(["parent_url", "pos"]).itertuples():
            out.setdefault(r.parent_url, []).append((r.url, r.score))
        fresh, made = set(), []
        while queue and done < s.max_pages and queue[0][5]:
            score, depth, _, url, parent, _, ok = heapq.heappop(queue)
            count = 0
            if ok and depth < s.max_depth:
                for dst, points in out.get(url, ()):
                    if dst not in fresh:
                        fresh.add(dst)
                        count += 1
                        heapq.heappush(queue, (-points, depth + 1, collation_key(dst), dst, url, False, None))
            done += 1
            made.append(("visit", key[0], done, url, parent, depth, -score, bool(ok), count, None if ok else NOT_FOUND if ok is None else FILTERED))
        # what cannot be visited any more leaves the queue, but stays among what was seen
        made += [("queue", key[0], done, url, parent, depth, -score, None, None, None) for score, depth, _, url, parent, *_ in heapq.nsmallest(s.max_pages - done, queue)]
        made += [("seen", key[0], done, url, None, None, None, None, None, None) for url in fresh]
        return pd.DataFrame(made, columns=_ROUND_NAMES).astype({"depth": "Int32", "links_discovered": "Int32"})

    return run


_ROUND_NAMES = [c.split()[0] for c in _ROUND.split(", ")]


def best_first(pages: DataFrame, edges: DataFrame, seeds: DataFrame, s: Settings, filters: Sequence[Rule] = (), scorers: Sequence[Rule] = ()) -> DataFrame:
    """(seed, visit, url, parent_url, depth, score, success, links_discovered, error) for each seed of ``seeds`` (seed).

    Highest score first, then least depth, then URL in the root locale's order. All
    seeds go on in rounds: the next pages of every queue meet the links in one join, and
    each seed visits on until it needs links it has not got; a round visits one page a
    seed at least. A queue keeps no more than can still be visited, so a task holds at most
    ``max_pages`` pages of a seed and the unseen links of ``AHEAD`` pages, never its neighbourhood.

    Seeds that are no URLs have no rows, repeated seeds count once; null targets lead
    nowhere; of repeated pages the least content type counts.
    """
    has_type = F.col("content_type") if "content_type" in pages.columns else F.lit(None).cast("string")
    known = urls.with_parts(pages.groupBy("url").agg(F.min(has_type).alias("content_type")), "url", "p")
    any_page = F.lit(None).cast("string")
    passes = urls.all_of(page_filter(F.col("url"), F.col("p"), F.col("content_type"), s), *(F.coalesce(f(F.col("url"), any_page), F.lit(False)) for f in filters))
    known = kept(known.select("url", passes.alias("ok")))
    usable = kept(prepared_edges(edges, s, filters, scorers).where("dst is not null").select("src", "pos", "dst", "score", "to_host"))
    start = seeds.select("seed", urls.normalized_alone(F.col("seed")).alias("url")).where("url is not null").distinct()
    home = kept(urls.with_parts(start, "url", "p").select("seed", F.col("p.netloc").alias("home")))
    queue = kept(start.select("seed", "url", F.lit(None).cast("string").alias("parent_url"), F.lit(0).alias("depth"), F.lit(0.0).alias("score"), F.lit(0).alias("done")))
    seen = [queue.select("seed", "url")]
    visits: list[DataFrame] = []
    while not queue.isEmpty():
        # the next of each queue: its own order by score, depth and, near enough, URL; the visits follow the exact order
        by = Window.partitionBy("seed").orderBy(F.desc("score"), "depth", collated(F.col("url")))
        heads = queue.withColumn("__n", F.row_number().over(by))
        ahead = heads.where(F.col("__n") <= AHEAD).join(known, "url", "left").join(home, "seed")
        met = ahead.where(F.col("ok") & (F.col("depth") < s.max_depth)).withColumnRenamed("url", "src").select("seed", "src", "done", "home").join(usable, "src")
        met = met if s.include_external else met.where("to_host = home")
        new = met.groupBy("seed", "src", "dst", "done").agg(F.min_by(F.struct("pos", "score"), "pos").alias("x"))
        every = seen[0]
        for part in seen[1:]:
            every = every.union(part)
        new = new.join(every.withColumnRenamed("url", "dst"), ["seed", "dst"], "left_anti")
        none = lambda kind: F.lit(None).cast(kind)
        links = new.select("seed", F.col("dst").alias("url"), F.col("src").alias("parent_url"), none("int").alias("depth"), F.col("x.score").alias("score"), "done", F.lit(True).alias("link"), F.col("x.pos").alias("pos"), F.lit(False).alias("ready"), none("boolean").alias("ok"))
        own = heads.join(ahead.select("seed", "url", "ok", F.lit(True).alias("ready")), ["seed", "url"], "left")
        own = own.select("seed", "url", "parent_url", "depth", "score", "done", F.lit(False).alias("link"), none("int").alias("pos"), F.coalesce("ready", F.lit(False)).alias("ready"), "ok")
        moved = kept(own.unionByName(links).groupBy("seed").applyInPandas(_visits(s), _ROUND))
        visits.append(moved.where("kind = 'visit'").drop("kind"))
        seen.append(moved.where("kind = 'seen'").select("seed", "url"))
        queue = moved.where("kind = 'queue'").select("seed", "url", "parent_url", "depth", "score", F.col("visit").alias("done"))
        if len(visits) % COMPACT == 0:
            seen, visits = [kept(_together(seen))], [kept(_together(visits))]
    return _together(visits) if visits else pages.sparkSession.createDataFrame([], _VISITED)


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def collated(url: Column) -> Column:
    """Bytes in the order of ``collation_key``."""

    @F.pandas_udf("binary")
    def keys(values: pd.Series) -> pd.Series:
        return values.map(collation_bytes)

    return keys(url)
