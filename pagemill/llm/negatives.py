"""Hard negatives by a vantage-point tree over norm-augmented vectors.

Components become integers, so inner products are exact. With one more component,
the square root of the largest squared norm less a row's own, all rows have one norm
M. An anchor, scaled to that norm and with 0 for the extra component, is then
sqrt(2 * M^2 - 2 * score * M / |anchor|) away from a row: higher scores are nearer rows,
and a window of scores is an annulus of distances around the anchor.

A top tree, fitted on at most ``TOP_LEAVES * LEAF_SAMPLE`` rows, deals every row to a
leaf; the least and largest distance of a leaf's rows from each vantage point above it
are taken from all of them. Leaves are dealt on into blocks of about ``BLOCK`` rows, by
their row numbers, so no group of equal vectors is too large. A query goes to
the blocks whose leaf its annulus meets; a worker holds one block at a time, builds a
tree over it and visits the block's leaves nearest first inside the annulus, until none
left can hold a better row. Each search has two waves: the nearest block first, for a
score that the last wanted row has at least, then every block that can hold as good a
one. Bounds give way by ``SLACK``, so no row is lost to rounding: results are exact.

Defined results: rows with a null id, label, vector or component, or with one that is
not finite, take no part; a shorter vector counts as ending in zeros; floor(256 * x)
beyond 2^24 either way is taken as that bound; a row that repeats another is a row of its own, as
anchor and as result, but rows of the anchor's own id are not "other" rows; ties go by
id; an anchor without positives, or a positive of a negative score (whose window is
empty) has no rows; other columns are ignored, whatever their names; an empty table
gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

#: An anchor's id is divisible by this.
ANCHORS = 100
POSITIVES, NEGATIVES = 5, 10
#: Rows of a block, about; of a leaf in a block's own tree.
BLOCK, LEAF = 4096, 32
#: Leaves of the top tree at most (a power of two), and rows for each that it is fitted on.
TOP_LEAVES, LEAF_SAMPLE = 2048, 8
#: Largest component either way.
MOST = 1 << 24
#: What a bound gives way, as a share of the largest distance.
SLACK = 1e-6
#: Queries answered at a time.
BATCH = 128

WINDOWS = "array<struct<low:bigint,high:bigint,least:bigint>>"


def vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, v, norm) of the rows that take part: labels as the task changes them, integer components, squared norm."""
    x = F.col("embedding")
    fine = ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, F.expr("(label + 1) % 10")).otherwise(F.col("label")).cast("long")
    whole = F.transform(x, lambda e: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(e.cast("double") * 256))).cast("int"))
    out = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & fine)
    out = out.select(F.col("vec_id").cast("long"), label.alias("label"), whole.alias("v"))
    return out.withColumn("norm", F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows of int64, with zeros after short ones."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(-1, dims).astype(np.int64)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def augmented(v: np.ndarray, norm: float) -> np.ndarray:
    """Rows of one squared norm ``norm``: the last component makes up for what is lacking."""
    v = v.astype(np.float64)
    return np.c_[v, np.sqrt(np.maximum(0.0, norm - np.einsum("ij,ij->i", v, v)))]


def _apart(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Distances of all points from all others."""
    square = np.einsum("ij,ij->i", points, points)[:, None] + np.einsum("ij,ij->i", others, others) - 2 * points @ others.T
    return np.sqrt(np.maximum(0.0, square))


class Tree:
    """A complete binary vantage-point tree of ``depth`` levels; node i has the children 2i+1 and 2i+2.

    ``low`` and ``high`` hold, for each leaf and level, the least and largest distance
    of the leaf's rows from the vantage point above it on that level.
    """

    def __init__(self, points: np.ndarray, depth: int):
        n = (1 << depth) - 1
        self.depth, self.leaves = depth, 1 << depth
        self.points, self.radius = np.zeros((n, points.shape[1])), np.zeros(n)
        parts = [np.arange(len(points))]
        for node in range(n):
            own = parts[node]
            near, far = own, own
            if len(own):
                mine = points[own]
                pick = mine[np.argmax(((mine - mine.mean(0)) ** 2).sum(1))]
                away = _apart(mine, pick[None])[:, 0]
                order, half = np.argsort(away, kind="stable"), (len(own) + 1) // 2
                self.points[node], self.radius[node] = pick, away[order[half - 1]]
                near, far = own[order[:half]], own[order[half:]]
            parts += [near, far]
        self.parts = parts[n:]
        at = np.arange(self.leaves)
        self.above = np.stack([(1 << k) - 1 + (at >> (depth - k)) for k in range(depth)], 1) if depth else np.zeros((1, 0), int)
        self.low, self.high = np.full((self.leaves, depth), np.inf), np.full((self.leaves, depth), -np.inf)

    def measured(self, points: np.ndarray) -> Tree:
        """With ``low`` and ``high`` of the points it was built on."""
        for leaf, own in enumerate(self.parts):
            if len(own) and self.depth:
                away = _apart(points[own], self.points[self.above[leaf]])
                self.low[leaf], self.high[leaf] = away.min(0), away.max(0)
        return self

    def route(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaf, distances from the vantage points above it) of each point."""
        node, away, rows = np.zeros(len(points), int), np.zeros((len(points), self.depth)), np.arange(len(points))
        every = _apart(points, self.points)
        for k in range(self.depth):
            away[:, k] = every[rows, node]
            node = 2 * node + 1 + (away[:, k] > self.radius[node])
        return node - (self.leaves - 1), away

    def bounds(self, away: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest distance at which each leaf's rows can lie, from distances to all vantage points."""
        least, most = np.zeros((len(away), self.leaves)), np.full((len(away), self.leaves), np.inf)
        for k in range(self.depth):
            d = away[:, self.above[:, k]]
            least = np.maximum(least, np.maximum(d - self.high[:, k], self.low[:, k] - d))
            most = np.minimum(most, d + self.high[:, k])
        return least, most


class Queries:
    """A batch of queries, and a pair for each of their windows: an annulus each."""

    def __init__(self, batch: pa.RecordBatch, dims: int, norm: float):
        get = lambda name: batch.column(batch.schema.get_field_index(name))
        self.v = _matrix(get("v"), dims)
        self.id, self.own, self.label = (get(n).to_numpy(zero_copy_only=False) for n in ("id", "own", "label"))
        windows = get("windows").to_pylist()
        self.of = np.repeat(np.arange(len(windows)), [len(w) for w in windows])
        self.place = np.concatenate([np.arange(len(w)) for w in windows]) if windows else np.empty(0, int)
        flat = [w for ws in windows for w in ws]
        self.low, self.high, self.least = (np.array([w[n] for w in flat], np.int64) for n in ("low", "high", "least"))
        real = self.v.astype(np.float64)
        own = np.sqrt(np.einsum("ij,ij->i", real, real))
        self.scale = np.where(own > 0, math.sqrt(norm) / np.maximum(own, 1), 0.0)  # whole numbers: a norm of 1 at least
        self.reach = norm + norm * (own > 0)  # squared distance of score 0
        self.flat = np.c_[real * self.scale[:, None], np.zeros(len(real))]
        self.slack = SLACK * np.sqrt(self.reach) + 1e-9
        self.inner, self.outer = self.distance(self.high), self.distance(np.maximum(self.low, self.least))

    def distance(self, scores: np.ndarray) -> np.ndarray:
        """Distance at which each pair's row of that score lies."""
        return np.sqrt(np.maximum(0.0, self.reach[self.of] - 2.0 * scores * self.scale[self.of]))

    def meets(self, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
        """For each pair and leaf: where its rows can begin, no nearer than the annulus; and whether it can hold a wanted one."""
        least, most = (b[self.of] for b in tree.bounds(_apart(self.flat, tree.points)))
        slack = self.slack[self.of][:, None]
        inner, outer = self.inner[:, None], self.outer[:, None]
        return np.maximum(least, inner), (least <= outer + slack) & (most >= inner - slack)


class Block:
    """The rows of one block, in a tree of their own."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, norm: float):
        points = augmented(v, norm)
        self.tree = Tree(points, max(0, math.ceil(math.log2(max(1, len(v)) / LEAF)))).measured(points)
        width = max(1, *(len(p) for p in self.tree.parts))
        at = np.zeros((self.tree.leaves, width), int)
        self.real = np.zeros(at.shape, bool)
        for leaf, own in enumerate(self.tree.parts):
            at[leaf, : len(own)], self.real[leaf, : len(own)] = own, True
        self.ids, self.labels = ids[at], labels[at]
        self.v = (v.astype(np.float64) if norm < 2**53 else v)[at]  # whole numbers either way

    def search(self, q: Queries, same: bool, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of each pair's best ``k`` rows, best first; an id of -1 with the least score stands for none."""
        none = np.iinfo(np.int64).min
        scores, ids = np.full((len(q.of), k), none), np.full((len(q.of), k), -1, np.int64)
        begin, can = q.meets(self.tree)
        order = np.argsort(np.where(can, begin, np.inf), 1, kind="stable")
        bound, v = q.outer.copy(), q.v.astype(self.v.dtype)
        active = np.arange(len(q.of))
        for step in range(self.tree.leaves):
            leaf = order[active, step]
            going = can[active, leaf] & (begin[active, leaf] <= bound[active] + q.slack[q.of[active]])
            active, leaf = active[going], leaf[going]  # leaves come nearest first: a pair that stops has all
            if not len(active):
                break
            of = q.of[active]
            found = np.einsum("pd,pld->pl", v[of], self.v[leaf]).astype(np.int64)
            wanted = self.real[leaf] & (found >= q.low[active, None]) & (found <= q.high[active, None]) & (self.ids[leaf] != q.own[of, None])
            wanted &= (self.labels[leaf] == q.label[of, None]) == same
            s = np.c_[scores[active], np.where(wanted, found, none)]
            i = np.c_[ids[active], np.where(wanted, self.ids[leaf], -1)]
            best = np.lexsort((i, ~s), axis=-1)[:, :k]  # ~s is -s - 1, which cannot overflow
            scores[active], ids[active] = np.take_along_axis(s, best, 1), np.take_along_axis(i, best, 1)
            last = scores[:, -1]
            full = last != none
            bound[full] = np.minimum(bound[full], q.distance(np.where(full, last, 0))[full])
        return scores, ids


class Index:
    """The routed rows and what a search needs to know of them."""

    def __init__(self, embeddings: DataFrame):
        rows = durable(vectors(embeddings).withColumn("row", F.monotonically_increasing_id()))
        n, dims, norm = rows.agg(F.count("*"), F.max(F.size("v")), F.max("norm")).first()
        self.dims, self.norm = max(1, dims or 0), float(norm or 0)
        depth = min(int(math.log2(TOP_LEAVES)), max(0, math.ceil(math.log2(max(1, n) / BLOCK))))
        chosen = rows.orderBy(F.xxhash64("row")).limit(LEAF_SAMPLE << depth).select("v").toArrow().column(0)
        dims, norm = self.dims, self.norm
        self.tree = tree = Tree(augmented(_matrix(chosen, dims), norm), depth)

        def routed(batches):
            for b in batches:
                leaf, away = tree.route(augmented(_matrix(b.column(2), dims), norm))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf, pa.int32()), pa.array(list(away), pa.list_(pa.float64()))], names=[*b.schema.names, "leaf", "away"])

        self.rows = durable(rows.select("vec_id", "label", "v", "row").mapInArrow(routed, "vec_id long, label long, v array<int>, row long, leaf int, away array<double>"))
        ranges = [f(F.get("away", F.lit(k))).alias(f"{f.__name__}{k}") for k in range(depth) for f in (F.min, F.max)]
        counts = np.zeros(tree.leaves, np.int64)
        for r in self.rows.groupBy("leaf").agg(F.count("*").alias("n"), *ranges).collect():  # a row a leaf
            counts[r.leaf] = r.n
            tree.low[r.leaf], tree.high[r.leaf] = [r[f"min{k}"] for k in range(depth)], [r[f"max{k}"] for k in range(depth)]
        #: Blocks of each leaf, and the number of its first one.
        self.blocks = np.maximum(1, -(-counts // BLOCK))
        self.first = np.cumsum(self.blocks) - self.blocks
        self.held = counts > 0

    def dealt(self) -> DataFrame:
        """Every row with its block."""
        of = self.rows.sparkSession.createDataFrame([(i, int(f), int(b)) for i, (f, b) in enumerate(zip(self.first, self.blocks, strict=True))], "leaf int, first long, blocks long")
        block = F.col("first") + F.pmod(F.xxhash64("row"), F.col("blocks"))
        return self.rows.join(F.broadcast(of), "leaf").select(block.alias("block"), F.lit(0).alias("kind"), F.col("vec_id").alias("id"), F.lit(None).cast("long").alias("own"), "label", "v", F.lit(None).cast(WINDOWS).alias("windows"))

    def routes(self, queries: DataFrame, nearest: bool) -> DataFrame:
        """Each query (id, own, label, v, windows) once for every block to search; only the nearest one of each window, or all that can hold a row."""
        tree, dims, norm, first, blocks, held = self.tree, self.dims, self.norm, self.first, self.blocks, self.held

        def run(batches):
            for whole in batches:
                for at in range(0, whole.num_rows, BATCH):
                    batch = whole.slice(at, BATCH)
                    q = Queries(batch, dims, norm)
                    begin, can = q.meets(tree)
                    can &= held
                    if nearest:
                        leaf = np.where(can, begin, np.inf).argmin(1)
                        pairs = np.stack([q.of, first[leaf] + q.id[q.of] % blocks[leaf]], 1)[can[np.arange(len(leaf)), leaf]]
                    else:
                        pair, leaf = np.nonzero(can)
                        n = blocks[leaf]
                        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                        pairs = np.stack([np.repeat(q.of[pair], n), np.repeat(first[leaf], n) + within], 1)
                    pairs = np.unique(pairs, axis=0)
                    for part in range(0, len(pairs), 4096):
                        own = pairs[part : part + 4096]
                        sent = batch.take(pa.array(own[:, 0]))
                        yield pa.RecordBatch.from_arrays([pa.array(own[:, 1], pa.int64()), pa.array(np.ones(len(own)), pa.int32()), *sent.columns], names=["block", "kind", *sent.schema.names])

        return queries.select("id", "own", "label", "v", "windows").mapInArrow(run, f"block long, kind int, id long, own long, label long, v array<int>, windows {WINDOWS}")

    def wave(self, queries: DataFrame, same: bool, k: int, nearest: bool) -> DataFrame:
        """(id, place, vec_id, score): the best ``k`` rows of each window in each block searched."""
        dims, norm = self.dims, self.norm

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held, block = None, [], None
            for batch in batches:
                marks = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1)
                cuts = np.r_[0, np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1, len(marks)]
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    if a == b:
                        continue
                    if at != marks[a, 0]:
                        at, held, block = marks[a, 0], [], None
                    part = batch.slice(a, b - a)
                    if marks[a, 1] == 0:
                        held.append((part.column(2).to_numpy(), part.column(4).to_numpy(), _matrix(part.column(5), dims)))
                    elif held or block is not None:
                        if block is None:
                            block, held = Block(*(np.concatenate(x) for x in zip(*held, strict=True)), norm), []
                        for c in range(0, part.num_rows, BATCH):
                            q = Queries(part.slice(c, BATCH), dims, norm)
                            scores, ids = block.search(q, same, k)
                            pair, col = np.nonzero(scores != np.iinfo(np.int64).min)
                            yield pa.RecordBatch.from_arrays([pa.array(q.id[q.of[pair]]), pa.array(q.place[pair], pa.int32()), pa.array(ids[pair, col]), pa.array(scores[pair, col])], names=["id", "place", "vec_id", "score"])

        together = self.dealt().unionByName(self.routes(queries, nearest)).repartition("block").sortWithinPartitions("block", "kind")
        return together.mapInArrow(run, "id long, place int, vec_id long, score long")

    def search(self, queries: DataFrame, same: bool, k: int) -> DataFrame:
        """(id, place, rank, vec_id, score): the best ``k`` rows of every query's windows, whose label is the query's (``same``) or another."""
        first = self.wave(queries, same, k, nearest=True).groupBy("id", "place").agg(F.sort_array(F.collect_list("score"), asc=False).alias("best"))  # at most k of one block
        sure = first.where(F.size("best") >= k).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("place", F.get("best", F.lit(k - 1))))).alias("sure"))
        better = F.transform("windows", lambda w, i: F.struct(w["low"].alias("low"), w["high"].alias("high"), F.greatest(w["least"], F.try_element_at("sure", i)).alias("least")))
        asked = durable(queries.join(sure, "id", "left").withColumn("windows", better).drop("sure"))
        by = Window.partitionBy("id", "place").orderBy(F.desc("score"), "vec_id")
        return self.wave(asked, same, k, nearest=False).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def hard_negatives(embeddings: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score: of each anchor and each of its first
    ``positives`` rows of the same label, the first ``negatives`` rows of other labels that score 0.3 to 0.9 of the positive."""
    index = Index(embeddings)
    least = F.lit(-(1 << 62))
    every = F.array(F.struct(least.alias("low"), F.lit(1 << 62).alias("high"), least.alias("least")))
    anchors = durable(index.rows.where(F.col("vec_id") % ANCHORS == 0).select(F.col("row").alias("id"), F.col("vec_id").alias("own"), "label", "v"))
    close = durable(index.search(anchors.withColumn("windows", every), True, positives))
    close = close.where("score >= 0").withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("rank")) - 1)
    low, high = F.expr("(3 * score + 9) div 10"), F.expr("9 * score div 10")
    own = F.struct("place", F.struct(low.alias("low"), high.alias("high"), low.alias("least")).alias("w"))
    windows = close.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(own)), lambda x: x["w"]).alias("windows"))
    found = index.search(durable(anchors.join(windows, "id")), False, negatives)
    named = close.select("id", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).join(anchors.select("id", F.col("own").alias("anchor_id")), "id")
    return found.join(named, ["id", "place"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def hard_negatives_sql() -> str:
    """The same for DuckDB, by comparing every anchor with every row."""
    return """
WITH rows AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT a.r, a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
),
positives AS (
  SELECT r, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS place
  FROM scored WHERE same QUALIFY place <= 5
),
negatives AS (
  SELECT p.*, n.vec_id AS negative_id, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.r, p.place ORDER BY n.score DESC, n.vec_id) AS rank
  FROM positives p JOIN scored n ON p.r = n.r
  WHERE NOT n.same AND 30 * positive_score <= 100 * n.score AND 100 * n.score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 10
"""
