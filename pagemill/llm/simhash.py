"""SimHash near-duplicate groups by bit-sliced comparison.

Fingerprints are compared inside buckets that agree on some of their bits. With
``radius + spare`` bit fields, two fingerprints at most ``radius`` bits apart agree
on ``spare`` whole fields, so one table per choice of ``spare`` fields misses no link.
A bucket's fingerprints are stored as 64 vertical bit planes (one big integer per
bit, one lane per fingerprint). Shifting the planes by ``d`` lines every lane up
with the lane ``d`` further on; carry-save counters then add the 64 differing-bit
planes for all lanes at once and a block is left as soon as every lane is beyond
the radius. A lane's run is left too once all of its fingerprints are connected, so
a bucket of many near copies costs a spanning tree, not all of its pairs.

Defined results: null or blank text has fingerprint zero and links like any other;
repeated rows give repeated result rows; an empty table gives no rows; null ids
never become a component id unless the whole component has no other.
"""

from __future__ import annotations

from itertools import chain, combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import alike
from .common import durable, gathered, release, texts

#: Fingerprints of one bucket that a task compares by itself; larger buckets are cut
#: into tiles of about half as many, and pairs of tiles are spread over tasks.
BUCKET_ROWS = 1 << 15
#: Lanes of one bit-sliced block.
LANES = 1 << 16


#: Multiplier of the mixer that widens a shingle's hash beyond 64 bits.
GOLDEN = 0x9E3779B97F4A7C15


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, element by element."""
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def fingerprint(text: bytes, width: int = 4, longs: int = 1) -> np.ndarray:
    """SimHash of the ``width``-word shingles of a UTF-8 text, 64 bits (XXH64, seed 42) a long.

    The second long and the next take a mix of the same hash.
    """
    words = text.lower().split()  # bytes: A-Z only, and ASCII white space
    n = len(words)
    if not n:
        return np.zeros(longs, np.uint64)
    joined = b" ".join(words)
    if n <= width:
        hashes = np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    else:
        sizes = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(sizes + 1) - 1
        first, last = (ends - sizes)[: n - width + 1].tolist(), ends[width - 1 :].tolist()
        grams = map(joined.__getitem__, map(slice, first, last))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), np.uint64, n - width + 1)
    out = []
    for i in range(longs):
        h = mixed(hashes + np.uint64(i * GOLDEN & (1 << 64) - 1)) if i else hashes
        ones = np.zeros(64, np.int64)
        for at in range(0, len(h), 1 << 14):
            bits = np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
        out.append(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])
    return np.array(out, np.uint64)


def long_names(longs: int) -> list[str]:
    return [f"f{i}" for i in range(longs)]


def fingerprints(docs: DataFrame, width: int = 4, longs: int = 1) -> DataFrame:
    """(doc_id, f0, ...): one row per document, the fingerprint as signed longs."""

    def run(batches):
        release()
        for b in batches:
            found = [fingerprint(t, width, longs) for t in b.column(1).cast(pa.binary()).to_pylist()]
            fps = np.array(found, np.uint64).reshape(-1, longs).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(fps[:, i]) for i in range(longs))], names=["doc_id", *long_names(longs)])

    return texts(docs).mapInArrow(run, ", ".join(["doc_id long", *(f"{x} long" for x in long_names(longs))]))


def exact_tables(radius: int = 4, spare: int = 2, bits: int = 64) -> list[np.ndarray]:
    """Bit positions of the tables that together miss no pair within ``radius`` bits."""
    chunks = np.array_split(np.arange(bits), radius + spare)
    return [np.concatenate(chosen) for chosen in combinations(chunks, spare)]


def bucket_keys(fps: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """(rows, tables) keys: a fingerprint's bits at each table's positions, and the table."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")
    keys = np.zeros((len(fps), len(tables)), np.int64)
    for i, at in enumerate(tables):
        packed = np.zeros((len(fps), 8), np.uint8)
        packed[:, : (len(at) + 7) // 8] = np.packbits(bits[:, at], axis=1, bitorder="little")
        keys[:, i] = packed.view(np.int64)[:, 0] | i << 48
    return keys


def nodes_of(fps: np.ndarray) -> np.ndarray:
    """A fingerprint's name in the link graph: itself, or a 64-bit mix of a wider one."""
    node = fps[:, 0].copy()
    for i in range(1, fps.shape[1]):
        node = mixed(mixed(node) ^ fps[:, i])  # unlike the mix that made the next long
    return node.view(np.int64)


def planes_of(fps: np.ndarray) -> list[int]:
    """Bit planes of (rows, longs) fingerprints: bit i of plane b is bit b of row i."""
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")
    return [int.from_bytes(row.tobytes(), "little") for row in np.packbits(bits.T, axis=1, bitorder="little")]


def within(planes: list[int], d: int, lanes: int, radius: int) -> int:
    """Lanes of ``lanes`` whose fingerprint is within ``radius`` bits of the one ``d`` lanes on.

    A k-bit vertical counter starts at 2^k - 1 - radius in every lane, so a carry out
    of its top marks a lane beyond the radius. Planes are added three at a time.
    """
    k = (radius + 1).bit_length()
    start = (1 << k) - 1 - radius
    count = [lanes if start >> i & 1 else 0 for i in range(k)]
    for at in range(0, len(planes), 3):
        x, y, z = ((p ^ p >> d) & lanes for p in (*planes[at : at + 3], 0, 0)[:3])
        both = x ^ y
        for carry, level in ((both ^ z, 0), (x & y | both & z, 1)):
            while carry and level < k:
                count[level], carry = count[level] ^ carry, count[level] & carry
                level += 1
            lanes &= ~carry
        if not lanes:
            break
    return lanes


def link_runs(fps: np.ndarray, run: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(member rows, root rows) of the linked groups inside each run of equal ``run``.

    Runs are contiguous. Only a spanning set of links is looked for.
    """
    n = len(fps)
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    sizes = np.diff(np.r_[starts, n])
    of = np.repeat(np.arange(len(starts)), sizes)
    groups, label, planes = sizes.copy(), np.arange(n), planes_of(fps)
    for d in range(1, int(sizes.max(initial=1))):
        wanted = (of[:-d] == of[d:]) & (groups[of[:-d]] > 1)
        if not wanted.any():
            break
        lanes = within(planes, d, int.from_bytes(np.packbits(wanted, bitorder="little").tobytes(), "little"), radius)
        if not lanes:
            continue
        hit = np.flatnonzero(np.unpackbits(np.frombuffer(lanes.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little"))
        for i in hit[label[hit] != label[hit + d]].tolist():
            a, b = i, i + d
            while label[a] != a:
                a = int(label[a])
            while label[b] != b:
                b = int(label[b])
            if a != b:
                label[max(a, b)] = min(a, b)
                groups[of[i]] -= 1
        while not np.array_equal(label, jumped := label[label]):
            label = jumped
    member = np.flatnonzero(label != np.arange(n))
    return member, label[member]


def link_sorted(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(member nodes, root nodes) of all buckets; rows are sorted by key and buckets are whole."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    nodes, found = nodes_of(fps), [(np.empty(0, np.int64),) * 2]
    for power in range(1, int(sizes.max(initial=1)).bit_length() + 1):
        chosen = np.flatnonzero((sizes > 1 << power - 1) & (sizes <= 1 << power))  # buckets of like size share blocks
        while len(chosen):
            upto = max(1, int(np.searchsorted(np.cumsum(sizes[chosen]), LANES, "right")))
            part, size = starts[chosen[:upto]], sizes[chosen[:upto]]
            rows = np.repeat(part - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            member, root = link_runs(fps[rows], np.repeat(np.arange(upto), size), radius)
            found.append((nodes[rows[member]], nodes[rows[root]]))
            chosen = chosen[upto:]
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _compare(radius: int, longs: int, most: int):
    """Over batches of (key, f0, ...) sorted by key: rows with a and b are links, the others are rows of a bucket beyond ``most``."""
    names = ["key", *long_names(longs), "a", "b"]

    def rows(*columns):
        n = len(next(x for x in columns if x is not None))
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()) if x is None else pa.array(x) for x in columns], names=names)

    def run(batches):
        keys, fps, large = np.empty(0, np.int64), np.empty((0, longs), np.uint64), None
        for batch in chain(batches, [None]):
            if batch is not None:
                keys = np.concatenate([keys, batch.column(0).to_numpy()])
                fps = np.concatenate([fps, np.stack([batch.column(1 + i).to_numpy() for i in range(longs)], axis=1).view(np.uint64)])
                if len(keys) < LANES and large is None:
                    continue
            cut = int(np.searchsorted(keys, large, "right")) if large is not None else 0
            if cut:
                yield rows(keys[:cut], *fps[:cut].view(np.int64).T, None, None)
                keys, fps, large = keys[cut:], fps[cut:], large if cut == len(keys) else None
            cut = len(keys) if batch is None or not len(keys) else int(np.searchsorted(keys, keys[-1]))
            if cut:
                a, b = link_sorted(keys[:cut], fps[:cut], radius)
                if len(a):
                    yield rows(None, *[None] * longs, a, b)
                keys, fps = keys[cut:], fps[cut:]
            if len(keys) > most:
                large = int(keys[0])
                yield rows(keys, *fps.view(np.int64).T, None, None)
                keys, fps = keys[:0], fps[:0]

    return run


def _keyed(tables: list[np.ndarray], longs: int):
    def run(batches):
        for b in batches:
            fps = np.stack([b.column(i).to_numpy() for i in range(longs)], axis=1).view(np.uint64)
            keys = bucket_keys(fps, tables)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, len(tables)), pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([lists, *b.columns], names=["keys", *long_names(longs)])

    return run


def links(distinct_fps: DataFrame, radius: int, tables: list[np.ndarray], most: int = BUCKET_ROWS) -> DataFrame:
    """(a, b): links between nodes that connect all fingerprints within ``radius`` bits that share a bucket.

    ``distinct_fps``: distinct (f0, ...). Buckets beyond ``most`` rows are compared as
    pairs of tiles, each pair in a group of its own.
    """
    names = distinct_fps.columns
    each = ", ".join(f"{x} long" for x in names)
    keyed = distinct_fps.mapInArrow(_keyed(tables, len(names)), f"keys array<long>, {each}").select(F.explode("keys").alias("key"), *names)
    schema = f"key long, {each}, a long, b long"
    first = durable(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_compare(radius, len(names), most), schema))
    found = first.where("a is not null").select("a", "b")
    large = first.where("a is null").select("key", *names)
    tiles = large.groupBy("key").agg(F.ceil(F.count("*") * 2 / F.lit(most)).cast("int").alias("n"))
    if tiles.isEmpty():
        return found
    mine = F.pmod(F.xxhash64(*names), F.col("n").cast("long")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda o: F.xxhash64("key", F.least(o, "mine"), F.greatest(o, "mine")))
    paired = large.join(tiles, "key").withColumn("mine", mine).select(F.explode(pairs).alias("key"), *names)
    # a pair of tiles holds about `most` rows, so nothing is cut again
    again = durable(paired.repartition("key").sortWithinPartitions("key").mapInArrow(_compare(radius, len(names), 1 << 62), schema))
    return found.union(again.select("a", "b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): connected components by alternating large and small stars.

    Every round is written to the shared folder. Nodes without edges have no row.
    """
    edges = durable(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"))
    stars = durable(gathered(edges.distinct(), edges.count()))
    seen = None
    while True:
        state = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
        # large star: hang every larger neighbour on the least node around
        least = durable(gathered(stars.select(F.col("u").alias("v"), F.col("v").alias("m")).groupBy("v").agg(F.min("m").alias("m")), state[0]))
        large = stars.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v"))
        # small star: hang all smaller neighbours of a node on the least of them
        large = durable(gathered(large.distinct(), state[0]))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = durable(gathered(small.union(low.select("u", F.col("m").alias("v"))).distinct(), 2 * state[0]))


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``.

    64-bit fingerprints at most ``radius`` bits apart are linked, without exception;
    ``component_id`` is the least document id of all that are reachable.
    """
    marked = durable(fingerprints(docs, width))
    counted = durable(gathered(marked.groupBy("f0").agg(F.min("doc_id").alias("least")), marked.count()))
    rows = counted.count()
    roots = components(links(counted.select("f0"), radius, exact_tables(radius)))
    grouped = durable(gathered(counted.join(roots, F.col("f0") == F.col("node"), "left").select("f0", "least", F.coalesce("root", "f0").alias("root")), rows))
    least = durable(gathered(grouped.groupBy("root").agg(F.min("least").alias("component_id")), rows))
    # both sides of the joins are plain scans: AQE splits the partition of a group, or a fingerprint, that most rows share
    of = durable(gathered(grouped.join(least, "root").select("f0", "component_id"), rows))
    found = marked.join(of, "f0", "left")
    return found.select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


def _fingerprint_links(docs: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b): links between names of texts that connect those of all groups of ``near_duplicates``."""
    named = docs.select(alike.node("text").alias("doc_id"), "text")
    marked = durable(fingerprints(named))  # texts of the same words have one name and one fingerprint
    of = durable(gathered(marked.distinct(), marked.count()))
    rows = of.count()
    roots = components(links(of.select("f0").distinct(), radius, exact_tables(radius)))
    found = of.join(roots, F.col("f0") == F.col("node"), "left").select(F.col("doc_id").alias("a"), F.coalesce("root", "f0").alias("root"))
    grouped = durable(gathered(found, rows))
    least = durable(gathered(grouped.groupBy("root").agg(F.min("a").alias("b"), F.max("a").alias("most")).where("b <> most"), rows))
    return durable(gathered(grouped.join(least.select("root", "b"), "root").where("a <> b").select("a", "b"), rows))


def _similar(docs: DataFrame, width: int = 5) -> DataFrame:
    """(doc_id, node, root): the words' name and the group of every row."""
    marked = durable(alike.named(texts(docs)))
    sizes = durable(marked.groupBy("node").agg(F.max("size").alias("size")))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    near = _fingerprint_links(texts(docs))
    roots = components(near.unionByName(alike.candidates(texts(docs), total, width)))
    roots = components(alike.verified(texts(docs), roots, sizes, _among, width))
    of = durable(sizes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root")))
    # both sides are plain scans: AQE splits the partition of a text that most rows share
    return marked.join(of, "node", "left").select("doc_id", "node", "root")


def similar_groups(docs: DataFrame, width: int = 5) -> DataFrame:
    """(doc_id, component_id): groups of texts 0.8 alike or more in ``width``-word shingles.

    Candidates are the groups of near fingerprints. A fingerprint's distance only
    estimates likeness, so a prefix filter adds what they miss and every link is
    verified by exact Jaccard index; texts of the same words are one. ``component_id``
    is the least document id of all that are reachable.
    """
    found = durable(_similar(docs, width))
    least = durable(found.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    return found.join(least, "root").select("doc_id", "component_id")


#: Ids that are sent to every task at most (32 MB as longs); more are joined by a shuffle.
SENT_IDS = 1 << 22


def _among(ids: DataFrame) -> DataFrame:
    """``ids`` as the side of a join: broadcast if they are counted to be few enough, else merged."""
    return F.broadcast(ids) if ids.count() <= SENT_IDS else ids.hint("merge")


def _mark(doc_id, node):
    """One long for a document id, or none, and a text's name."""
    return F.xxhash64(doc_id.isNull(), doc_id, node)


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` without all but one of each group of near copies.

    The row with the least id stays (without any id, one without); of rows that repeat
    that id, one. Rows are told apart by id and words, so ids need not be unique or
    given. Texts are not shuffled unless more than SENT_IDS rows go.
    """
    groups = durable(_similar(docs, **settings))
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "node")).alias("k"))
    stays = durable(first.select(_mark(F.col("k.doc_id"), F.col("k.node")).alias("mark")))
    marks = durable(groups.groupBy(_mark(F.col("doc_id"), F.col("node")).alias("mark")).count())
    drop = durable(marks.join(stays, "mark", "left_anti").select("mark"))
    repeated = durable(marks.where("count > 1").join(stays, "mark", "left_semi").select("mark"))
    # a row travels as one column, so that its own names meet no others
    own = docs.select(F.struct("*").alias("row"), _mark(F.col("doc_id"), alike.node(F.coalesce("text", F.lit("")))).alias("mark"))
    kept = own.join(_among(drop), "mark", "left_anti")
    if repeated.isEmpty():
        return kept.select("row.*")
    side = _among(repeated)
    once = kept.join(side, "mark", "left_anti").select("row")
    # combined before the shuffle, so a text that many rows repeat is no large partition
    chosen = kept.join(side, "mark", "left_semi").groupBy("mark").agg(F.min_by("row", F.xxhash64("row.text")).alias("row")).select("row")
    return once.unionByName(chosen).select("row.*")
