"""All pairs of texts that are 0.8 alike or more in their word shingles, without exception.

Sorted by how many documents hold them, rarest first, the first ``n - ceil(0.8 n) + 1``
of a text's n shingles hold one that any text at least 0.8 alike has among its own
first ones (prefix filter). Most shingles occur once, so only texts of which four
fifths occur elsewhere too have candidates at all, and what many texts share comes
last. Candidates form groups; each group is compared whole by counting common
shingles, and only pairs of ``9 |A and B| >= 4 (|A| + |B|)``, a Jaccard index of 0.8,
are links.

Shingles are 64-bit hashes (XXH64, seed 42). Counts are taken of their upper 42 bits: any
fixed order of shingles is right, so a chance collision there costs time only.

Every Python step reads its rows sorted and holds one group of them at a time. A batch of
texts and a tile of a group are of bounded size; a part of the shingles is not where one
shingle is very common: it takes some 90 bytes for each distinct text that holds it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator


import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, release

#: Bytes of text, about, whose shingles are counted together; and the fewest parts, as a power of two.
PART_BYTES, LEAST_PARTS = 4 << 20, 10
#: Texts, and bytes of text, of one group that a task compares by itself; larger groups are
#: cut into tiles of about half as much, and pairs of tiles are spread over tasks.
GROUP_ROWS, GROUP_BYTES = 1 << 12, 16 << 20
#: Shingles that a counting task gathers before it hands them on by batch of documents.
FLUSH = 1 << 20


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()  # bytes: A-Z only, and ASCII white space


def node_of(words: list[bytes]) -> int:
    """The name of all texts of the same words."""
    return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(words), 42)).view(np.int64))


def shingles(words: list[bytes], width: int) -> np.ndarray:
    """The distinct hashes of the ``width``-word shingles; of fewer words, one of them all."""
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    first, last = (ends - sizes)[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(first, last, strict=True)), np.uint64, len(first)))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def node(text: Column | str) -> Column:
    """``node_of`` as a column, in Spark's own functions; its hash is XXH64 with seed 42 too."""
    words = F.regexp_replace(F.translate(text, _UPPER, _UPPER.lower()), r"[\x20\x09-\x0D]+", " ")
    return F.xxhash64(F.trim(words))


def named(docs: DataFrame) -> DataFrame:
    """(doc_id, node, size) of every row of (doc_id, text); the size in bytes."""
    return docs.select(F.col("doc_id").cast("long"), node("text").alias("node"), F.octet_length("text").alias("size"))


def _runs(batches, name: str) -> Iterator[pa.Table]:
    """The rows of each value of a column that the batches are sorted by."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = batch.column(name).to_numpy()
        cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]).tolist() if len(keys) else []
        for i, j in zip(cuts, [*cuts[1:], len(keys)], strict=False):
            if held and keys[i] != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            last = keys[i]
            held.append(batch.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _numbers(table: pa.Table, name: str, kind) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in all rows of a binary column, and how many each row has."""
    found = [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]
    return np.concatenate([np.empty(0, kind), *found]), np.array([len(x) for x in found], np.int64)


# Rows of a batch of documents ``b``: shingles of part ``p`` (their upper bits, of which the
# last ten stand above the 32 bits in ``y``) and the rows they are of, or (``head``) nodes and sizes.
_DEALT = "p int, b long, head boolean, x binary, y binary, z binary"
_NAMES = ["p", "b", "head", "x", "y", "z"]


def _deal(width: int, bits: int):
    """Shingles of every text that a task has not met before, in 2 ** ``bits`` parts."""

    def run(batches):
        release()
        part, seen = TaskContext.get().partitionId(), set()
        for n, batch in enumerate(batches):
            every = []
            for t in batch.column(1).cast(pa.binary()).to_pylist():
                if (name := node_of(words := words_of(t))) not in seen:
                    seen.add(name)
                    every.append(words)
            sets = [shingles(w, width) for w in every]
            sizes = np.array([len(s) for s in sets], np.uint32)
            tokens = np.concatenate([np.empty(0, np.uint64), *sets]) >> np.uint64(22)
            rows = np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
            order = np.argsort(tokens, kind="stable")
            tokens, rows = tokens[order], rows[order]
            parts = (tokens >> np.uint64(42 - bits)).astype(np.int32)
            at = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1]]) if len(parts) else np.empty(0, np.int64)
            upto, b = np.r_[at[1:], len(parts)], part << 32 | n
            keys = tokens.astype(np.uint32)  # the last 32 bits
            x = [np.array([node_of(w) for w in every], np.int64).tobytes(), *(rows[i:j].tobytes() for i, j in zip(at, upto))]
            y = [sizes.tobytes(), *(keys[i:j].tobytes() for i, j in zip(at, upto))]
            p = np.r_[b % (1 << bits), parts[at]].astype(np.int32)
            columns = [pa.array(p), pa.array(np.full(len(p), b, np.int64)), pa.array([True] + [False] * len(at)), pa.array(x, pa.binary()), pa.array(y, pa.binary()), pa.nulls(len(p), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=_NAMES)

    return run


def _counter(bits: int):
    """Part by part: the shingles that occur more than once, with their counts, by batch of documents."""

    def again(table: pa.Table) -> tuple[np.ndarray, ...]:
        """(token, count, batch, row) of the shingles of one part that occur more than once."""
        rows, sizes = _numbers(table, "x", np.uint16)
        keys, _ = _numbers(table, "y", np.uint32)
        upper = np.repeat(table.column("p").to_numpy().astype(np.uint64) >> np.uint64(bits - 10), sizes)
        tokens = upper << np.uint64(32) | keys
        order = np.argsort(tokens)
        at = np.flatnonzero(np.diff(tokens[order], prepend=tokens[order[:1]] + np.uint64(1)))
        counts = np.diff(np.r_[at, len(order)])
        kept = order[np.repeat(counts > 1, counts)]  # most occur once
        df = np.repeat(np.minimum(counts, 65535).astype(np.uint16)[counts > 1], counts[counts > 1])
        return tokens[kept], df, np.repeat(table.column("b").to_numpy(), sizes)[kept], rows[kept]

    def by_batch(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        tokens, df, b, rows = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(b, kind="stable")
        tokens, df, b, rows = tokens[order], df[order], b[order], rows[order]
        at = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.empty(0, np.int64)
        cut = list(zip(at.tolist(), [*at[1:].tolist(), len(b)], strict=False))
        own = [pa.array([v[i:j].tobytes() for i, j in cut], pa.binary()) for v in (rows, tokens, df)]
        return pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int32()), pa.array(b[at]), pa.array([False] * len(at), pa.bool_()), *own], names=_NAMES)

    def run(batches):
        held, size = [], 0
        for table in _runs(batches, "p"):
            is_head = table.column("head").to_numpy()
            yield from table.filter(pa.array(is_head)).to_batches()
            held.append(again(table.filter(pa.array(~is_head))))
            size += len(held[-1][0])
            if size >= FLUSH:
                yield by_batch(held)
                held, size = [], 0
        if size:
            yield by_batch(held)

    return run


def _prefixes(batches):
    """Batch by batch of documents: (node, token) of the first shingles that occur more than once."""
    for table in _runs(batches, "b"):
        is_head = table.column("head").to_numpy()
        nodes, _ = _numbers(table.filter(pa.array(is_head)), "x", np.int64)
        n, _ = _numbers(table.filter(pa.array(is_head)), "y", np.uint32)
        table = table.filter(pa.array(~is_head))
        doc, _ = _numbers(table, "x", np.uint16)
        tokens, _ = _numbers(table, "y", np.uint64)
        df, _ = _numbers(table, "z", np.uint16)
        if not len(doc):
            continue
        order = np.lexsort((tokens, df, doc))
        doc, tokens = doc[order], tokens[order]
        at = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        held = np.diff(np.r_[at, len(doc)])
        take = held - (4 * n[doc[at]].astype(np.int64) + 4) // 5 + 1  # those that occur once come before
        chosen = np.arange(len(doc)) - np.repeat(at, held) < np.repeat(take, held)
        yield pa.RecordBatch.from_arrays([pa.array(nodes[doc[chosen]]), pa.array(tokens[chosen].view(np.int64))], names=["node", "token"])


def candidates(docs: DataFrame, size: int, width: int = 5) -> DataFrame:
    """(a, b): links between nodes such that every pair at least 0.8 alike is connected.

    ``size``: bytes of all texts, about, from which the number of parts follows.
    """
    bits = min(24, max(LEAST_PARTS, math.ceil(math.log2(max(1, size) / PART_BYTES))))
    dealt = docs.mapInArrow(_deal(width, bits), _DEALT).repartition("p").sortWithinPartitions("p").mapInArrow(_counter(bits), _DEALT)
    firsts = durable(dealt.repartition("b").sortWithinPartitions("b").mapInArrow(_prefixes, "node long, token long"))
    least = firsts.groupBy("token").agg(F.min("node").alias("b"), F.max("node").alias("most")).where("b <> most").select("token", "b")
    return firsts.join(least, "token").where("node <> b").select(F.col("node").alias("a"), "b")


def links(nodes: np.ndarray, sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Links that connect the texts of a group that are at least 0.8 alike, by their sets of shingles.

    A text is counted against all others at once. First texts that no link reaches yet,
    then all outside the largest component, so a group of near copies costs few counts.
    """
    count, sizes = len(nodes), np.array([len(s) for s in sets])
    if count == 2:
        near = 9 * len(np.intersect1d(*sets, assume_unique=True)) >= 4 * sizes.sum()
        return ([int(nodes[0])], [int(nodes[1])]) if near else ([], [])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    holder = np.repeat(np.arange(count), sizes)[np.argsort(ids, kind="stable")]
    held = np.bincount(ids)
    start, off = np.cumsum(held) - held, np.r_[0, np.cumsum(sizes)]
    label, a, b = np.arange(count), [], []

    def link(i: int) -> np.ndarray:
        own = ids[off[i] : off[i + 1]]
        many = held[own]
        at = np.arange(many.sum()) + np.repeat(start[own] - (np.cumsum(many) - many), many)
        near = np.flatnonzero(9 * np.bincount(holder[at], minlength=count) >= 4 * (sizes + sizes[i]))
        roots, first = np.unique(label[near], return_index=True)
        for root, j in zip(roots, near[first]):
            if root != label[i]:
                a.append(int(nodes[i]))
                b.append(int(nodes[j]))
        label[np.isin(label, roots)] = roots.min()
        return near

    seen, done = np.zeros(count, bool), np.zeros(count, bool)
    for i in range(count):
        if not seen[i]:
            seen[link(i)] = done[i] = True
    for i in np.flatnonzero((label != np.bincount(label).argmax()) & ~done):
        link(i)
    return a, b


def _compare(batches):
    """Group by group ``g``: links (a, b)."""
    for table in _runs(batches, "g"):
        nodes, first = np.unique(table.column("node").to_numpy(), return_index=True)  # repeats of a text are left out
        if len(nodes) > 1:
            a, b = links(nodes, [np.frombuffer(x, np.uint64) for x in table.column("sets").take(pa.array(first)).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _sets(width: int):
    def run(batches):
        seen = set()  # a task sends each text once to each group
        for b in batches:
            g, nodes, sets = [], [], []
            for groups, node, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
                if node not in seen:
                    seen.add(node)
                    own = shingles(words_of(text), width).tobytes()
                    g += groups
                    nodes += [node] * len(groups)
                    sets += [own] * len(groups)
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["g", "node", "sets"])

    return run


def verified(docs: DataFrame, roots: DataFrame, sizes: DataFrame, among, width: int = 5, most: int = GROUP_ROWS) -> DataFrame:
    """(a, b): links that connect all nodes at least 0.8 alike, and no others, within the groups ``roots``.

    ``roots``: (node, root) of all nodes but the roots; ``sizes``: (node, size) of all.
    ``among`` says how a table of nodes is joined to the texts.
    """
    members = durable(roots.union(roots.select(F.col("root").alias("node"), "root").distinct()).join(sizes, "node"))
    share = F.greatest(F.count("*") / F.lit(most), F.sum("size") / F.lit(GROUP_BYTES))
    tiles = durable(members.groupBy("root").agg(F.when(share > 1, F.ceil(share * 2)).otherwise(1).cast("int").alias("n")))
    mine = members.join(tiles, "root").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("n").cast("long")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda o: F.xxhash64("root", F.least(o, "mine"), F.greatest(o, "mine")))
    groups = durable(mine.select("node", pairs.alias("g")))

    # written, so that no task keeps the workers of two Python steps at once
    held = durable(docs.withColumn("node", node("text")).join(among(groups), "node").select("g", "node", "text"))
    dealt = held.mapInArrow(_sets(width), "g long, node long, sets binary").repartition("g").sortWithinPartitions("g")
    return durable(dealt.mapInArrow(_compare, "a long, b long"))
