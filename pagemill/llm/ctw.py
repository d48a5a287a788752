"""Language-model scores by context-tree weighting over binary-decomposed bytes.

A byte is eight binary choices; each has a node for the bits before it in the byte
and for each context of the last 0 to ``DEPTH`` bytes. A node estimates its bit by
Krichevsky and Trofimov's rule; weighting mixes, at every depth, the node's own
estimate with those of the contexts one byte longer, by the block probabilities both
gave the training text. (Where a longer context never occurred in training, the
mixture ends at the last one that did.) A text's score is the log10 probability of
its UTF-8 bytes and an end mark, 0xFF, which no text contains.

The model of a text depends on its (DEPTH + 1)-byte grams alone, so everything is
counts: grams are counted in each task and summed by shuffle; the trees below each
two-byte context are worked out in the partition that holds it; the two levels above
are at most 65,280 nodes, which the driver finishes. Scoring looks up the commonest
words and grams in tables of bounded size and joins the counts of all others.

Defined results: a null text is empty, scored as its end; repeated rows count and
are scored as often as they occur; null ids are training rows (their remainder is
null); an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

DEPTH = 4
#: Bounds of the tables that are sent to every worker; what they leave out is joined.
HEAD_WORDS, HEAD_GRAMS = 300_000, 600_000
#: Distinct entries a task counts up before it hands them on.
FLUSH = 300_000
_END = b"\xff"


def is_held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def grams_of(texts: list[bytes]) -> np.ndarray:
    """All (DEPTH + 1)-byte grams of texts, each with its end, after DEPTH end marks."""
    b = np.frombuffer((_END * DEPTH).join([b"", *texts, b""]), np.uint8).astype(np.uint64)
    g = np.zeros(max(0, len(b) - DEPTH), np.uint64)
    for i in range(DEPTH + 1):
        g = g << np.uint64(8) | b[i : len(b) - DEPTH + i]
    # between two texts, DEPTH marks are the next one's start; only the first is an end
    ends = np.cumsum([len(t) + DEPTH for t in texts]) - DEPTH if texts else np.zeros(0, np.int64)
    keep = np.ones(len(g), bool)
    for k in range(1, DEPTH):
        at = ends + k
        keep[at[at < len(g)]] = False
    return g[keep]


def _counts(batches):
    words: Counter = Counter()
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def summed():
        if not held:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        keys, inverse = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return keys, np.bincount(inverse, np.concatenate([c for _, c in held]), len(keys)).astype(np.int64)

    def flush():
        keys, n = summed()
        held.clear()
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(keys), pa.binary()), pa.array(keys.view(np.int64)), pa.array(n)], names=["word", "gram", "n"])
        if words:
            yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.nulls(len(words), pa.int64()), pa.array(list(words.values()), pa.int64())], names=["word", "gram", "n"])
            words.clear()

    for b in batches:
        texts, out = b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist()
        train = [t for t, x in zip(texts, out, strict=True) if not x]
        words.update(chain.from_iterable(t.lower().split() for t in train))
        words[b""] += len(train)  # the end is a token
        for part, weight in ((train, 1), ([t for t, x in zip(texts, out, strict=True) if x], 0)):
            keys, n = np.unique(grams_of(part), return_counts=True)
            held.append((keys, n * weight))
        if sum(len(k) for k, _ in held) > 4 * FLUSH:
            held[:] = [summed()]
        if len(words) > FLUSH or held and len(held[0][0]) > FLUSH:
            yield from flush()
    yield from flush()


# --- the tree ---------------------------------------------------------------------
def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Of x > 0: Stirling's series at x + 8."""
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) - shift


def kt_block(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log probability of a block of n0 zeros and n1 ones."""
    return _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - 2 * math.lgamma(0.5) - _log_gamma(n0 + n1 + 1.0)


_HALF = math.log(0.5)


class _Level:
    """Nodes of one depth: counts, block and weighted log probabilities."""

    def __init__(self, keys, inverse, bit, n, child: _Level | None, mask: int):
        self.keys, self.of = keys, inverse
        self.n0 = np.bincount(inverse, n * (1 - bit), len(keys))
        self.n1 = np.bincount(inverse, n * bit, len(keys))
        own = kt_block(self.n0, self.n1)
        self.own, self.weighted = own, own
        if child is not None:
            below = np.bincount(np.searchsorted(keys, child.keys & mask), child.weighted, len(keys))
            self.weighted = np.logaddexp(_HALF + own, _HALF + below)

    def estimate(self, bit):
        n = np.where(bit, self.n1[self.of], self.n0[self.of])
        return (n + 0.5) / (self.n0[self.of] + self.n1[self.of] + 1)

    def seen(self):
        return (self.n0 + self.n1)[self.of] > 0

    def stay(self):
        """The posterior weight of the node's own estimate."""
        return np.exp(_HALF + self.own - self.weighted)[self.of]


def subtrees(grams: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """For whole two-byte contexts: each gram's eight bit probabilities from depth 2 on
    (negative: the context never occurred), and the depth-2 nodes as (key of the depth-1
    node, weighted log probability, zeros, ones)."""
    g, n = grams.astype(np.int64), n.astype(float)
    s, contexts = g & 255, g >> 8
    out = np.empty((len(g), 8))
    nodes = []
    for k in range(8):
        bit, prefix = s >> (7 - k) & 1, 1 << k | s >> (8 - k)
        levels: list[_Level] = []
        for d in range(DEPTH, 1, -1):
            keys, inverse = np.unique((contexts & (1 << 8 * d) - 1) << 8 | prefix, return_inverse=True)
            levels.append(_Level(keys, inverse, bit, n, levels[-1] if levels else None, (1 << 8 * d + 8) - 1))
        p = np.full(len(g), -1.0)
        for level in levels:
            own = level.estimate(bit)
            stay = level.stay()
            p = np.where(level.seen(), np.where(p < 0, own, stay * own + (1 - stay) * p), -1.0)
        out[:, k] = p
        top = levels[-1]
        used = top.n0 + top.n1 > 0
        nodes.append((top.keys[used] & 0xFFFF, top.weighted[used], top.n0[used], top.n1[used]))
    return out, tuple(np.concatenate(x) for x in zip(*nodes, strict=True))


def upper_levels(keys: np.ndarray, below: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """From the depth-1 nodes (key: byte and prefix): tables[bit] of (from root and depth 1, weight of depth 2, without depth 2)."""
    one = [np.zeros((256, 256)) for _ in range(3)]
    for table, x in zip(one, (below, n0, n1), strict=True):
        np.add.at(table, (keys >> 8, keys & 255), x)
    below1, z1, o1 = one
    own1 = kt_block(z1, o1)
    weighted1 = np.logaddexp(_HALF + own1, _HALF + below1)
    z0, o0 = z1.sum(0), o1.sum(0)
    own0 = kt_block(z0, o0)
    stay1 = np.exp(_HALF + own1 - weighted1)
    stay0 = np.exp(_HALF + own0 - np.logaddexp(_HALF + own0, _HALF + weighted1.sum(0)))
    tables = np.empty((2, 3, 256, 256))
    for bit in (0, 1):
        kt1 = ((o1 if bit else z1) + 0.5) / (z1 + o1 + 1)
        kt0 = ((o0 if bit else z0) + 0.5) / (z0 + o0 + 1)
        seen = z1 + o1 > 0
        tables[bit, 0] = np.where(seen, stay0 * kt0 + (1 - stay0) * stay1 * kt1, kt0)
        tables[bit, 1] = np.where(seen, (1 - stay0) * (1 - stay1), 0)
        tables[bit, 2] = np.where(seen, stay0 * kt0 + (1 - stay0) * kt1, kt0)
    return tables


def gram_scores(grams: np.ndarray, p: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """log10 probability of each gram's last byte."""
    g = grams.astype(np.int64)
    s, last, out = g & 255, g >> 8 & 255, np.zeros(len(g))
    for k in range(8):
        bit, prefix = s >> (7 - k) & 1, 1 << k | s >> (8 - k)
        own, down, alone = (tables[bit, i, last, prefix] for i in range(3))
        out += np.log10(np.where(p[:, k] < 0, alone, own + down * p[:, k]))
    return out


def _trees(batches):
    """Over (context, gram, n) sorted by context: rows (gram, n, p) of grams and (key, below, n0, n1) of nodes."""
    grams, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for b in chain(batches, [None]):
        if b is not None:
            grams, n = np.concatenate([grams, b.column(1).to_numpy()]), np.concatenate([n, b.column(2).to_numpy()])
            if len(grams) < FLUSH:
                continue
        context = grams >> 8 & 0xFFFF
        cut = len(grams) if b is None or not len(grams) else int(np.flatnonzero(np.r_[True, context[1:] != context[:-1]])[-1])
        if not cut:
            continue
        p, (keys, below, n0, n1) = subtrees(grams[:cut], n[:cut])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 8 * cut + 1, 8), pa.int32()), pa.array(p.ravel()))
        none = lambda m, t: pa.nulls(m, t)
        i, f = pa.int64(), pa.float64()
        yield pa.RecordBatch.from_arrays([pa.array(grams[:cut]), pa.array(n[:cut]), lists, none(cut, i), none(cut, f), none(cut, f), none(cut, f)], names=_TREE)
        m = len(keys)
        yield pa.RecordBatch.from_arrays([none(m, i), none(m, i), none(m, lists.type), *(pa.array(x) for x in (keys, below, n0, n1))], names=_TREE)
        grams, n = grams[cut:], n[cut:]


_TREE = ["gram", "n", "p", "key", "below", "n0", "n1"]


def _head(counts: DataFrame, most: int) -> int:
    """The least count such that at most ``most`` entries reach it, from the counts of counts (blocks of powers of two)."""
    sizes = counts.groupBy(F.floor(F.log2(F.col("n") + 1) * 4).alias("c")).count().collect()  # some hundreds of rows at most
    total, at = 0, 1 << 62
    for r in sorted(sizes, key=lambda r: -r["c"]):
        total += r["count"]
        if total > most:
            break
        at = math.ceil(2 ** (r["c"] / 4) - 1)
    return max(1, at)


class _Table:
    """Grams to scores: one slot each by a multiplicative hash, the rest by binary search."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.shift = np.uint64(64 - max(1, int(len(keys) * 2).bit_length()))
        slot = self._slot(self.keys)
        self.slots = np.full(1 << 64 - int(self.shift), (1 << 64) - 1, np.uint64)  # no gram has so many bytes
        self.scores = np.zeros(len(self.slots))
        self.slots[slot], self.scores[slot] = self.keys, self.values

    def _slot(self, g):
        return (g * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def __call__(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score or 0, found)"""
        slot = self._slot(g)
        found = self.slots[slot] == g
        score = np.where(found, self.scores[slot], 0.0)
        rest = np.flatnonzero(~found)
        if len(rest) and len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, g[rest]), len(self.keys) - 1)
            hit = self.keys[at] == g[rest]
            found[rest[hit]], score[rest[hit]] = True, self.values[at[hit]]
        return score, found


_SCORED = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, words array<struct<word:binary,k:long>>, grams array<struct<gram:long,k:long>>"


def _scorer(words_sent, table_sent, slack: float):
    """Scores by the head tables; words and grams outside them are passed on with their counts."""

    def run(batches):
        words, table = words_sent.value, _Table(*table_sent.value)
        rid, end = TaskContext.get().partitionId() << 40, math.log10(slack)
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            texts = b.column(1).cast(pa.binary()).to_pylist()
            parts = [grams_of([t]) for t in texts]
            sizes = [len(g) for g in parts]
            score, found = table(np.concatenate(parts) if parts else np.zeros(0, np.uint64))
            at = 0
            for t, g, size in zip(texts, parts, sizes, strict=True):
                tokens = [*t.lower().split(), b""]
                known = list(map(words.get, tokens))
                rest = Counter(w for w, x in zip(tokens, known, strict=True) if x is None)
                hits = [x for x in known if x is not None]
                missing = g[~found[at : at + size]]
                keys, k = np.unique(missing, return_counts=True)
                for o, x in zip(out, (rid, len(tokens), len(hits), math.fsum(hits) - end * len(tokens), float(score[at : at + size].sum()), list(rest.items()), list(zip(keys.view(np.int64).tolist(), k.tolist(), strict=True))), strict=True):
                    o.append(x)
                rid, at = rid + 1, at + size
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.struct([("word", pa.binary()), ("k", pa.int64())])), pa.list_(pa.struct([("gram", pa.int64()), ("k", pa.int64())]))]
            a = [pa.array(x, t) for x, t in zip(out[:5], kinds[:5], strict=True)]
            lists = [pa.array([[{n: v, "k": c} for v, c in row] for row in x], t) for n, x, t in (("word", out[5], kinds[5]), ("gram", out[6], kinds[6]))]
            yield pa.RecordBatch.from_arrays([a[0], b.column(0).cast(pa.int64()), b.column(2), *a[1:], *lists], names=[x.split()[0] for x in _SCORED.split(", ")])

    return run


def score(docs: DataFrame, head_words: int = HEAD_WORDS, head_grams: int = HEAD_GRAMS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), is_held_out(F.col("doc_id")).alias("held_out"))
    counted = durable(rows.select("text", "held_out").mapInArrow(_counts, "word binary, gram long, n long").groupBy("word", "gram").agg(F.sum("n").alias("n")))
    words, grams = counted.where("word is not null").select("word", "n"), counted.where("word is null").select("gram", "n")
    known = words.where("n > 0")
    total, distinct = known.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    slack = float(total + distinct + 1)

    context = F.shiftrightunsigned("gram", 8).bitwiseAND(F.lit(0xFFFF).cast("long"))
    trees = durable(grams.select(context.alias("context"), "gram", "n").repartition("context").sortWithinPartitions("context").mapInArrow(_trees, "gram long, n long, p array<double>, key long, below double, n0 double, n1 double"))
    nodes = trees.where("key is not null").groupBy("key").agg(*(F.sum(x).alias(x) for x in ("below", "n0", "n1"))).collect()  # at most 65,280 rows
    column = lambda x, t: np.array([r[x] for r in nodes], t)
    tables = spark.sparkContext.broadcast(upper_levels(column("key", np.int64), column("below", float), column("n0", float), column("n1", float)))

    def finish(batches):
        for b in batches:
            g = b.column(0).to_numpy().view(np.uint64)
            p = b.column(2).values.to_numpy()[b.column(2).offsets[0].as_py() :][: 8 * len(g)].reshape(-1, 8)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(gram_scores(g, p, tables.value))], names=["gram", "n", "score"])

    scored = durable(trees.where("gram is not null").select("gram", "n", "p").mapInArrow(finish, "gram long, n long, score double"))
    head = scored.where(F.col("n") >= _head(scored, head_grams)).select("gram", "score").toArrow()
    common = known.where(F.col("n") >= _head(known, head_words)).toArrow()
    add = np.log10(common.column(1).to_numpy() + 1.0).tolist() if common.num_rows else []
    words_sent = spark.sparkContext.broadcast(dict(zip(common.column(0).to_pylist(), add, strict=True)))
    table_sent = spark.sparkContext.broadcast((head.column(0).to_numpy().view(np.uint64), head.column(1).to_numpy()))

    first = durable(rows.select("doc_id", "text", "held_out").mapInArrow(_scorer(words_sent, table_sent, slack), _SCORED))
    rare_words = first.select("rid", F.explode("words").alias("w")).select("rid", "w.word", "w.k").join(known, "word")
    rare_grams = first.select("rid", F.explode("grams").alias("g")).select("rid", "g.gram", "g.k").join(scored, "gram")
    more = rare_words.select("rid", F.col("k").alias("known"), (F.col("k") * F.log10(F.col("n") + 1)).alias("base"), F.lit(0.0).alias("more"))
    more = more.union(rare_grams.select("rid", F.lit(0).cast("long"), F.lit(0.0), F.col("k") * F.col("score")))
    more = more.groupBy("rid").agg(F.sum("known").alias("add_known"), F.sum("base").alias("add_base"), F.sum("more").alias("add_score"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return first.drop("words", "grams").join(more, "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + zero("add_known")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("add_base")).alias("base_score"),
        (F.col("score") + zero("add_score")).alias("score"),
    )
