import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pagemill.llm import ctw


def held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2


def kt(n0, n1):
    return math.lgamma(n0 + 0.5) + math.lgamma(n1 + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(n0 + n1 + 1)


class Plain:
    """The tree as a recursion over dictionaries."""

    def __init__(self, texts):
        self.n, self.longer = defaultdict(lambda: [0, 0]), defaultdict(set)
        for t in texts:
            for context, prefix, bit in self.bits(t):
                for d in range(ctw.DEPTH + 1):
                    self.n[context[ctw.DEPTH - d :], prefix][bit] += 1
                    if d:
                        self.longer[context[ctw.DEPTH - d + 1 :], prefix].add(context[ctw.DEPTH - d :])
        self.memo = {}

    @staticmethod
    def bits(text):
        data = b"\xff" * ctw.DEPTH + text + b"\xff"
        for i in range(ctw.DEPTH, len(data)):
            prefix = 1
            for k in range(7, -1, -1):
                bit = data[i] >> k & 1
                yield data[i - ctw.DEPTH : i], prefix, bit
                prefix = prefix << 1 | bit

    def weighted(self, context, prefix):
        if (context, prefix) not in self.memo:
            own = kt(*self.n[context, prefix])
            if len(context) < ctw.DEPTH:
                below = sum(self.weighted(c, prefix) for c in self.longer[context, prefix])
                own = np.logaddexp(math.log(0.5) + own, math.log(0.5) + below)
            self.memo[context, prefix] = own
        return self.memo[context, prefix]

    def score(self, text):
        total = 0.0
        for context, prefix, bit in self.bits(text):
            p = None
            for d in range(ctw.DEPTH, -1, -1):
                c = context[ctw.DEPTH - d :]
                if d and (c, prefix) not in self.n:
                    continue
                n = self.n.get((c, prefix), [0, 0])
                own = (n[bit] + 0.5) / (sum(n) + 1)
                if p is None:
                    p = own
                else:
                    stay = math.exp(math.log(0.5) + kt(*n) - self.weighted(c, prefix))
                    p = stay * own + (1 - stay) * p
            total += math.log10(p)
        return total


def check(spark, df, **settings):
    rows = [(r.doc_id, (r.text or "").encode()) for r in df.select("doc_id", "text").collect()]
    train = [t for d, t in rows if not held(d)]
    model, c = Plain(train), Counter(w for t in train for w in [*t.lower().split(), b""])
    total, v = sum(c.values()), len(c)
    want = []
    for d, t in rows:
        tokens = [*t.lower().split(), b""]
        base = sum(math.log10((c[w] + 1) / (total + v + 1)) for w in tokens)
        want.append((str(d), held(d), len(tokens), sum(c[w] > 0 for w in tokens), total, base, model.score(t)))
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in ctw.score(df, **settings).collect()]
    assert len(got) == len(want)
    for g, w in zip(sorted(got), sorted(want), strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)


def test_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 700 and doc_id < 110")
    check(spark, docs.repartition(3))
    check(spark, docs.repartition(3), head_words=20, head_grams=50)


def test_odd_rows(spark):
    df = spark.createDataFrame([(2, None, 1), (2, "", 1), (None, "a b", 1), (5, "Été " * 50, 1), (5, "Été " * 50, 1), (6, "\xff\x00 A a", 1)], "doc_id long, text string, score int")
    check(spark, df)
    check(spark, df.where("doc_id = 5"))
    assert ctw.score(df.limit(0)).collect() == []


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 7, 1e3, 1e9])
    assert np.allclose(ctw._log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-11)


def test_model_predicts_held_out_text(spark):
    """Far fewer bits a byte than the bytes' own frequencies, in training text or not."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text.encode() for r in docs.collect()}
    freq = Counter(b"".join(texts.values()))
    total = sum(freq.values())
    order0 = -sum(c * math.log2(c / total) for c in freq.values()) / total
    rows = ctw.score(docs).collect()
    bits = {h: -sum(r.score for r in rows if r.held_out == h) / math.log10(2) / sum(len(texts[r.doc_id]) + 1 for r in rows if r.held_out == h) for h in (True, False)}
    assert bits[False] < bits[True] < 0.7 * order0
