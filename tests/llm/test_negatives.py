"""Hard negatives against a plain version: odd rows, ties, many blocks, the sample table."""

import math
import random

import numpy as np
import pytest

from pagemill.llm import negatives, queries
from tests.oracle import compare

SCHEMA = "vec_id long, embedding array<float>, label int, id long, block int, v string, rank int"


def plain(rows, positives=5, keep=10):
    good = []
    for i, e, label in rows:
        if i is None or label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        v = [min(1 << 24, max(-(1 << 24), math.floor(256 * float(np.float32(x))))) for x in e]
        good.append((i, (math.fmod(label + 1, 10) if i % 7 == 0 else label), v))
    out = []
    for i, label, v in good:
        if i % 100:
            continue
        others = [(-sum(a * b for a, b in zip(v, w, strict=False)), j, k) for j, k, w in good if j != i]
        for p, j, _ in sorted(x for x in others if x[2] == label)[:positives]:
            fits = sorted(x for x in others if x[2] != label and 30 * -p <= 100 * -x[0] <= 90 * -p)[:keep]
            out += [(i, j, n, x[1], -p, -x[0]) for n, x in enumerate(fits, 1)]
    return sorted(out)


def found(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2, "v", 3) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in negatives.hard_negatives(df).collect())


def made(n, dims, seed, labels=4, step=0.25):
    r = random.Random(seed)
    return [(i, [r.choice([-2, -1, 0, 1, 2]) * step + r.random() * step * (i % 2) for _ in range(dims)], r.randrange(labels)) for i in range(n)]


ODD = [
    (100, [1.0, 0.5], 1), (100, [1.0, 0.5], 1), (101, [1.0, 0.5], 1), (102, [1.0], 1), (102, [1.0], 2), (103, [], 1), (104, [0.6, 0.1, 0.4], 2),
    (None, [1.0, 1.0], 1), (105, None, 1), (106, [1.0, None], 1), (107, [float("nan"), 1.0], 1), (108, [float("inf")], 2), (109, [1.0, 1.0], None),
    (200, [3e38, 0.0], 3), (201, [3e38, 1.0], 3), (202, [1e5, 0.0], 2), (203, [3e4, 2.0], 2), (300, [-1.0, 0.0], 4), (301, [1.0, 0.0], 4), (-100, [0.7, 0.7], 9), (7, [0.6, 0.7], 9), (0, [0.5, 0.5], -3),
]


@pytest.mark.parametrize("rows", [ODD, made(300, 3, 1), [(i, [0.5, 0.25], i % 2) for i in range(250)], [(i, [0.1], 1) for i in range(5)], []], ids=["odd", "ties", "equal", "one label", "empty"])
def test_equals_plain_version(spark, rows):
    assert found(spark, rows) == plain(rows)


def test_many_blocks_and_leaves(spark, monkeypatch):
    """A top tree of several leaves, one of them in several blocks (a third of the rows is one vector)."""
    monkeypatch.setattr(negatives, "BLOCK", 64)
    monkeypatch.setattr(negatives, "LEAF", 8)
    rows = made(700, 4, 2) + [(i, [0.5, 0.25, 0.5, 0.25], i % 3) for i in range(700, 1050)]
    assert found(spark, rows) == plain(rows)


def test_leaves_are_left_out():
    """Clustered rows: most leaves lie outside the annulus and are not visited."""
    r = np.random.default_rng(0)
    v = (r.normal(size=(64, 1, 2)) * 300 + r.normal(size=(64, 64, 2)) * 4).reshape(-1, 2).astype(np.int64)
    norm = float((v * v).sum(1).max())
    tree = negatives.Tree(negatives.augmented(v, norm), 6).measured(negatives.augmented(v, norm))
    top = sorted(v @ v[0])[-10]
    batch = negatives.pa.RecordBatch.from_pydict({"id": [0], "own": [0], "label": [0], "v": [v[0].tolist()], "windows": [[{"low": int(top), "high": 1 << 62, "least": int(top)}]]})
    _, can = negatives.Queries(batch, 2, norm).meets(tree)
    assert 1 <= can.sum() <= 16


def test_query_equals_its_sql(spark, sf):
    compare(spark, sf, queries.QUERIES["op12_hard_negatives"], queries.ORACLE_SQL["op12_hard_negatives"])
