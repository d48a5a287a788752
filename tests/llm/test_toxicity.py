import math

import numpy as np
import pytest

from pagemill.llm import toxicity


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = toxicity.score(docs, labels).where("held_out").join(labels, "doc_id").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    # about one toxic label in ten is on a text without any sign of it
    assert sum(r.predicted for r in toxic) >= 0.8 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.01 * len(clean)
    assert min(r.score for r in toxic if r.predicted) >= 0.5 and all(0 <= r.score <= 1 for r in rows)


def test_hidden_positives_are_not_negatives():
    """Positives share a word; so do the tenth of unlabelled texts that are toxic."""
    rng = np.random.default_rng(1)
    text = lambda toxic: np.unique(np.r_[rng.integers(100, 400, 20), [7] if toxic else []]).astype(np.int64)
    pos, unl = [text(True) for _ in range(300)], [text(rng.random() < 0.1) for _ in range(2000)]
    held = lambda rows: np.bincount(np.concatenate(rows), minlength=1 << toxicity.BITS)
    chosen = toxicity.choose(held(pos), held(unl), len(pos), len(unl))
    w, bias = toxicity.descend(toxicity.matrix(pos, chosen), toxicity.matrix(unl, chosen), 0.1)
    assert chosen.tolist() == [7] and bias < 0 < bias + w[0]


def test_risk_and_gradient_equal_the_plain_definition():
    """Row by row with math.exp, and the gradient by differences, on either side of zero."""
    rng = np.random.default_rng(3)
    xp, xu = (np.c_[rng.integers(0, 2, (n, 4)), np.ones(n)].astype(float) for n in (30, 50))
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    sides = set()
    for prior, scale in ((0.1, 1.0), (0.9, 1.0), (0.9, 3.0)):
        for _ in range(6):
            w = rng.normal(0, scale, 5)
            positive = prior * sum(sigmoid(-float(x @ w)) for x in xp) / len(xp)
            negative = sum(sigmoid(float(x @ w)) for x in xu) / len(xu) - prior * sum(sigmoid(float(x @ w)) for x in xp) / len(xp)
            assert toxicity.risk(w, xp, xu, prior) == pytest.approx((positive, negative))
            sides.add(negative >= 0)
            wanted = (lambda v: sum(toxicity.risk(v, xp, xu, prior))) if negative >= 0 else (lambda v: -toxicity.risk(v, xp, xu, prior)[1])
            steps = 1e-6 * np.eye(5)
            slopes = [(wanted(w + d) - wanted(w - d)) / 2e-6 for d in steps]
            assert toxicity.gradient(w, xp, xu, prior) == pytest.approx(slopes, abs=1e-6)
    assert sides == {True, False}


def test_an_id_counts_once(spark):
    """One id that has 400 of 500 rows, and a repeated label, do not weigh more than others."""
    rows = [(i, f"plain words {i}" + " villain" * (i % 4 == 0)) for i in range(100)] + [(1, "plain words 1")] * 400
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(60)] + [(4, 1)] * 50, "doc_id long, toxic int")
    once = toxicity.learn(df.distinct(), labels.distinct())
    often = toxicity.learn(df, labels)
    assert len(once[0]) and once[0].tolist() == often[0].tolist()
    assert once[1] == pytest.approx(often[1]) and once[2] == pytest.approx(often[2])


def test_odd_rows(spark):
    rows = [(i, f"the day {i} was fine" + " you utter villain" * (i % 3 == 0), 0) for i in range(300)] + [(900, None, 0), (None, "villain", 0), (901, "", 0), (902, "x " * 90000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    df = df.union(df.where("doc_id < 5"))
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(0, 300, 2)] * 2 + [(None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(df, labels).collect()}
    assert all(got[i].predicted == (i % 3 == 0) for i in range(300)) and got[None].predicted == 1
    assert got[900].score == got[901].score == got[902].score < 0.5
    assert toxicity.score(df, labels).count() == df.count()
    assert {r.score for r in toxicity.score(df, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score(df.limit(0), labels).collect() == []
