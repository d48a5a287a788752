import math
import pickle
import random

import pytest
from pyspark.sql import functions as F

from pagemill.llm import decontam
from tests.llm.plain import shingles


def vocabulary(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(n)]


def test_search_finds_all_above_the_threshold():
    rng = random.Random(1)
    words = vocabulary(rng, 400)
    draw = lambda n: [words[int(rng.random() ** 3 * 400)] for _ in range(n)]
    items = [(i, " ".join(draw(rng.randint(3, 200)))) for i in range(300)]
    for threshold in (0.05, 0.3, 0.5):
        index = decontam.Index(items, threshold)
        for _ in range(60):
            text = draw(rng.randint(1, 300))
            if rng.random() < 0.5:
                text += items[rng.randrange(300)][1].split()
            own = [w.encode() for w in text]
            scores = {}
            for w in set(own[:128]):
                for n, x in index.postings(w):
                    scores[n] = scores.get(n, 0) + x
            want = {n: s for n, s in scores.items() if s >= threshold - 1e-9}
            rows = [index.rows.get(w) for w in own]
            got = dict(index.search(set(rows[:128]) - {None}))
            assert set(got) == set(want) and got == pytest.approx(want)
            if want:
                assert 0 in index.windows(rows)


def test_whole_table(spark, sf):
    """Documents that hold an item's text, or nearly, and no others."""
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    want, none = set(), set()
    for r in docs.collect():
        held = shingles(decontam.words_of(r.text))
        for i, t in items.items():
            own = shingles(decontam.words_of(t))
            share = len(own & held) / len(own)
            (want if share > 0.8 else none if share < 0.3 else set()).add((r.doc_id, i))
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()}
    assert want and got >= want and not got & none
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in got}


def test_odd_rows(spark, monkeypatch):
    rng = random.Random(2)
    words = vocabulary(rng, 900)
    long = " ".join(rng.choice(words) for _ in range(500))
    short = "What is the capital of Atlantis? The capital is Poseidonis."
    nameless = "Which river runs past the old mill of Argentum? The Silverstream does."
    bench = spark.createDataFrame([(1, short, 0), (2, long, 0), (3, None, 0), (None, "", 0), (1, short, 1), (None, nameless, 2)], "item_id long, text string, doc_id int")
    filler = " ".join(rng.choice(words) for _ in range(3000))
    rows = [(1, None), (2, ""), (3, f"{filler} {short.upper()} {filler}"), (None, short), (4, filler), (5, f"{filler} {long} {filler}"), (5, f"{filler} {long} {filler}"), (6, "The capital is Poseidonis."), (7, "What is the height of Atlantis? Nobody knows the capital."), (8, f"{filler} {nameless}")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, item_id int")
    for size in (decontam.INDEX_BYTES, 1000):
        monkeypatch.setattr(decontam, "INDEX_BYTES", size)
        got = sorted(((r.doc_id or 0, r.item_id) for r in decontam.contaminated(docs, bench).collect()), key=str)
        assert got == [(0, 1), (3, 1), (5, 2), (5, 2), (8, None)]
        assert sorted(r.doc_id for r in decontam.clean(docs, bench).collect()) == [1, 2, 4, 6, 7]
    assert decontam.contaminated(docs.limit(0), bench).collect() == []
    assert decontam.clean(docs, bench.where(F.lit(False))).count() == len(rows)


def test_short_document_is_an_item():
    assert [m[0] for m in decontam.Index([(1, "Capital of Peru? Lima.")]).matches("Capital of Peru? Lima.")] == [1]


def test_partial_copies():
    rng = random.Random(4)
    words = vocabulary(rng, 3000)
    draw = lambda n: " ".join(rng.choice(words) for _ in range(n))
    question, long, short = draw(40), draw(300), draw(7)
    index = decontam.Index([(1, f"{question}. B."), (2, long), (3, f"{short}? yes sure."), *((i, draw(60)) for i in range(4, 30))])
    part = " ".join(long.split()[64:128])
    for text, want in ((question, [1]), (f"{question}. Zzz.", [1]), (part, [2]), (" ".join(part.split()[:30]), []), (short, []), (draw(200), [])):
        assert [m[0] for m in index.matches(f"{draw(100)} . {text}")] == want


def test_scores_do_not_depend_on_groups(spark, monkeypatch):
    rng = random.Random(6)
    words = vocabulary(rng, 300)
    draw = lambda n: [words[int(rng.random() ** 2 * 300)] for _ in range(n)]
    items = [(i, " ".join(draw(40))) for i in range(40)]
    texts = [(i, " ".join(t.split()[: rng.randint(20, 40)] + draw(20))) for i, t in items]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = lambda: {(r.doc_id, r.item_id): r.score for r in decontam.contaminated(docs, bench).collect()}
    want = found()
    monkeypatch.setattr(decontam, "INDEX_BYTES", 2000)
    assert want and found() == pytest.approx(want)


def plain_pairs(docs, items):
    """The whole search word for word: every window against every part, then the overlaps as sets."""
    parts, df = [], {}
    for i, text in items:
        words = decontam.words_of(text)
        for at in range(0, len(words), decontam.PART):
            part = words[at : at + decontam.PART]
            parts.append((i, text, part))
            for w in set(part):
                df[w] = df.get(w, 0) + 1
    mean = sum(len(p) for _, _, p in parts) / len(parts)

    def weights(part):
        norm = decontam.K1 * (1 - decontam.B + decontam.B * len(part) / mean)
        raw = {w: math.log((len(parts) + 1) / df[w]) * part.count(w) * (decontam.K1 + 1) / (part.count(w) + norm) for w in set(part)}
        return {w: x / sum(raw.values()) for w, x in raw.items()}

    weighed, out = [(i, text, part, weights(part)) for i, text, part in parts], {}
    for doc, text in docs:
        words = decontam.words_of(text)
        windows = [set(words[at : at + decontam.WINDOW]) for at in range(0, max(1, len(words) - decontam.WINDOW + decontam.STRIDE), decontam.STRIDE)]
        for i, item, part, weight in weighed:
            score = max((sum(weight[w] for w in own & weight.keys()) for own in windows), default=0.0)
            if score < decontam.THRESHOLD - 1e-9:
                continue
            question, answer = decontam.question_and_answer(item)
            q, a = shingles(question), set(answer)
            n = len(next(iter(q)).split()) if q else 5
            in_q = len(q & shingles(words, n)) / len(q) if q else 1.0
            in_a = len(a & set(words)) / len(a) if a else 1.0
            own = shingles(part)
            alone = in_q >= decontam.ALONE and len(q) > decontam.LONG - 5 or len(part) >= decontam.LONG and len(own & shingles(words)) >= decontam.ALONE * len(own)
            best, ok, *_ = out.get((doc, i), (0.0, False))
            out[doc, i] = (max(best, score), ok or alone or in_q >= decontam.QUESTION and in_a >= decontam.ANSWER, in_q, in_a)
    return {k: (s, q, a) for k, (s, ok, q, a) in out.items() if ok}


def test_query_equals_plain_version(spark, sf):
    """Row for row over the whole table, and over copies of items with words changed, so that all overlaps occur."""
    rng = random.Random(9)
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    own = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for n, (_, text) in enumerate(items):
        for share in (0.02, 0.1, 0.2, 0.35):
            words = [w if rng.random() > share else f"other{rng.randrange(99)}" for w in text.split()]
            own.append((10**6 + len(own), f"some words before {' '.join(words)} and after {n}"))
    docs = spark.createDataFrame(own, "doc_id long, text string")
    want = plain_pairs(own, items)
    got = {(r.doc_id, r.item_id): (r.score, r.question_overlap, r.answer_overlap) for r in decontam.contaminated(docs, bench).collect()}
    assert len(want) > len(items) and set(got) == set(want)
    for k in want:
        assert got[k] == pytest.approx(want[k])


def test_index_size():
    """The index takes a bounded multiple of its items' bytes."""
    rng = random.Random(3)
    words = vocabulary(rng, 30_000)
    items = [(i, " ".join(rng.choices(words, k=200))) for i in range(500)]
    assert len(pickle.dumps(decontam.Index(items))) < 12 * sum(len(t) for _, t in items)
