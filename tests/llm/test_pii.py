import random
import re
from functools import cache

import pytest

from pagemill.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def plain(text):
    """The patterns as they stand."""
    out = {k: [] for k in pii.KINDS}
    out["email"] = [m.span() for m in EMAIL.finditer(text)]
    out["ip"] = [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out["card"] = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(d)]
    out["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_base_spans_are_the_patterns(spark, sf):
    rng = random.Random(4)
    made = ["".join(rng.choice("a.b@@1239-+ ()é") for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    made += [".".join(str(rng.randint(0, 300)) for _ in range(rng.randint(2, 9))) for _ in range(300)]
    made += ["4111 1111 1111 1111", "4111-1111-1111-1111 5", "a@b.c@d.e", "x" * 5000 + "@", "1" * 100000, "+1 " + "2" * 40, "٣.٣.٣.٣"]
    made += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for text in made:
        assert pii.base_spans(text) == plain(text), text[:80]


@cache
def model():
    return pii.trained()


def test_field_finds_what_patterns_miss():
    rng, hit, total, wrong = random.Random(99), 0, 0, 0
    for _ in range(300):
        text, spans = pii._made_up(rng)
        got = set(pii.find(text, model())[1])
        hit, total, wrong = hit + len(got & set(spans)), total + len(spans), wrong + len(got - set(spans))
    assert hit >= 0.95 * total and wrong <= 0.03 * total


@pytest.mark.parametrize("text", ["on 2023-01-15 we met", "version 3.10.2", "meet at noon.com", "1914-1918", "a b c", "order 12345678901", "1,234,567 people", 'token = "5d190bd7c06284de91015a36974748794293dd8a"'])
def test_clean_text_is_left_alone(text):
    assert pii.find(text, model())[1] == []
    assert pii.redacted(text, model()) == text


def test_decode_is_the_best_of_all():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(40):
        n, moves = 4, rng.normal(size=(5, 5))
        scored = [(i, j, y, float(rng.normal())) for i in range(n) for j in range(i + 1, n + 1) for y in range(5)]
        score = {s[:3]: s[3] for s in scored}
        best = max(
            (sum(score[a, b, y] for (a, b), y in zip(zip(cut, cut[1:], strict=False), ys, strict=True)) + sum(moves[p, y] for p, y in zip((0, *ys), ys, strict=False)), [(a, b, y) for (a, b), y in zip(zip(cut, cut[1:], strict=False), ys, strict=True)])
            for k in range(n)
            for inner in itertools.combinations(range(1, n), k)
            for cut in [(0, *inner, n)]
            for ys in itertools.product(range(5), repeat=len(cut) - 1)
        )
        assert pii.decode(n, scored, moves) == best[1]


def test_rows(spark, sf):
    rows = [(1, None, "x"), (1, "mail a@b.co é +49 30 1234567", "x"), (None, "", "x"), (2, "z " * 90000 + "1.2.3.4", "x"), (3, "jane at example dot com", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base, r.spans) for r in pii.scan(df).collect()}
    assert got == {(1, 0, 0, 0, 0, "", ""), (1, 1, 0, 0, 1, "email:5:11,phone:14:28", "email:5:11,phone:14:28"), (None, 0, 0, 0, 0, "", ""), (2, 0, 1, 0, 0, "ip:180000:180007", "ip:180000:180007"), (3, 0, 0, 0, 0, "", "email:0:23")}
    assert pii.scan(df.limit(0)).collect() == []
    clean = pii.redact(df.withColumn("n_chars", df.doc_id))
    assert clean.columns == [*df.columns, "n_chars"]
    assert {r.text for r in clean.collect()} >= {None, "mail [EMAIL] é [PHONE]", "", "[EMAIL]"}
    assert {r.n_chars for r in clean.where("doc_id = 3").collect()} == {7}


def test_likelihood_is_that_of_all_rows_of_segments():
    """A few stretches: the truth's share of the sum over every row of segments, and slopes by differences."""
    import numpy as np

    rng = np.random.default_rng(2)
    made, k = [], len(pii.LABELS)
    for n in (1, 2, 3):
        found = [(i, j, y, rng.integers(0, 6, 2).tolist(), False) for i in range(n) for j in range(i + 1, n + 1) for y in range(k) if rng.random() < 0.6 or j == i + 1 and y == 0]
        made.append((n, [(i, j, y, f, j == i + 1 and y == 0) for i, j, y, f, _ in found]))
    data, w, moves = pii._Sentences(made), rng.normal(size=6), rng.normal(size=(k, k))

    def plain(w, moves):
        total = 0.0
        for n, found in made:
            def rows(at, before):
                if at == n:
                    yield 0.0, True
                for i, j, y, f, gold in found:
                    if i == at:
                        for s, true in rows(j, y):
                            yield s + w[f].sum() + moves[before, y], true and gold
            every = list(rows(0, 0))
            total += next(s for s, true in every if true) - np.logaddexp.reduce([s for s, _ in every])
        return total

    value, slope, move_slope = data.likelihood(w, moves)
    assert value == pytest.approx(plain(w, moves))
    for i, d in enumerate(1e-6 * np.eye(6)):
        assert slope[i] == pytest.approx((plain(w + d, moves) - plain(w - d, moves)) / 2e-6, abs=1e-5)
    for i in range(k * k):
        d = np.zeros(k * k)
        d[i] = 1e-6
        d = d.reshape(k, k)
        assert move_slope.ravel()[i] == pytest.approx((plain(w, moves + d) - plain(w, moves - d)) / 2e-6, abs=1e-5)


#: Sentences written by hand, not drawn from what the field is trained on, and the spans in them.
WRITTEN = [
    ("Please ring my office on (415) 555-0133 after lunch.", ["phone:(415) 555-0133"]),
    ("Her mobile is 212-555-0199, but she rarely answers.", ["phone:212-555-0199"]),
    ("You can write to maria.lopez at example dot com for details.", ["email:maria.lopez at example dot com"]),
    ("Send it to tom [at] mailhost [dot] org before Friday.", ["email:tom [at] mailhost [dot] org"]),
    ("Charge the card 4111/1111/1111/1111 and ship it.", ["card:4111/1111/1111/1111"]),
    ("Fax: 030 555 0147 (ask for Jo).", []),
    ("The meeting on 2024-03-18 was moved to 2024-03-25.", []),
    ("Chapters 101-155 cover the years 1914-1918 in depth.", []),
    ("We sold 1200 300 450 units in three quarters.", []),
    ("ISBN 978-3-16-148410-0 is out of print.", []),
    ("Call 646.555.0188 or visit us at noon.", ["phone:646.555.0188"]),
    ("The file has 12345678 bytes and version 10.4.2.", []),
    ("Dinner at eight. The score was 3-2.", []),
]


def test_field_on_sentences_written_by_hand():
    hit = total = wrong = 0
    for text, spans in WRITTEN:
        got = {f"{k}:{text[a:b]}" for k, a, b in pii.find(text, model())[1]}
        hit, total, wrong = hit + len(got & set(spans)), total + len(spans), wrong + len(got - set(spans))
    assert total == 6 and hit >= 5 and wrong <= 1, (hit, wrong)


def whole(text):
    """The field's spans by one dynamic program over all candidates of each stretch."""
    field, out = model(), []
    for way, units in pii.stretches(text):
        scored = [(i, j, y, sum(map(field.weight, fs))) for i, j, y, fs in pii.segments(text, way, units)]
        out += [(way, y, units[i][0], units[j - 1][1]) for i, j, y in pii.decode(len(units), scored, field.moves) if y]
    return [("email", a, b) for way, _, a, b in out if way == "spelled"], [(y, a, b) for way, y, a, b in out if way == "digits"]


@pytest.mark.parametrize("settle", [13, 40, 2048])
def test_runs_a_unit_at_a_time_give_what_whole_runs_give(monkeypatch, settle):
    monkeypatch.setattr(pii, "SETTLE", settle)
    rng = random.Random(settle)
    made = ["".join(rng.choice("0123456789 .-()+/a") for _ in range(rng.randint(5, 150))) for _ in range(400)]
    made += [" ".join(str(rng.randint(0, 10 ** rng.randint(1, 8))) for _ in range(rng.randint(2, 90))) for _ in range(60)]
    made += [" ".join(pii._made_up(rng)[0] for _ in range(3)) for _ in range(60)]
    made += [" ".join(rng.choice("0123456789") for _ in range(200)), "call 555 867 5309 " + "12.5 " * 300 + "4111/1111/1111/1111"]
    for text in made:
        mails, numbers = whole(text)
        assert list(model().numbers(text)) == numbers, text[:90]
        assert [("email", a, b) for a, b in model().addresses(text)] == mails


def test_a_long_table_of_numbers_takes_little_memory():
    import tracemalloc

    rng = random.Random(2)
    text = " ".join(f"{rng.randint(100, 999)}.{rng.randint(10, 99)}" for _ in range(6_000))
    tracemalloc.start()
    assert sum(1 for _ in model().numbers(text)) == 0
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20


def test_numbers_in_single_digits_are_read():
    assert any(True for _ in pii.digit_units("5 5 5 8 6 7 5 3 0 9"))
    field = pii.Field({"phone after phone": 50.0}, model().moves)
    text = "call 5 5 5 8 6 7 5 3 0 9 now"
    assert pii.find(text, field)[1] == [("phone", 5, 24)]
