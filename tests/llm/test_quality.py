import math
import random
import re

from pyspark.sql import functions as F

from pagemill.llm import quality


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    counts = (sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
    return (len(words), *counts, len(words) < 10 or 100 * len(covered) > 20 * len(words))


def check(df):
    columns = ["n_words", *quality.COUNTS[1:], "base_failed"]
    rows = quality.score(df).collect()
    texts = {}
    for r in df.collect():
        texts.setdefault(r.doc_id, set()).add(plain(r.text))
    for r in rows:
        assert tuple(r[c] for c in columns) in texts[r.doc_id]
        assert not (r.kept and r.base_failed)
    return rows


def test_counts_equal_the_plain_definition(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = check(docs)
    assert len(rows) == docs.count()


def test_odd_texts(spark, tmp_path):
    rng = random.Random(1)
    made = [" ".join(rng.choice("abc") for _ in range(n)) for n in (4, 5, 6, 7, 20, 90)]
    made += [None, "", " \n\t", "  a b", "x\n\nx\n x\nx", "é " * 30, "a b c d e " * 3, "w " * 60000, "\x0b\x0ca\r\nb"]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(made)] + [(None, "a", 0), (3, made[3], 1)], "doc_id long, text string, n_words int")
    df.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    check(df)
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and set(kept.collect()) <= set(df.collect())
    odd = df.select(F.col("doc_id"), F.col("text"), F.lit("a").alias("row"), F.lit(1).alias("words"), F.lit(2).alias("vote_lines"), F.lit(3).alias("__q_text"))
    assert quality.keep_good(odd).columns == odd.columns and quality.keep_good(odd).count() == kept.count()
    assert quality.score(df.limit(0)).collect() == [] and quality.keep_good(df.limit(0)).collect() == []


def test_junk_goes_and_prose_stays(spark):
    """Against the labels of the larger table."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").withColumnRenamed("quality", "label")
    rows = quality.score(docs).join(labels, "doc_id").select("label", "kept", "base_failed").collect()
    good = [r for r in rows if r.label == 1 and not r.base_failed]
    bad = [r for r in rows if r.label == 0]
    assert sum(r.kept for r in good) >= 0.99 * len(good)
    assert sum(r.kept for r in bad) <= 0.1 * len(bad)
    assert quality.keep_good(docs).count() == quality.score(docs).where("kept").count()


def test_estimate_recovers_accuracies():
    rng = random.Random(2)
    patterns = {}
    for _ in range(20000):
        good = rng.random() < 0.8
        x = tuple((-1 if rng.random() < (0.02 if good else 0.6) else 0) for _ in range(4))
        patterns[x] = patterns.get(x, 0) + 1
    base, each = quality.estimate(patterns, 4)
    assert 0.5 < base < 2.2
    assert all(e[-1] < -2 and e[0] > 0.3 for e in each)


def test_estimate_equals_plain_em():
    """Row by row, with the start kept as a share of the evidence, against the counts of patterns."""
    rng = random.Random(4)
    rows = [tuple(rng.choices((-1, 0, 1), (1, 6, 3) if rng.random() < 0.7 else (5, 4, 1))[0] for _ in range(3)) for _ in range(400)]
    share, extra = 0.85, quality.PRIOR_SHARE * len(rows)
    p = {k: [dict(zip((-1, 0, 1), quality.START[k])) for _ in range(3)] for k in ("good", "bad")}
    for _ in range(60):
        each = []
        for x in rows:
            g = share * math.prod(p["good"][j][v] for j, v in enumerate(x))
            b = (1 - share) * math.prod(p["bad"][j][v] for j, v in enumerate(x))
            each.append(g / (g + b))
        share = (sum(each) + 0.85 * extra) / (len(rows) + extra)
        for k, weights in (("good", each), ("bad", [1 - g for g in each])):
            p[k] = [{v: (sum(w for w, x in zip(weights, rows) if x[j] == v) + extra * quality.START[k][i]) / (sum(weights) + extra) for i, v in enumerate((-1, 0, 1))} for j in range(3)]
    patterns = {}
    for x in rows:
        patterns[x] = patterns.get(x, 0) + 1
    base, found = quality.estimate(patterns, 3)
    assert abs(base - math.log(share / (1 - share))) < 1e-9
    assert all(abs(found[j][v] - math.log(p["good"][j][v] / p["bad"][j][v])) < 1e-9 for j in range(3) for v in (-1, 0, 1))
