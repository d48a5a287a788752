import numpy as np
import xxhash
from pyspark.sql import functions as F

from pagemill.llm import simhash


def plain(text: str, width: int = 4) -> int:
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).split()
    grams = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(fps: dict[int, int], radius: int = 4) -> dict[int, int]:
    of = {i: i for i in fps}

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    ids = sorted(fps)
    for i in ids:
        for j in ids:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= radius and root(i) != root(j):
                of[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(i) for i in ids}


def test_fingerprint_is_the_plain_definition():
    for text in ("", " \t", "One", "a b C d", "Été à la plage, été À LA plage " * 9, "x " * 40000):
        assert int(simhash.fingerprint(text.encode())[0]) == plain(text)


def test_within_counts_bits():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 63, (300, 2), dtype=np.uint64)
    fps[1::2] = fps[::2]
    for i in range(1, 300, 2):
        for b in rng.choice(128, rng.integers(0, 40), replace=False):
            fps[i, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    planes = simhash.planes_of(fps)
    for radius in (0, 1, 4, 24):
        for d in (1, 2, 7):
            got = simhash.within(planes, d, (1 << 300 - d) - 1, radius)
            want = [sum(int(x).bit_count() for x in fps[i] ^ fps[i + d]) <= radius for i in range(300 - d)]
            assert [bool(got >> i & 1) for i in range(300 - d)] == want


def test_queries_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    fps = {r.doc_id: plain(r.text) for r in docs.collect()}
    want = brute(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


def test_every_link_with_tiny_buckets(spark):
    """Chains of near fingerprints, with buckets cut into tiles of a few rows."""
    rng = np.random.default_rng(3)
    fps = [0, 1 << 63]
    for _ in range(160):
        x = int(fps[rng.integers(len(fps))]) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 8), replace=False))
        fps.append(x)
    fps = list(dict.fromkeys(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "f0 long")
    edges = simhash.links(df, 4, simhash.exact_tables(4), most=6)
    root = {r.node: r.root for r in simhash.components(edges).collect()}
    want = brute(dict(enumerate(fps)))
    groups = {}
    for i, x in enumerate(signed):
        groups.setdefault(root.get(x, x), set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(k for k in want if want[k] == r) for r in set(want.values()))


def test_odd_tables(spark):
    rows = [(3, None, 1), (1, "", 2), (2, "a b c d e", 3), (2, "a b c d e", 3), (None, "A b C d e", 4), (9, "word " * 70000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == [(-1, 2), (1, 1), (2, 2), (2, 2), (3, 1), (9, 9)]
    assert simhash.near_duplicates(df.limit(0)).collect() == []
    kept = simhash.keep_one(df.withColumns({"mark": F.lit(1), "row": F.lit("x"), "node": F.lit(2)}))
    assert kept.columns == [*df.columns, "mark", "row", "node"]
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 9]


def test_keep_one_drops_near_copies_only(spark):
    rng = np.random.default_rng(5)
    base = [[f"w{x}" for x in rng.integers(0, 5000, 300)] for _ in range(30)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i, w in enumerate(base[:10]):
        near = list(w)
        for at in (40, 150, 260):
            near[at] = "changed"
        rows += [(100 + i, " ".join(near)), (200 + i, " ".join(w))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == list(range(30))
    assert simhash.keep_one(df.withColumn("n", F.lit(1))).columns == ["doc_id", "text", "n"]


def edited(words, n, tag):
    """A copy with ``n`` words changed, at places five apart or more."""
    out = list(words)
    for i in range(n):
        out[3 + i * (len(words) // n)] = f"{tag}{i}"
    return out


def grouped(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.component_id for r in simhash.similar_groups(df).collect()}


def jaccard_groups(texts):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return dict(enumerate(root))


def test_all_pairs_at_the_threshold_are_found(spark):
    """Pairs just at 0.8, of short and long texts: each is linked."""
    rng = np.random.default_rng(11)
    texts = []
    for size in [60, 104, 204, 404, 1004] * 24:
        words = [f"w{x}" for x in rng.integers(0, 1 << 40, size)]
        texts += [" ".join(words), " ".join(edited(words, (size - 4) // 45, "c"))]
    want = jaccard_groups(texts)
    assert sum(want[i] == i for i in want) == len(texts) // 2
    assert grouped(spark, texts) == want


def test_texts_below_the_threshold_stay_apart(spark, monkeypatch):
    """Many texts of one template, 0.5 to 0.79 alike, and a chain of true copies among them."""
    rng = np.random.default_rng(12)
    draw = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
    texts = []
    for shared in (140, 155, 172, 178):
        template = draw(shared)
        texts += [" ".join(template + draw(200 - shared)) for _ in range(30)]
    chain = draw(400)
    for i in range(6):
        texts.append(" ".join(chain))
        chain = edited(chain, 7, f"e{i}_")
    want = jaccard_groups(texts)
    assert sum(want[i] == i for i in want) == 4 * 30 + 1
    assert grouped(spark, texts) == want
    monkeypatch.setattr(simhash.alike.verified, "__defaults__", (5, 4))  # groups cut into tiles
    assert grouped(spark, texts) == want


def test_keep_one_whatever_the_ids(spark):
    """One id on several texts, and copies without any id: one row of each group stays."""
    texts = [" ".join(f"{t}{i}" for i in range(60)) for t in "abcd"]
    rows = [(1, texts[0]), (5, texts[0]), (5, texts[1]), (7, texts[2]), (7, texts[3]), *[(None, texts[3])] * 3, *[(None, "own " + texts[1][::-1])] * 4]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = simhash.keep_one(df).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(1, texts[0]), (5, texts[1]), (7, texts[2]), (7, texts[3]), (0, rows[-1][1])])


def test_fingerprints_find_near_copies_by_themselves(spark, monkeypatch):
    """Without the pairs that the prefix filter adds, near fingerprints are still candidates; links are verified all the same."""
    rng = np.random.default_rng(17)
    base = [[f"w{x}" for x in rng.integers(0, 1 << 40, 2000)] for _ in range(4)]
    near = [edited(w, 1, "c") for w in base[:3]]
    rows = [(i, " ".join(w)) for i, w in enumerate(base + near)] + [(20, "one two"), (21, "")]
    bits = [int(simhash.fingerprint(t.encode())[0]) for _, t in rows]
    assert all((bits[i] ^ bits[4 + i]).bit_count() <= 4 for i in range(3))
    monkeypatch.setattr(simhash.alike, "candidates", lambda docs, size, width: spark.createDataFrame([], "a long, b long"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == [0, 1, 2, 3, 20, 21]
