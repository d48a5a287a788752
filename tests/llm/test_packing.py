import random
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from pagemill.llm import packing
from pagemill.llm.common import release
from pagemill.llm.tokens import WORD, encoder, vocabulary


def test_pack_is_best_fit_and_bounded():
    rng = random.Random(1)
    sizes = [min(100, max(1, int(rng.expovariate(1 / 30)))) for _ in range(5000)]
    for most in (1, 3, 40):
        bins = list(packing.pack(((s, i) for i, s in enumerate(sizes)), 100, most))
        assert sorted(i for b, _ in bins for i, _ in b) == list(range(len(sizes)))
        assert sum(o for _, o in bins) <= most
        for b, _ in bins:
            at = 0
            for i, offset in b:
                assert offset == at
                at += sizes[i]
            assert at <= 100
    assert len(bins) <= 1.02 * sum(sizes) / 100


def check(spark, docs, **settings):
    plain = Tokenizer.from_file(vocabulary(WORD))
    plain.encode_special_tokens = True
    length = settings.get("length", packing.LENGTH)
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = np.array([*plain.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(str(r.doc_id), k, at, len(ids[at : at + length]), zlib.crc32(ids[at : at + length].tobytes())) for k, at in enumerate(range(0, len(ids), length))]
    rows = packing.packed(docs, **settings).collect()
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= length
    return len(bins), sum(x[3] for x in want) / length


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(5)
    n, least = check(spark, docs)
    assert n <= 1.03 * least + 1
    check(spark, docs, length=128, most=4, per_round=60)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 1), (1, "", 2), (None, "a b", 3), (2, "word " * 9000, 4), (2, "word " * 9000, 4)], "doc_id long, text string, piece int")
    check(spark, df)
    assert packing.packed(df.limit(0)).collect() == []


def test_a_worker_takes_little_memory():
    """Tables of an encoder, and what a batch of 4 MB takes besides, in many texts and in one."""
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(30_000)]
    docs = [" ".join(rng.choices(words, k=640)) for _ in range(1000)]
    path = vocabulary(WORD)
    release()
    plain = Tokenizer.from_file(path)
    want = sorted((i, k, at, len(x[at : at + 4096]), zlib.crc32(x[at : at + 4096].tobytes())) for i, t in enumerate(docs) for x in [np.array([*plain.encode(t, add_special_tokens=False).ids, 1], "<u4")] for k, at in enumerate(range(0, len(x), 4096)))
    for texts in (docs, [" ".join(docs)]):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
        release()
        tracemalloc.start()
        rows = sorted(item for _, item in packing._encoded([batch], path, 4096, 1))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 110e6
        if len(texts) > 1:
            assert rows == want
        else:  # joined by spaces, the texts' words have the same ids
            assert sum(r[3] for r in rows) == sum(r[3] for r in want) - len(docs) + 1
    assert encoder(path, lean=True).short.a.nbytes <= 8 << 20
