import zlib

import numpy as np
from tokenizers import Tokenizer

from pagemill.llm import dac
from pagemill.llm.tokens import BYTE, vocabulary


def test_every_token_is_addressable():
    rng = np.random.default_rng(1)
    for top in (200, 50_000, 1 << 31):
        for n in (1, 511, 512, 513, 5000):
            ids = (rng.random(n) ** 3 * top).astype(np.uint32)
            r = dac.Reader(b"".join(dac.to_parts(3, 9, [5, None], np.array([0, n // 2, n]), ids)))
            assert (r.shard, r.before, r.doc_ids) == (3, 9, [5, None])
            assert np.array_equal(r.ids(), ids)
            assert [r.token(i) for i in range(n)] == ids.tolist()


def check(docs, folder, **settings):
    plain = Tokenizer.from_file(vocabulary(BYTE))
    plain.encode_special_tokens = True
    want, at = [], 0
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*plain.encode(text, add_special_tokens=False).ids, 0], "<u4")
        want.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    bases = dac.write(docs, folder, **settings)
    got = [tuple(r) for r in dac.read(docs.sparkSession, folder, bases).collect()]
    assert bases[-1] == at
    return sorted(got, key=str), sorted(want, key=str)


def test_whole_table(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(3)
    got, want = check(docs, f"{tmp_path}/a")
    assert got == want
    got, want = check(docs, f"file://{tmp_path}/b", file_tokens=2000)
    assert got == want
    assert sorted(map(tuple, dac.round_trip(docs).collect()), key=str) == want


def test_odd_rows(spark, tmp_path):
    df = spark.createDataFrame([(7, None, 1), (3, "", 2), (None, "a b", 3), (-2, "word " * 9000, 4), (5, "same", 4), (5, "same", 4)], "doc_id long, text string, start int")
    got, want = check(df, f"{tmp_path}/c")
    assert got == want
    assert dac.round_trip(df.limit(0)).collect() == []


def test_shards_ascend_and_split_a_common_id():
    rng = np.random.default_rng(2)
    keys = np.sort(np.r_[rng.integers(-50, 50, 500), np.full(400, 7)])
    ties = rng.integers(-(1 << 63), 1 << 63, len(keys), dtype=np.int64)
    order = np.lexsort((ties, keys))
    keys, ties = keys[order], ties[order]
    cuts = keys[[len(keys) * k // 10 for k in range(1, 10)]]
    shard = dac.shard_of(keys, ties, cuts)
    assert (np.diff(shard) >= 0).all() and shard.min() >= 0 and shard.max() <= 9
    assert np.bincount(shard).max() <= 200
    assert dac.shard_of(keys, ties, np.zeros(0, np.int64)).tolist() == [0] * len(keys)


def test_one_id_in_several_shards(spark, tmp_path):
    """A third of all rows have one id, another third none: all are written, in order of id."""
    rows = [(i % 50, f"text {i}") for i in range(60)] + [(7, f"same id {i}") for i in range(60)] + [(None, f"no id {i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bases = dac.write(docs, f"{tmp_path}/a")
    got = sorted(dac.read(spark, f"{tmp_path}/a", bases).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in got]
    assert ids == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:])) and got[-1].start + got[-1].n_tokens == bases[-1]
