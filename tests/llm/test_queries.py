"""The registered queries, as the driver runs them: columns, types, digests, odd rows, empty tables."""

import hashlib
import zlib

import pytest

import corpus_pipeline
from pagemill.llm import pii
from pagemill.llm.queries import QUERIES

FIXED = {
    "op1_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op2_license_scan": {"doc_id": "bigint", "digest": "string", "license_id": "string", "notice_ids": "string"},
    "op3_pii": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op4_token_counts": {"length": "bigint", "n_docs": "bigint", "total_tokens": "bigint"},
    "op5_best_fit_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op6_context_tree": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op7_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op8_decontamination": {"doc_id": "bigint", "item_id": "bigint", "score": "double"},
    "op9_token_files": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op10_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op11_token_alignment": {"doc_id": "bigint", "n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint", "n_best": "bigint", "count_sum": "bigint", "groups_sha256": "string"},
    "op12_hard_negatives": {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"},
    "op13_line_dedup": {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": "string"},
}
#: Those with a row for every document.
EACH = ["op1_simhash", "op2_license_scan", "op3_pii", "op6_context_tree", "op7_toxicity", "op9_token_files", "op10_quality_rules", "op11_token_alignment", "op13_line_dedup"]
LONG = " ".join(f"word{i}" + "." * (i % 9 == 8) for i in range(400))
ROWS = [(1, LONG), (2, LONG), (2, None), (3, ""), (4, " \t\n"), (None, "write to a@b.co or call +49 30 1234567 now, it is urgent my friend"), (5, "x " * 30_000), (6, LONG.replace("word200", "other")), (7, "What is the capital of Atlantis? The capital is Poseidonis."), (7, "What is the capital of Atlantis? The capital is Poseidonis.")]
CLASH = ", row string, mark int, node long, words int, size int, key string, f0 long, shard int, tie int, n_chars int, lang string, source string"


def tables(spark, folder, rows):
    docs = spark.createDataFrame([(*r, "r", 1, 2, 3, 4, "k", 5, 6, 7, len(r[1] or ""), "en", "web") for r in rows], "doc_id long, text string" + CLASH)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 0, 0), (None, 1, 1), (6, 1, 1), (6, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "What is the capital of Atlantis? The capital is Poseidonis."), (None, "Nobody asks this."), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    vectors = [(i, [0.1 * (i % 7), 0.5], i % 3, "x", 1) for i in range(0, 210, 10)] + [(None, [1.0], 1, "x", 1), (5, None, 1, "x", 1), (6, [None], 1, "x", 1)] if rows else []
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int, own string, block int").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("odd"), ROWS)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("empty"), [])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_and_odd_rows(spark, odd, name):
    df = QUERIES[name](spark, odd)
    assert FIXED[name].items() <= dict(df.dtypes).items()
    rows = df.collect()
    if name in EACH:
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(d) for d, _ in ROWS)
    if name == "op1_simhash":
        assert {(r.doc_id, r.component_id) for r in rows} >= {(1, 1), (2, 1), (2, 2), (3, 2), (4, 2), (7, 7)}
    if name == "op3_pii":
        for r in rows:
            text = next(t or "" for d, t in ROWS if d == r.doc_id)
            spans = ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in pii.base_spans(text)[k])
            assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
    if name == "op8_decontamination":
        assert sorted((r.doc_id, r.item_id) for r in rows) == [(7, 1), (7, 1)]
    if name == "op9_token_files":
        assert [r.doc_id for r in sorted(rows, key=lambda r: r.start)] == [None, 1, 2, 2, 3, 4, 5, 6, 7, 7]
        assert {r.ids_crc32 for r in rows if r.doc_id == 3} == {zlib.crc32(bytes(4))}
    if name == "op4_token_counts":
        assert sum(r.n_docs for r in rows) == len(ROWS)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_table(spark, empty, name):
    df = QUERIES[name](spark, empty)
    assert FIXED[name].items() <= dict(df.dtypes).items()
    assert df.collect() == []


def test_pipeline_of_odd_and_empty_tables(spark, odd, empty):
    rows = corpus_pipeline.run(spark, odd).collect()
    assert {r.doc_id for r in rows} == {1, None}  # junk, copies and the benchmark's item are gone
    assert corpus_pipeline.run(spark, empty).collect() == []
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, odd).dtypes == docs.dtypes
