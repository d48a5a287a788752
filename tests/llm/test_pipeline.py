from collections import defaultdict

import corpus_pipeline
from pagemill.llm import decontam, pii, quality, simhash
from pagemill.llm.common import durable, table
from tests.llm.plain import shingles


def test_stages_take_effect(spark, sf):
    """Each stage on its own input, against what its operator says of that input."""
    docs = table(spark, sf, "documents")
    bench = table(spark, sf, "benchmark")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = durable(stage(spark, docs, sf))
        assert out.dtypes == docs.dtypes
        before, after = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in out.collect()}
        if name == "quality_rules":
            keep = {r.doc_id for r in quality.score(docs).where("kept").collect()}
        elif name == "simhash_near_dedup":
            groups = defaultdict(set)
            for r in simhash.similar_groups(docs).collect():
                groups[r.component_id].add(r.doc_id)
            keep = {min(g) for g in groups.values()}
            held = {i: shingles(decontam.words_of(r.text)) for i, r in before.items()}
            alike = lambda i, j: len(held[i] & held[j]) / len(held[i] | held[j])
            ids = sorted(before)
            assert all(any(alike(i, j) >= 0.4 for j in ids if j != i) for i in set(before) - set(after))
            assert not [(i, j) for i in after for j in after if i < j and alike(i, j) >= 0.9]
        elif name == "benchmark_decontamination":
            keep = set(before) - {r.doc_id for r in decontam.contaminated(docs, bench).collect()}
        else:
            keep, model = set(before), pii.trained()
            for i in keep:
                assert not pii.find(after[i].text, model)[1]
                assert after[i].text == pii.redacted(before[i].text, model) and after[i].n_chars == len(after[i].text)
        assert set(after) == keep
        if name != "pii":
            assert all(after[i] == before[i] for i in keep)
            assert len(keep) < len(before)
        docs = out
    packed = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
    used = defaultdict(int)
    for r in packed:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 4096
