from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagemill.llm import histogram
from pagemill.llm.tokens import BYTE, vocabulary


def test_equals_brute_force(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.union(docs.limit(7)).union(spark.createDataFrame([(None, None), (1, "")], "doc_id long, text string"))
    plain = Tokenizer.from_file(vocabulary(BYTE))
    n = sorted(len(plain.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect())
    sums = histogram.token_counts(docs.withColumn("length", F.lit("x"))).cache()
    rows = sums.collect()
    assert sorted(r.length for r in rows) == sorted(set(n))
    for r in rows:
        longer = [x for x in n if x >= r.length]
        assert (r.n_docs, r.docs_from, r.tokens_from) == (n.count(r.length), len(longer), sum(longer))
        assert (r.total_docs, r.total_tokens) == (len(n), sum(n))
        assert r.truncated_tokens == sum(min(x, r.length) for x in n)
        assert abs(r.quantile - sum(x <= r.length for x in n) / len(n)) < 1e-12
    for r in histogram.at_limits(sums, [0, 1, 100, 513, 10**7]).collect():
        assert r.truncated_tokens == sum(min(x, r.context_limit) for x in n)
        assert r.docs_over == sum(x > r.context_limit for x in n)
    for q in (0.0, 0.25, 0.5, 0.9, 1.0):
        assert histogram.quantile(sums, q) == n[max(0, -int(-q * len(n) // 1) - 1)]
    assert histogram.token_counts(docs.limit(0)).collect() == []
