import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pagemill.llm import tokens

ODD = ["", " ", "\n", "a", " a", "a ", "a  b", "a\n\nb", "a \nb", "a\n b", "a\tb\r\nc", "it's 'tis don't I'LL 12345 a1b2", "É́té ́x", "ΣΑΣ ΟΔΟΣ. ΣΣ", "a b   c　d", "x\x1cy \x1d z\x00w", "<|endoftext|> a<|startoftext|>b", "ﬁ № İstanbul ǅ", "!! ?? a!b", "日本 語。 テスト", "🙂 🙂‍🙂", "a\x85b"]


@pytest.mark.parametrize("name", [tokens.WORD, tokens.BYTE])
def test_equals_the_library(name):
    plain = Tokenizer.from_file(tokens.vocabulary(name))
    plain.encode_special_tokens = True
    enc = tokens.Encoder(tokens.vocabulary(name), name == tokens.WORD)

    def same(texts):
        got = [np.frombuffer(x, "<u4").tolist() for x in enc([t.encode() for t in texts])]
        assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]

    same(ODD)
    same(ODD)

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'aAsSé́.1  Σ"), st.characters(exclude_categories=["Cs"])), max_size=30), max_size=3))
    def many(texts):
        same(texts)

    many()


@pytest.mark.parametrize("name", [tokens.WORD, tokens.BYTE])
def test_many_random_texts(name):
    rng = random.Random(1)
    texts = ["".join(rng.choice(" \n\t'aAsSé́.1  Σ!bc") for _ in range(rng.randint(0, 30))) for _ in range(8000)]
    texts += ["x" * 100 + " " + "y" * 17 + " " + "z" * 16, "", "a\nb c\nd"]
    plain = Tokenizer.from_file(tokens.vocabulary(name))
    plain.encode_special_tokens = True
    enc = tokens.Encoder(tokens.vocabulary(name), name == tokens.WORD)
    for part in (texts[:4000], texts[4000:], texts[:50], [], [""]):
        want = [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch(part, add_special_tokens=False)]
        assert enc([t.encode() for t in part]) == want


def test_documents_and_a_full_cache(spark, sf, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_BYTES", 50_000)
    monkeypatch.setattr(tokens, "SLOTS_BITS", 9)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for name in (tokens.WORD, tokens.BYTE):
        plain = Tokenizer.from_file(tokens.vocabulary(name))
        enc = tokens.Encoder(tokens.vocabulary(name), name == tokens.WORD)
        for at in range(0, len(texts), 50):
            part = texts[at : at + 50]
            assert [np.frombuffer(x, "<u4").tolist() for x in enc([t.encode() for t in part])] == [plain.encode(t, add_special_tokens=False).ids for t in part]
        assert 0 <= enc.room < 2 * tokens.ENTRY_BYTES and len(enc.known) > 100
