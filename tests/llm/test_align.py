"""Alignment of two tokenizations against a plain version by the libraries alone, on odd rows and on the sample table."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pagemill.llm import align
from pagemill.llm.common import table
from pagemill.llm.tokens import BYTE, vocabulary

ODD = [
    (1, "Hello  world\n\n it's 12345\t<|endoftext|> <s> <0x41>"), (2, None), (3, ""), (4, "日本語のテキスト 🙂🙂"), (4, "日本語のテキスト 🙂🙂"), (None, " leading and trailing "),
    (5, "▁ stands for a space"), (6, "\n"), (7, "  "), (8, "x" * 3000 + " " * 300), (9, "﻿bom\x00nul \xa0wide　space"), (10, "ﬁ ligature é"), (11, "the end. " * 40),
]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(vocabulary(BYTE))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=vocabulary(align.PIECE))


def plain(rows, a, b):
    """The rows of align(), by walking both tokenizations of each text byte by byte."""
    a_bytes = align._byte_tokens(vocabulary(BYTE))
    docs, held = [], defaultdict(int)
    for _, text in rows:
        x, y, want = [], [], b" " + (text or "").encode()
        if text:
            x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text, num_threads=1)
            spelt = b"".join(bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y)
            if b"".join(a_bytes[i] for i in x) != want or spelt != want:
                x, y = [], []
        size = lambda i: 1 if b.is_byte(i) else len(b.id_to_piece(i).replace("▁", " ").encode())
        groups, own_a, own_b, at_a, at_b, rest = [], [], [], 0, 0, list(y)
        for i in x:
            own_a.append(i)
            at_a += len(a_bytes[i])
            while rest and at_b + size(rest[0]) <= at_a:
                at_b += size(rest[0])
                own_b.append(rest.pop(0))
            if at_b == at_a:
                groups.append((own_a, own_b))
                own_a, own_b = [], []
        links = Counter((i, j) for g, h in groups for i in g for j in h)
        for link in links:
            held[link] += 1
        docs.append((len(x), len(y), groups, links))
    most = defaultdict(int)
    for (i, _), n in held.items():
        most[i] = max(most[i], n)
    out = []
    for (doc_id, _), (n_a, n_b, groups, links) in zip(rows, docs, strict=True):
        text = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        best = sum(n for link, n in links.items() if held[link] == most[link[0]])
        out.append((doc_id, n_a, n_b, len(groups), sum(links.values()), best, sum(n * held[link] for link, n in links.items()), digest))
    return sorted(out, key=repr)


def found(docs):
    return sorted((tuple(r) for r in align.align(docs).collect()), key=repr)


def test_odd_rows(spark, libraries):
    docs = spark.createDataFrame([(*r, 1, "g", 2) for r in ODD], "doc_id long, text string, batch int, words string, link int")
    got = found(docs)
    assert got == plain(ODD, *libraries)
    assert [r for r in got if r[0] in (2, 3, 5)] == [(i, 0, 0, 0, 0, 0, 0, "") for i in (2, 3, 5)]


def test_sample_table(spark, sf, libraries):
    docs = table(spark, sf, "documents")
    assert found(docs) == plain([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], *libraries)


def test_empty_table(spark):
    assert found(spark.createDataFrame([], "doc_id long, text string")) == []


def test_words_by_parts_are_whole_texts_ids(libraries):
    """Encoding by remembered parts gives the libraries' own ids of the whole text, whatever signs and spaces it holds."""
    a, b = libraries
    r = random.Random(3)
    signs = ["a", "b", " ", "  ", "\n", "\n\n", " \n", "\t", "é", "▁", "<s>", "<0x41>", "<|endoftext|>", "日本", "　", "\r\n", "x1", "'s", ".", "\0", "🙂", "12345", "    ", "\xa0"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(1, 30))) for _ in range(1500)]
    pair = align.Pair(vocabulary(BYTE), vocabulary(align.PIECE))
    sides, docs = pair([t.encode() for t in texts])
    for text, words in zip(texts, docs, strict=True):
        want = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text, num_threads=1)
        got = []
        for n, ids, _ in sides:
            at = n.cumsum() - n
            got.append([i for w in words.tolist() for i in ids[at[w] : at[w] + n[w]].tolist()])
        if len(words):
            assert tuple(got) == want
        else:
            spelt = b"".join(bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in want[1])
            assert spelt != (" " + text).encode()


def test_long_text_takes_time_in_proportion(spark):
    """A text of two million characters in a row of its own."""
    docs = spark.createDataFrame([(1, "thirty or so words that go on and on. " * 50_000)], "doc_id long, text string")
    (row,) = align.align(docs).select("n_a", "n_b", "n_groups", F.col("n_links") >= F.col("n_groups")).collect()
    assert row[0] > 400_000 and row[3]


def test_simple_words_need_no_slow_library(libraries):
    """Words of ASCII signs and Latin letters have the tokenizers library's ids without a call of it."""
    a, b = libraries
    r = random.Random(5)
    signs = [chr(c) for c in [*range(0x21, 0x7F), *range(0xC0, 0x250)]]
    own = [t.decode(errors="ignore").strip() for t in align._byte_tokens(vocabulary(BYTE))]
    words = ["".join(r.choice(signs) for _ in range(r.randint(1, 20))) for _ in range(5000)] + ["".join(r.choice(own) for _ in range(r.randint(1, 5))) for _ in range(5000)]
    words += [r.choice(signs) * r.randint(1, 200) for _ in range(500)]
    words = [w for w in words if align._SIMPLE(w.encode())]
    want = [i for e in a.encode_batch_fast([" " + w for w in words], add_special_tokens=False) for i in e.ids]
    pair = align.Pair(vocabulary(BYTE), vocabulary(align.PIECE))
    pair.a.library = None
    assert pair.a([w.encode() for w in words], len(words))[1].tolist() == want
    (sides, docs), text = pair([b"plain words, no other signs"]), "plain words, no other signs"
    assert [i for w in docs[0].tolist() for i in sides[1][1][sides[1][0][:w].sum() :][: sides[1][0][w]].tolist()] == b.encode(text, num_threads=1)


def test_no_lambda_is_interpreted_per_token(spark):
    """Groups and links are made in bulk: Spark's part is joins and sums of whole columns."""
    made = align.aligned(spark.createDataFrame([(1, "some text")], "doc_id long, text string"))
    plans = [x._jdf.queryExecution().toString() for x in (made, made.groupBy("doc_id").count())]
    assert not any("lambda" in p for p in plans)


def test_portions_do_not_matter(libraries, monkeypatch):
    """Words cut and documents put together a few at a time give the same as all at once."""
    import pyarrow as pa

    texts = [(t or "").encode() for _, t in ODD]
    sides, docs = align.Pair(vocabulary(BYTE), vocabulary(align.PIECE))(texts)
    ids = pa.array([i for i, _ in ODD], pa.int64())
    whole = align._rows(sides, align.Groups(*sides), ids, docs).to_pylist()
    monkeypatch.setattr(align, "WORD_TOKENS", 5)
    groups = align.Groups(*sides)
    linked = [int(groups.n_links[d].sum()) for d in docs]
    parts = align._portions(linked, 7)
    assert len(parts) > 3 and [r for x, y in parts for r in align._rows(sides, groups, ids.slice(x, y - x), docs[x:y]).to_pylist()] == whole
