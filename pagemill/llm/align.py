"""Two tokenizations of one text cut into the groups on whose ends both agree.

A worker encodes space+text with a byte-level vocabulary (A) and a piece vocabulary
(B). Both always break before a single space between words, so it encodes the distinct
words of ``SHELF_BYTES`` of text only, cuts them into groups by their common token ends,
in one pass of numpy over all words, and puts each document together from its words: a
row with its numbers, its digest and every id pair that it holds linked, once, with how
often. All else is Spark's: a pair's count is the number of rows that hold it, added up in each
task before they are exchanged, the highest of an A id is joined to it, and the pairs of
all documents meet the counts by broadcast up to ``SMALL_PAIRS`` counted pairs, by shuffle
beyond, and are summed per document.

Simple words (ASCII signs and Latin letters) get their A ids from tiktoken, with ranks
read from the vocabulary's own file, all others from the tokenizers library; where that
file's merges are no ranks, all do.

Defined results: a null or empty text, and one whose A or B tokens do not spell
space+text byte for byte, has no tokens: zeros and an empty digest; every row is a
document, so repeated rows count as often as they occur; null ids are ids like others;
an empty table gives no rows; other columns are ignored, whatever their names. Texts
are read whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import defaultdict
from itertools import chain, count, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, only, texts
from .tokens import BYTE, vocabulary

PIECE = "piece_bpe_32k.model"
#: Id pairs that are sent to every executor, at some 50 bytes each; more are joined by a shuffle.
SMALL_PAIRS = 1 << 20
#: Bytes of text whose distinct words are encoded together, about.
SHELF_BYTES = 4 << 20
#: Tokens of the words that are cut into groups at a time, or those of one word.
WORD_TOKENS = 1 << 19
#: Links, repeats included, of the documents that are put together at a time, or those of one document.
ROW_LINKS = 1 << 19
#: Words in a call of a library.
CALL_WORDS = 4096
#: Bytes of a scratch file's dictionary: its pairs are written as places there, in some 2 bytes.
PAIR_BYTES = 4 << 20
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<long>, times array<int>"


def _byte_tokens(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary file, whose letters stand for bytes: printable ones for themselves, the others in order from U+0100."""
    from tokenizers import Tokenizer

    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    entries = sorted((i, t) for t, i in Tokenizer.from_file(path).get_vocab(with_added_tokens=True).items())
    return [bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for _, t in entries]


def _ranks(path: str, tokens: list[bytes]) -> dict[bytes, int] | None:
    """Ids by bytes, if the vocabulary file's merges go by the ids that they make and its words are those of ``public_tokenizers.PATTERN``; else None."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, own = spec["model"], {t["id"] for t in spec["added_tokens"]}
    made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    split = spec["pre_tokenizer"] or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec["normalizer"] and not model.get("ignore_merges")
    ranked = made == sorted(made) and len({*made}) == len(made) == len(model["vocab"]) - 256
    return {t: i for i, t in enumerate(tokens) if i not in own} if plain and ranked and len(tokens) == len(model["vocab"]) + len(own - {*model["vocab"].values()}) else None


class _Side:
    """One vocabulary: ids of many words at a time, and where their tokens end."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.at = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.spaced = np.array([t[:1] == b" " for t in tokens])

    def whole(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word, with a space before it, by itself."""
        raise NotImplementedError

    def joined(self, words: list[bytes]) -> np.ndarray:
        """Ids of simple words, with a space before each, in a row."""
        raise NotImplementedError

    def __call__(self, words: list[bytes], simple: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(how many ids each word has, all ids, how many bytes each id has); the first ``simple`` words are simple."""
        n, every = [np.empty(0, np.int64)], [np.empty(0, np.int32)]
        for at in range(0, simple, CALL_WORDS):
            own = words[at : min(at + CALL_WORDS, simple)]
            ids = self.joined(own)
            marks = np.flatnonzero(self.spaced[ids])
            if len(marks) == len(own):  # cut before the ids that begin with a space
                n.append(np.diff(marks, append=len(ids)))
                every.append(ids)
            else:
                self._add(self.whole(own), n, every)
        if simple < len(words):
            self._add(self.whole(words[simple:]), n, every)
        ids = np.concatenate(every)
        return np.concatenate(n), ids, self.size[ids]

    @staticmethod
    def _add(found: list[list[int]], n: list[np.ndarray], every: list[np.ndarray]) -> None:
        n.append(np.fromiter(map(len, found), np.int64, len(found)))
        every.append(np.fromiter(chain.from_iterable(found), np.int32))

    def spells(self, ids: np.ndarray, sizes: np.ndarray, text: np.ndarray, step: int = 1 << 18) -> np.ndarray:
        """Of each byte of ``text``, whether the tokens, laid over it in a row, have the same; they are as long."""
        ends, out = np.cumsum(sizes), []
        for k in range(0, len(ids), step):
            n, e = sizes[k : k + step], ends[k : k + step]
            start = int(e[0] - n[0])
            out.append(self.bytes[np.repeat(self.at[ids[k : k + step]] - (e - n), n) + np.arange(start, int(e[-1]))] == text[start : int(e[-1])])
        return np.concatenate(out) if out else np.empty(0, bool)


#: A word of ASCII signs and Latin letters (U+00C0 to U+024F).
_SIMPLE = re.compile(rb"(?:[\x21-\x7e]|\xc3[\x80-\xbf]|[\xc4-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])+").fullmatch
#: Lead bytes of white space beyond ASCII, as in U+0085, U+00A0, U+1680, U+2000 to U+205F, U+3000, and U+2581, which stands for a space.
_WIDE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|\xe2\x96\x81").search


class _Bytes(_Side):
    """The byte-level vocabulary, whose words carry the space before them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(tokens := _byte_tokens(path))
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.fast = None
        if ranks := _ranks(path, tokens):
            import public_tokenizers
            import tiktoken

            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def whole(self, words: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast([" " + w.decode() for w in words], add_special_tokens=False)]

    def joined(self, words: list[bytes]) -> np.ndarray:
        text = (b" " + b" ".join(words)).decode()
        if self.fast:
            return self.fast.encode_to_numpy(text).astype(np.int32)
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)


class _Pieces(_Side):
    """The piece vocabulary, which puts a space before every text.

    Its merges join a run of spaces and what follows, never a word and the space after it.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.library = model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = ((i, model.id_to_piece(i)) for i in range(model.get_piece_size()))
        super().__init__([bytes([int(t[3:5], 16)]) if model.is_byte(i) else t.replace("▁", " ").encode() for i, t in every])

    def whole(self, words: list[bytes]) -> list[list[int]]:
        """A last space is kept by a newline after it, whose id goes again."""
        found = self.library.encode([w.decode() + "\n" for w in words], num_threads=1)
        return [ids[:-1] for ids in found]

    def joined(self, words: list[bytes], step: int = 16) -> np.ndarray:
        """A few words a text, as the time of one grows faster than its length."""
        own = [b" ".join(words[k : k + step]).decode() for k in range(0, len(words), step)]
        return np.fromiter(chain.from_iterable(self.library.encode(own, num_threads=1)), np.int32)


def _cuts(text: bytes) -> np.ndarray:
    """Where the words of space+text begin: at a single space between characters that are none, where both vocabularies break for certain."""
    b = np.frombuffer(text, np.uint8)
    solid = (b > 32) & (b < 127) if _WIDE(text) else (b > 32) & (b != 127)
    at = np.flatnonzero(b[1:-1] == 32) + 1
    return np.r_[0, at[solid[at - 1] & solid[at + 1]]]


def _words(text: bytes) -> list[bytes]:
    """The words of space+text, each without the space that it begins with."""
    spelt = b" " + text
    cut = _cuts(spelt)
    if len(cut) - 1 == text.count(b" "):
        return text.split(b" ")
    return [spelt[x + 1 : y] for x, y in pairwise([*cut.tolist(), len(spelt)])]


class Pair:
    """Both vocabularies of a worker."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = _Bytes(a_path), _Pieces(b_path)

    def __call__(self, texts: list[bytes]) -> tuple[list[tuple[np.ndarray, ...]], list[np.ndarray]]:
        """Of the distinct words (how many ids, ids, ends) of each side, and each text's words by number; none where it has no tokens."""
        number: defaultdict[bytes, int] = defaultdict(count().__next__)
        docs = [np.fromiter(map(number.__getitem__, _words(t) if t else []), np.int32) for t in texts]
        simple = np.fromiter((_SIMPLE(w) is not None for w in number), bool, len(number))
        order = np.argsort(~simple, kind="stable")  # simple ones first
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        docs, words = [place[d] for d in docs], list(number)
        words = [words[i] for i in order.tolist()]
        joined = np.frombuffer(b"".join([b" " + w for w in words]), np.uint8)
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        sides, good = [], np.ones(len(words), bool)
        for side in (self.a, self.b):
            n, ids, sizes = side(words, int(simple.sum()))
            first, upto = np.cumsum(n) - n, np.r_[0, np.cumsum(sizes)]
            good &= upto[first + n] - upto[first] == lengths
            begin = np.repeat(upto[first], n)
            sides.append((n, ids, (upto[1:] - begin).astype(np.int32), sizes))
        for side, (n, ids, _, sizes) in zip((self.a, self.b), sides, strict=True):
            held = np.repeat(good, n)
            own = np.repeat(good, lengths)
            same = side.spells(ids[held], sizes[held], joined[own])
            wrong = np.r_[0, np.cumsum(~same)]
            start = np.cumsum(np.where(good, lengths, 0)) - np.where(good, lengths, 0)
            good &= wrong[np.minimum(start + lengths, len(same))] == wrong[np.minimum(start, len(same))]
        # words that are not spelt have no ids, as the texts that hold them
        made = [(np.where(good, n, 0), ids[np.repeat(good, n)], ends[np.repeat(good, n)]) for n, ids, ends, _ in sides]
        return made, [d if good[d].all() else d[:0] for d in docs]


def _lists(n: np.ndarray, values: np.ndarray | pa.Array) -> pa.Array:
    """Lists of so many values each."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(values))


def _spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of lists of so many members each: every member's list, and its place there."""
    return np.repeat(np.arange(len(n)), n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def _portions(weights: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Cuts of a row of weights into stretches of about ``most`` together, or one heavier member."""
    upto = np.cumsum(weights)
    return list(pairwise([0, *(np.flatnonzero(np.diff(upto // most)) + 1).tolist(), len(weights)]))


def _grouped(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of some words: the text of each one's groups, their number, the number of its links; and all links, as places in their distinct codes."""
    n, ids = [s[0] for s in (a, b)], [s[1] for s in (a, b)]
    length = np.zeros(len(n[0]), np.int64)
    length[n[0] > 0] = a[2][(np.cumsum(n[0]) - 1)[n[0] > 0]]
    base = np.cumsum(length) - length
    ends = [s[2] + np.repeat(base, s[0]) for s in (a, b)]  # of all words in a row; both agree at a word's end
    met = np.searchsorted(ends[1], ends[0])
    common = np.flatnonzero(ends[1][met] == ends[0])
    last = [common, met[common]]
    size = [np.diff(x, prepend=-1) for x in last]
    a_text, b_text = (pc.binary_join(_lists(k, pa.array(i).cast(pa.string())), ",") for k, i in zip(size, ids, strict=True))
    own = np.bincount(np.repeat(np.arange(len(n[0])), n[0])[common], minlength=len(n[0]))
    text = pc.binary_join(_lists(own, pc.binary_join_element_wise(a_text, b_text, "|")), ";").cast(pa.binary()).to_pylist()
    linked = size[0] * size[1]
    group, place = _spread(linked)
    first = [x - k + 1 for x, k in zip(last, size, strict=True)]
    a_ids = ids[0][first[0][group] + place // size[1][group]].astype(np.int64)
    codes, link = np.unique(a_ids << 32 | ids[1][first[1][group] + place % size[1][group]], return_inverse=True)
    upto, groups = np.r_[0, np.cumsum(linked)], np.r_[0, np.cumsum(own)]
    return text, own, np.diff(upto[groups]), codes, link.astype(np.int32)


class Groups:
    """The groups of each word: ``text`` (``a1,a2|b1;a3|b2,b3``), ``n``, and its links, every A token of a group with every B
    token of it: ``n_links``, from ``at`` on, as places ``link`` in ``codes``, which are the A id times 2^32 plus the B id."""

    def __init__(self, a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]):
        upto = [np.r_[0, np.cumsum(s[0])] for s in (a, b)]
        some = lambda x, y: ((s[0][x:y], *(v[u[x] : u[y]] for v in s[1:])) for s, u in zip((a, b), upto, strict=True))
        text, n, n_links, codes, link = zip(*(_grouped(*some(x, y)) for x, y in _portions(a[0] + b[0], WORD_TOKENS)), strict=True)
        self.text, self.n, self.n_links = list(chain.from_iterable(text)), np.concatenate(n), np.concatenate(n_links)
        self.codes = np.unique(np.concatenate(codes))
        self.link = np.concatenate([np.searchsorted(self.codes, c).astype(np.int32)[i] for c, i in zip(codes, link, strict=True)])
        self.at = np.cumsum(self.n_links) - self.n_links


def _rows(sides: list[tuple[np.ndarray, ...]], groups: Groups, ids: pa.Array, docs: list[np.ndarray]) -> pa.RecordBatch:
    """A row of ALIGNED for each document."""
    words = np.concatenate(docs)
    doc, _ = _spread(np.fromiter(map(len, docs), np.int64, len(docs)))
    counts = [np.bincount(doc, n[words], len(docs)).astype(np.int64) for n in (*(s[0] for s in sides), groups.n, groups.n_links)]
    word, place = _spread(groups.n_links[words])
    keys = np.sort(doc[word] * len(groups.codes) + groups.link[groups.at[words][word] + place])
    start = np.flatnonzero(np.diff(keys, prepend=-1))
    owner, link = np.divmod(keys[start], max(1, len(groups.codes)))
    held = np.bincount(owner, minlength=len(docs))
    text = groups.text.__getitem__
    digests = [hashlib.sha256(b";".join(map(text, d.tolist()))).hexdigest() if len(d) else "" for d in docs]
    times = np.diff(start, append=len(keys)).astype(np.int32)
    return pa.RecordBatch.from_arrays([ids, *map(pa.array, counts), pa.array(digests, pa.string()), _lists(held, groups.codes[link]), _lists(held, times)], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "times"])


def aligned(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """ALIGNED, with ``row``, a number: a row a document; ``links``, the id pairs that it holds linked, ascending, each as the A id times 2^32 plus the B id, and ``times``, how often."""
    a_path, b_path = a_path or vocabulary(BYTE), b_path or vocabulary(PIECE)

    def shelves(batches):
        """(ids, texts) of about SHELF_BYTES each."""
        ids, every, size = [], [], 0
        for batch in batches:
            own = batch.column(1).cast(pa.binary()).to_pylist()
            weights = np.fromiter(map(len, own), np.int64, len(own)) + 100  # a text without words takes room too
            for x, y in _portions(weights, SHELF_BYTES):
                ids.append(batch.column(0).slice(x, y - x))
                every += own[x:y]
                size += int(weights[x:y].sum())
                if size >= SHELF_BYTES:
                    yield pa.concat_arrays(ids), every
                    ids, every, size = [], [], 0
        if every:
            yield pa.concat_arrays(ids), every

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        pair = only(("pair", a_path, b_path), lambda: Pair(a_path, b_path))
        for ids, own in shelves(batches):
            sides, words = pair(own)
            groups = Groups(*sides)
            linked = np.fromiter((int(groups.n_links[w].sum()) for w in words), np.int64, len(words))
            for x, y in _portions(linked, ROW_LINKS):
                yield _rows(sides, groups, ids.slice(x, y - x), words[x:y])

    rows = texts(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ALIGNED)
    return rows.withColumn("row", F.monotonically_increasing_id())


def pair_counts(made: DataFrame) -> DataFrame:
    """(link, n_docs, best): documents that hold each linked id pair, and whether that is the most of its A id."""
    counts = durable(made.select(F.explode("links").alias("link")).groupBy("link").agg(F.count("*").alias("n_docs")))
    a_id = F.shiftright("link", 32)
    most = counts.groupBy(a_id.alias("a_id")).agg(F.max("n_docs").alias("most"))
    return counts.join(most, a_id == F.col("a_id")).select("link", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def align(docs: DataFrame) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of ``docs``."""
    made = durable(aligned(docs), **{"parquet.dictionary.page.size": str(PAIR_BYTES)})
    counts = durable(pair_counts(made))
    counts = F.broadcast(counts) if counts.count() <= SMALL_PAIRS else counts
    each = made.select("row", F.inline(F.arrays_zip("links", "times"))).withColumnRenamed("links", "link")
    sums = each.join(counts, "link").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n_docs") * F.col("times")).alias("count_sum"))
    own = made.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    zero = (F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum"))
    return own.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")
