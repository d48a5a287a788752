"""Benchmark decontamination by BM25 retrieval with block-max WAND.

Test items, cut to at most ``PART`` words, form an inverted index whose weights are
BM25's divided by what the part would score against itself, so one threshold fits
short and long items. Every passage (overlapping windows) of every document is a
query for all parts that score at least ``THRESHOLD``; a part of at most ``PART``
words lies whole in some window. Posting lists are cut into blocks with their
maximum; WAND moves to the first part whose lists' maxima reach the threshold and
skips blocks whose own maxima do not. Before that, a bound over each part's rarest
words tells which windows can reach it at all. Retrieved pairs are then verified:
the five-word shingles of the question and the words of the answer that occur. A long
question, or an indexed part, that is held nearly whole is enough without the answer.

An item without a marked answer is split at its last sentence. Index statistics are
those of all items; a benchmark beyond ``INDEX_BYTES`` is indexed in several groups,
each sent to the tasks in turn.

Defined results: null or empty texts and items match nothing; repeated rows each
give their pairs, repeated items one; a null id, of a document or an item, stays null; empty tables give no rows.
"""

from __future__ import annotations

import re
from array import array
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .alike import shingles
from .common import durable, texts

PART, WINDOW, STRIDE = 64, 128, 64
THRESHOLD = 0.5
#: Postings of a block.
BLOCK = 32
#: Bytes of item text in one index, which takes about ten times as many where it is used.
INDEX_BYTES = 8 << 20
#: Words of a shingle that verifies.
SHINGLE = 5
#: Share of the question's shingles, and of the answer's distinct words, that a document must hold.
QUESTION, ANSWER = 0.5, 0.5
#: Share of the shingles of a question, or of an indexed part, of at least LONG words that is enough without the answer.
ALONE, LONG = 0.8, 13
K1, B = 1.2, 0.75
_CUT = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_CUT).split()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The words before the last sentence, and those in it; of one sentence, its halves."""
    parts = [w for x in re.split(r"(?<=[.!?])\s+|\n+", text) if (w := words_of(x))]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    every = parts[0] if parts else []
    return every[: (len(every) + 1) // 2], every[(len(every) + 1) // 2 :]


class Stats:
    """Parts, their words, and the parts that hold each word, over all items."""

    def __init__(self):
        self.df: dict[bytes, int] = defaultdict(int)
        self.parts = self.words = 0

    def add(self, items: list[str]) -> None:
        for text in items:
            words = words_of(text)
            self.words += len(words)
            for at in range(0, len(words), PART):
                self.parts += 1
                for w in set(words[at : at + PART]):
                    self.df[w] += 1


def _packed(kind: str, values: np.ndarray) -> array:
    """A flat array whose items are read as plain numbers."""
    out = array(kind)
    out.frombytes(np.ascontiguousarray(values, kind).tobytes())
    return out


def _starts(of: np.ndarray, n: int) -> np.ndarray:
    """Where the rows 0 to n - 1 of the sorted ``of`` begin, and the end."""
    return np.searchsorted(of, np.arange(n + 1))


class Index:
    """Parts of items: postings by word, block maxima, and the words a match must hold.

    All lists are slices of flat arrays; words are numbers, shingles 64-bit hashes.
    Besides the words themselves that takes some 60 bytes for each word of an item.
    """

    def __init__(self, items: list[tuple[int | None, str]], threshold: float = THRESHOLD, stats: Stats | None = None):
        self.threshold = threshold
        texts = [(i, t, w) for i, t in items if (w := words_of(t))]
        self.ids = [i for i, _, _ in texts]
        if stats is None:
            stats = Stats()
            stats.add([t for _, t, _ in texts])
        self.rows: dict[bytes, int] = {}
        numbers = [np.array([self.rows.setdefault(x, len(self.rows)) for x in w], np.int64) for _, _, w in texts]
        n_parts = np.array([-(-len(w) // PART) for w in numbers], np.int64)
        self.item_of = _packed("q", np.repeat(np.arange(len(texts)), n_parts))
        first = np.cumsum(n_parts) - n_parts
        self._weigh(numbers, first, int(n_parts.sum()), stats)
        self._verify(texts, numbers)

    def _weigh(self, numbers: list[np.ndarray], first: np.ndarray, n_parts: int, stats: Stats) -> None:
        size = len(self.rows)
        part = np.concatenate([np.zeros(0, np.int64), *(f + np.arange(len(w)) // PART for f, w in zip(first, numbers, strict=True))])
        keys, tf = np.unique(part * max(1, size) + np.concatenate([np.zeros(0, np.int64), *numbers]), return_counts=True)
        part, row = keys // max(1, size), keys % max(1, size)
        df = np.array([stats.df[w] for w in self.rows], float)
        length = np.bincount(part, tf, n_parts)
        norm = K1 * (1 - B + B * length / (stats.words / max(1, stats.parts)))
        raw = np.log((stats.parts + 1) / df[row]) * tf * (K1 + 1) / (tf + norm[part])
        weight = raw / np.bincount(part, raw, n_parts)[part]
        # the commonest words of a part that together stay below half of the threshold; the others are its anchors
        order = np.lexsort((row, -df[row], part))
        upto = np.cumsum(weight[order])
        begin = _starts(part[order], n_parts)
        upto -= np.r_[0, upto][begin[part[order]]]
        common = np.zeros(len(order), bool)
        common[order] = upto < self.threshold / 2
        self.rest = _packed("d", np.bincount(part[common], weight[common], n_parts))
        by = np.lexsort((part, row))
        part, row, weight, common = part[by], row[by], weight[by], common[by]
        start = _starts(row, size)
        self.start, self.part, self.weight = _packed("q", start), _packed("i", part), _packed("d", weight)
        own = ~common
        self.anchor_start, self.anchor_part, self.anchor_weight = _packed("q", _starts(row[own], size)), _packed("i", part[own]), _packed("d", weight[own])
        n_blocks = -(-np.diff(start) // BLOCK)
        block_start = np.r_[0, np.cumsum(n_blocks)]
        at = start[:-1].repeat(n_blocks) + (np.arange(int(block_start[-1])) - block_start[:-1].repeat(n_blocks)) * BLOCK
        some = len(at) > 0
        self.top = _packed("d", np.maximum.reduceat(weight, start[:-1]) if some else np.zeros(0))
        self.block_start = _packed("q", block_start)
        self.block_top = _packed("d", np.maximum.reduceat(weight, at) if some else np.zeros(0))
        self.block_last = _packed("i", part[np.r_[at[1:], len(part)] - 1] if some else np.zeros(0))

    def _verify(self, texts: list[tuple[int | None, str, list[bytes]]], numbers: list[np.ndarray]) -> None:
        """What a retrieved pair is held against: hashes of shingles of questions and of parts, and words of answers."""
        questions, answers, widths, parts = [], [], [], []
        for (_, text, words), own in zip(texts, numbers, strict=True):
            question, answer = question_and_answer(text)
            questions.append(shingles(question, SHINGLE))
            widths.append(min(SHINGLE, len(question)))
            answers.append(np.unique(np.array([self.rows[w] for w in answer], np.int64)))
            for at in range(0, len(own), PART):
                parts.append(shingles(words[at : at + PART], SHINGLE) if len(own) - at >= LONG else np.zeros(0, np.uint64))
        flat = lambda x, kind: (np.concatenate([np.zeros(0, kind), *x]), np.r_[0, np.cumsum([len(v) for v in x])].astype(np.int64))
        self.question, self.question_at = flat(questions, np.uint64)
        self.part_shingles, self.part_at = flat(parts, np.uint64)
        self.answer, self.answer_at = flat(answers, np.int64)
        self.width = widths

    def postings(self, word: bytes) -> list[tuple[int, float]]:
        """(part, weight) of a word."""
        r = self.rows.get(word)
        return [] if r is None else [(self.part[p], self.weight[p]) for p in range(self.start[r], self.start[r + 1])]

    def windows(self, rows: list[int | None]) -> set[int]:
        """The windows in which some part could reach the threshold, by its anchors and its rest."""
        begin, anchor, weight = self.anchor_start, self.anchor_part, self.anchor_weight
        hits = [(i, r) for i, r in enumerate(rows) if r is not None and begin[r] < begin[r + 1]]
        if not hits:
            return set()
        last = max(0, -(-(len(rows) - WINDOW) // STRIDE))
        reach: dict[tuple[int, int], float] = defaultdict(float)
        seen = set()
        for i, r in hits:
            for w in range(max(0, -(-(i - WINDOW + 1) // STRIDE)), min(last, i // STRIDE) + 1):
                if (w, r) not in seen:
                    seen.add((w, r))
                    for p in range(begin[r], begin[r + 1]):
                        reach[w, anchor[p]] += weight[p]
        need = self.threshold - 1e-9
        return {w for (w, n), x in reach.items() if x + self.rest[n] >= need}

    def search(self, rows: set[int]) -> list[tuple[int, float]]:
        """All (part, score) with a score of at least the threshold, by block-max WAND."""
        start, part, weight = self.start, self.part, self.weight
        block_start, block_last, block_top = self.block_start, self.block_last, self.block_top
        lists = [[start[r], start[r + 1], r] for r in rows]  # place, end, word
        found, need, top = [], self.threshold - 1e-9, self.top
        while lists:
            lists.sort(key=lambda x: part[x[0]])
            bound, pivot = 0.0, -1
            for k, (_, _, r) in enumerate(lists):
                bound += top[r]
                if bound >= need:
                    pivot = k
                    break
            if pivot < 0:
                break
            at = part[lists[pivot][0]]
            while pivot + 1 < len(lists) and part[lists[pivot + 1][0]] == at:
                pivot += 1
            bound, skip = 0.0, 1 << 62
            for p, _, r in lists[: pivot + 1]:
                b = block_start[r] + (p - start[r]) // BLOCK
                while b < block_start[r + 1] and block_last[b] < at:
                    b += 1
                if b < block_start[r + 1]:
                    bound += block_top[b]
                    skip = min(skip, block_last[b] + 1)
            if bound < need:  # no part before the nearest block end can reach the threshold
                if pivot + 1 < len(lists):
                    skip = min(skip, part[lists[pivot + 1][0]])
                target = max(skip, at + 1)
                moved = lists[: pivot + 1]
            elif part[lists[0][0]] == at:
                score = sum(weight[p] for p, _, _ in lists[: pivot + 1])
                if score >= need:
                    found.append((at, score))
                target, moved = at + 1, lists[: pivot + 1]
            else:
                target, moved = at, lists[:pivot]
            for x in moved:
                p, end, _ = x
                while p < end and part[p] < target:
                    p += 1
                x[0] = p
            lists = [x for x in lists if x[0] < x[1]]
        return found

    def held(self, part: int, of: np.ndarray) -> bool:
        """Whether the shingles of an indexed part are, nearly all, those of a document."""
        own = self.part_shingles[self.part_at[part] : self.part_at[part + 1]]
        return len(own) > 0 and _share(own, of) >= ALONE

    def matches(self, text: str | None) -> list[tuple[int | None, float, float, float]]:
        """(item id, best score, share of the question, share of the answer) of the verified items."""
        words = words_of(text)
        rows = list(map(self.rows.get, words))
        best: dict[int, float] = {}
        found: dict[int, set[int]] = defaultdict(set)
        for w in self.windows(rows):
            for part, score in self.search(set(rows[w * STRIDE : w * STRIDE + WINDOW]) - {None}):
                item = self.item_of[part]
                best[item] = max(best.get(item, 0.0), score)
                found[item].add(part)
        if not best:
            return []
        held, own = shingles(words, SHINGLE), np.unique(np.array([r for r in rows if r is not None], np.int64))
        out = []
        for item, score in sorted(best.items()):
            q = self.question[self.question_at[item] : self.question_at[item + 1]]
            a = self.answer[self.answer_at[item] : self.answer_at[item + 1]]
            in_q = _share(q, held if self.width[item] in (0, SHINGLE) else shingles(words, self.width[item]))
            in_a = _share(a, own)
            alone = in_q >= ALONE and len(q) > LONG - SHINGLE or any(self.held(part, held) for part in found[item])
            if in_q >= QUESTION and in_a >= ANSWER or alone:
                out.append((self.ids[item], score, in_q, in_a))
        return out


def _share(own: np.ndarray, of: np.ndarray) -> float:
    """The share of the distinct values ``own`` that are in ``of``; of none, all."""
    return float(np.isin(own, of, assume_unique=True).mean()) if len(own) else 1.0


def _indexes(benchmark: DataFrame):
    """Indexes over all items, each of about INDEX_BYTES of text; the driver holds the items of one at a time."""
    items = benchmark.where("text is not null").select("item_id", "text").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-size // INDEX_BYTES))

    def group(g: int) -> list[tuple[int | None, str]]:
        part = items if groups == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g)
        return sorted(((r.item_id, r.text) for r in part.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))

    stats = None
    if groups > 1:
        stats = Stats()
        for g in range(groups):
            stats.add([t for _, t in group(g)])
    for g in range(groups):
        yield groups > 1, Index(group(g), stats=stats)


_PAIR = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): verified pairs of rows of ``docs`` and items."""
    return reduce(DataFrame.union, [_pairs(docs, *x) for x in _indexes(benchmark)])


def _pairs(docs: DataFrame, several: bool, index: Index) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        own = sent.value
        for b in batches:
            rows = [(doc, *m) for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for m in own.matches(t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 2 + [pa.float64()] * 3, strict=True)], names=[x.split()[0] for x in _PAIR.split(", ")])

    found = texts(docs).mapInArrow(run, _PAIR)
    return _done(found, sent) if several else found


def _done(df: DataFrame, sent) -> DataFrame:
    """Written, so that one of several indexes can go before the next is made."""
    out = durable(df)
    sent.destroy()
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no item; decided row by row, nothing is shuffled."""
    for several, index in _indexes(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        @F.arrow_udf("boolean")
        def free(text, sent=sent):
            return pa.array([not sent.value.matches(t) for t in text.to_pylist()], pa.bool_())

        docs = docs.where(free(F.coalesce("text", F.lit(""))))
        docs = _done(docs, sent) if several else docs
    return docs
