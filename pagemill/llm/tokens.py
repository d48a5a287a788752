"""Whole-text encoding with the public tokenizers, word by word through a cache.

Both vocabularies break a text into words before any merge, so the ids of a text are
those of its words in a row. Text is cut at places where such a break is certain;
each distinct piece is encoded once by the tokenizers library and then looked up.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from itertools import compress, count
from operator import not_

import numpy as np

from .common import only

#: Vocabulary files by kind; the folder is a parameter of the environment's package.
WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"
#: Bytes that a worker's dictionary of pieces may take; pieces beyond are encoded again in each portion of texts.
CACHE_BYTES = 64 << 20
#: What an entry takes besides its piece and ids.
ENTRY_BYTES = 200
#: Slots (of 23 bytes, and the ids) of the table of short pieces that is looked up for many pieces at once.
SLOTS_BITS = 22
#: Bytes of texts that are encoded at a time, and pieces that are looked up at a time: each takes some 100 bytes meanwhile.
PORTION_BYTES, PIECES = 1 << 20, 1 << 17
#: Pieces that the library encodes in one call, which holds about 1 kB for each.
ENCODED = 1024


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Marks that end a word are a break of their own after a letter or a digit.
MARKS = b".,;:!?"


_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


class _Short:
    """Pieces of at most 16 bytes and their ids, for many pieces of one buffer at a time.

    A piece is its length and two words of 8 bytes, so equal keys are equal pieces.
    Every piece has one slot; where another holds it, or a piece is longer, the
    lookup says so and the caller's dictionary answers.
    """

    def __init__(self, bits: int):
        self.bits, size = bits, 1 << bits
        self.a, self.b = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.length, self.n, self.at = np.zeros(size, np.uint8), np.zeros(size, np.uint16), np.zeros(size, np.uint32)
        self.pool, self.used = np.zeros(1 << 20, np.uint32), 0

    def keys(self, data: bytes, starts: np.ndarray, lengths: np.ndarray):
        """(first word, second word, slot); ``data`` has 16 bytes to spare."""
        words = np.ndarray(len(data) - 8, "<u8", data, strides=(1,))
        first = words[starts] & _MASK[np.minimum(lengths, 8)]
        second = words[starts + 8] & _MASK[np.clip(lengths - 8, 0, 8)]
        h = (first * np.uint64(0x9E3779B97F4A7C15) ^ second * np.uint64(0xC2B2AE3D27D4EB4F) ^ lengths.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        return first, second, (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, data: bytes, starts: np.ndarray, lengths: np.ndarray):
        """(found, slot) of each piece."""
        first, second, slot = self.keys(data, starts, lengths)
        return (self.length[slot] == lengths) & (self.a[slot] == first) & (self.b[slot] == second) & (lengths <= 16), slot

    def add(self, pieces: dict[bytes, bytes]) -> set[bytes]:
        """Keep short pieces whose slots are free; those kept."""
        short = [p for p in pieces if len(p) <= 16]
        if not short:
            return set()
        data = b"".join(short) + bytes(24)
        lengths = np.fromiter(map(len, short), np.int64, len(short))
        first, second, slot = self.keys(data, np.cumsum(lengths) - lengths, lengths)
        slot, own = np.unique(slot, return_index=True)
        free = self.length[slot] == 0
        slot, own = slot[free], own[free]
        kept = [short[i] for i in own.tolist()]
        ids = [pieces[p] for p in kept]
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        total = int(n.sum())
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint32)])
        if total:
            self.pool[self.used : self.used + total] = np.frombuffer(b"".join(ids), np.uint32)
        self.at[slot], self.n[slot] = self.used + np.cumsum(n) - n, n
        self.a[slot], self.b[slot], self.length[slot] = first[own], second[own], lengths[own]
        self.used += total
        return set(kept)


class Encoder:
    """Texts to little-endian unsigned 32-bit ids, as the tokenizer file ``path`` gives them.

    ``lean``: with a quarter of the slots and less of a dictionary, where a worker's memory counts for more than its time.
    """

    def __init__(self, path: str, lower_words: bool, lean: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        #: The id of a newline, where the vocabulary has one that no word joins.
        self.newline = None if lower_words else self.library.token_to_id("Ċ")
        self.known: dict[bytes, bytes] = {}
        self.room = CACHE_BYTES * 3 // 4 if lean else CACHE_BYTES
        self.short = _Short(SLOTS_BITS - 2 if lean else SLOTS_BITS)
        #: Pieces that may hold white space after their first character.
        self.odd: set[bytes] = {b"\n"}

    #: Where a byte-level text can be cut for certain: before a single space between words.
    _BREAK = re.compile(r"(?<=\S)(?= \S)")

    def _is_plain(self, text: bytes) -> bool:
        """Lines of words with one space between: every word but a line's first carries its space, newlines stand alone."""
        if self.newline is None:
            return True
        wide = not text.isascii() and self._wide_space(text)
        return bool(text) and not (wide or b"  " in text or b"\n\n" in text or b" \n" in text or b"\n " in text or self._odd(text))

    _SIMPLE = staticmethod(re.compile(rb" ?[!-~]+").fullmatch)

    def _spaced(self, text: bytes) -> bytes:
        """Ids of a text whose white space is not plain, cut where a break is certain all the same."""
        pieces = [x.encode() for x in self._BREAK.split(text.decode())]
        self.odd.update(x for x in pieces if not self._SIMPLE(x))
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        return self._gathered(text, np.r_[0, ends[:-1]], ends)[1]

    @staticmethod
    def _odd(text: bytes) -> bool:
        """White space at either end, or any beside spaces and newlines, or a zero byte."""
        return text[0] in b" \n" or text[-1] in b" \n" or len(text.translate(None, b"\0\t\r\x0b\x0c\x1c\x1d\x1e\x1f")) != len(text)

    #: Lead bytes of white space beyond ASCII: U+0085, U+00A0, U+1680, U+2000 to U+205F, U+3000.
    _wide_space = staticmethod(re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80").search)

    def _lines(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids of the pieces that have white space at most before them: encoded as lines of one text, which is cut at its newlines."""
        out: dict[bytes, bytes] = {}
        plain = [p for p in pieces if p not in self.odd]
        for at in range(0, len(plain), 4096):
            part = plain[at : at + 4096]
            ids = array("I", self.library.encode_batch_fast([b"\n".join([*part, b""]).decode()], add_special_tokens=False)[0].ids)
            marks = np.flatnonzero(np.frombuffer(ids, np.uint32) == self.newline)
            cut, data = (marks * 4).tolist(), ids.tobytes()
            out.update(zip(part, (data[a:b] for a, b in zip([0, *(x + 4 for x in cut)], cut, strict=False)), strict=True))
        return out

    def _encode(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids of pieces that are not known, words and the marks after them apart."""
        known, marked, need, out = self.known, {}, set(), {}
        for p in pieces:
            if p[-1] in MARKS and p not in self.odd:
                core = p.rstrip(MARKS)
                if core and (core[-1:].isalnum() or core[-1] > 127 and core.decode()[-1].isalnum()):
                    marked[p] = core
                    need.add(core)
                    need.add(p[len(core) :])
                    continue
            need.add(p)
        new = list(need.difference(known))
        fresh = self._lines(new) if self.newline is not None else {}
        rest = [x for x in new if x not in fresh]
        for at in range(0, len(rest), ENCODED):
            part = rest[at : at + ENCODED]
            found = self.library.encode_batch_fast([x.decode() for x in part], add_special_tokens=False)
            fresh |= {x: array("I", e.ids).tobytes() for x, e in zip(part, found, strict=True)}
        for p, core in marked.items():
            mark = p[len(core) :]
            out[p] = (known.get(core) or fresh[core]) + (known.get(mark) or fresh[mark])
        for p in need & known.keys():
            out[p] = known[p]
        return fresh | out

    def _bounds(self, buffer: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ends) of the pieces of plain texts that lie between newline bytes at ``edges``."""
        if self.newline is None:
            space = (buffer == 32) | (buffer >= 9) & (buffer <= 13)
            turn = np.flatnonzero(space[1:] != space[:-1]) + 1
            return turn[::2], turn[1::2]  # the buffer begins and ends with a newline
        line = np.flatnonzero(buffer == 10)
        starts = np.sort(np.concatenate([np.flatnonzero(buffer == 32), line, line[:-1] + 1]))
        ends = np.r_[starts[1:], len(buffer)]
        own = np.ones(len(starts), bool)
        own[np.searchsorted(starts, edges)] = False
        return starts[own], ends[own]

    def _plain(self, texts: list[bytes]) -> list[bytes]:
        """Ids of plain texts, all at once."""
        if not texts:
            return []
        joined = b"\n" + b"\n".join(texts) + b"\n"
        joined = joined.lower() if self.newline is None else joined
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        edges = np.r_[0, np.cumsum(sizes + 1)]  # the newlines around the texts
        starts, ends = self._bounds(np.frombuffer(joined, np.uint8), edges)
        n, every = self._gathered(joined, starts, ends)
        cut = np.r_[0, np.cumsum(n)][np.searchsorted(starts, edges)] * 4
        return [every[a:b] for a, b in zip(cut.tolist(), cut[1:].tolist(), strict=False)]

    def _gathered(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, bytes]:
        """How many ids each piece of ``data`` has, and all of them in a row."""
        data += bytes(24)
        parts = [self._found(data, starts[at : at + PIECES], ends[at : at + PIECES]) for at in range(0, len(starts), PIECES)]
        return np.concatenate([np.zeros(0, np.int64), *(n for n, _ in parts)]), b"".join(ids for _, ids in parts)

    def _found(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, bytes]:
        """As ``_gathered``, of as many pieces as are looked up at a time."""
        lengths = ends - starts
        found, slot = self.short.find(data, starts, lengths)
        rest = np.flatnonzero(~found)
        pieces = [data[a:b] for a, b in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)]
        own, n, at = self.short.n[slot[found]].astype(np.int64), np.empty(len(starts), np.int64), self.short.at[slot[found]].astype(np.int64)
        upto = np.cumsum(own)
        short = self.short.pool[np.repeat(at - (upto - own), own) + np.arange(int(upto[-1]) if len(upto) else 0)]
        if not pieces:
            return own, short.tobytes()
        ids = self._looked_up(pieces)
        n[found], n[rest] = own, np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        out, of_short = np.empty(int(n.sum()), np.uint32), np.repeat(found, n)
        out[of_short], out[~of_short] = short, np.frombuffer(b"".join(ids), np.uint32)
        return n, out.tobytes()

    def _looked_up(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces by the dictionary; new ones are encoded and remembered while there is room."""
        known = self.known
        ids = list(map(known.get, pieces))
        gaps = list(compress(count(), map(not_, ids)))  # no piece has no ids
        if gaps:
            fresh = self._encode(list({pieces[i] for i in gaps}))
            for i in gaps:
                ids[i] = fresh[pieces[i]]
            self._remember(fresh)
        return ids

    def _remember(self, fresh: dict[bytes, bytes]) -> None:
        """Keep new pieces: in the table of short ones, else in the dictionary while there is room."""
        for p in fresh.keys() - self.short.add(fresh):
            if self.room < ENTRY_BYTES:
                break
            size = len(p) + len(fresh[p]) + ENTRY_BYTES
            if size <= self.room and p not in self.known:
                self.known[p] = fresh[p]
                self.room -= size

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        for part in _portions(texts):
            plain = [self._is_plain(t) for t in part]
            done = iter(self._plain(list(compress(part, plain))))
            out += [next(done) if ok else self._spaced(t) if t else b"" for t, ok in zip(part, plain, strict=True)]
            if len(self.odd) * ENTRY_BYTES > CACHE_BYTES:
                self.odd = {b"\n"}
        return out


def _portions(texts: list[bytes]) -> Iterator[list[bytes]]:
    """``texts`` in runs of about PORTION_BYTES; a text is not parted."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= PORTION_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def encoder(path: str, lean: bool = False) -> Encoder:
    """A worker's encoder of a file."""
    return only(("encoder", path, lean), lambda: Encoder(path, os.path.basename(path) == WORD, lean))
