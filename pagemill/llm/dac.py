"""Token ids in binary files of directly addressable codes.

An id is split into chunks of 8 bits, least first. Level 0 has a byte for every id;
a continuation bitmap marks the ids that go on, and level k + 1 has a byte for each
of those. A rank directory (ones before every 512 bits) finds the place on the next
level in constant time, so any token of a file is read without decoding others.

Files: shard ``p`` holds the p-th range of document ids; a shard that grows past
``FILE_TOKENS`` goes on in a further file. Each is written under a private name and
renamed when whole, so a task that runs twice, or is lost half way, leaves the same
files. They are written through pyarrow, to the stores whose addresses it knows (file,
hdfs, s3, gs; not s3a), and read back through Spark's binary source.
Texts are encoded where they lie; only their ids are dealt out by document id, as
16-bit numbers where they fit.

Layout, little-endian: magic ``DAC1``; unsigned 64-bit shard, ids before this file in
its shard, documents, ids, levels; document ids (signed 64-bit, and a byte each that
is 1 where it is null); ids before each document and at the end (unsigned 64-bit);
then for each level its length (unsigned 64-bit), its bytes, and below the last level
its bitmap in bytes and its rank directory (unsigned 64-bit).

Defined results: a null or empty text is its end id alone; null document ids come
first; repeated ids are ordered by a hash of their texts; an empty table gives no files and no rows.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, scratch_dir, texts
from .tokens import BYTE, encoder, vocabulary

FILE_TOKENS = 1 << 21
RANK_BITS = 512
_HEAD = struct.Struct("<4s5Q")


def encode_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bytes, continuation flags) of each level of unsigned 32-bit ids."""
    levels, rest = [], ids
    while True:
        more = rest > 255
        levels.append(((rest & 255).astype(np.uint8), more))
        if not more.any():
            return levels
        rest = rest[more] >> 8


def to_parts(shard: int, before: int, doc_ids: list[int | None], starts: np.ndarray, ids: np.ndarray) -> Iterator[bytes]:
    """One file, part by part, of documents that begin at ``starts`` (and end at its last entry)."""
    levels = encode_levels(ids)
    yield _HEAD.pack(b"DAC1", shard, before, len(doc_ids), len(ids), len(levels))
    yield np.array([x or 0 for x in doc_ids], "<i8").tobytes() + bytes(x is None for x in doc_ids) + starts.astype("<u8").tobytes()
    for k, (chunk, more) in enumerate(levels):
        yield struct.pack("<Q", len(chunk)) + chunk.tobytes()
        if k + 1 < len(levels):
            ranks = np.r_[0, np.cumsum(np.add.reduceat(more, np.arange(0, len(more), RANK_BITS), dtype=np.int64))[:-1]]
            yield np.packbits(more, bitorder="little").tobytes() + ranks.astype("<u8").tobytes()


class Reader:
    """A file's documents and ids; ``token(i)`` reads one id in place."""

    def __init__(self, data: bytes | memoryview):
        magic, self.shard, self.before, n, self.n_tokens, n_levels = _HEAD.unpack_from(data)
        if magic != b"DAC1":
            raise ValueError("not a DAC1 file")
        at = _HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, kind, count, at)
            at += found.nbytes
            return found

        ids, null = take("<i8", n), take("u1", n)
        self.doc_ids = [None if x else i for i, x in zip(ids.tolist(), null.tolist(), strict=True)]
        self.starts = take("<u8", n + 1).astype(np.int64)
        self.levels = []
        for k in range(n_levels):
            size = int(take("<u8", 1)[0])
            chunk = take("u1", size)
            last = k + 1 == n_levels
            self.levels.append((chunk, None if last else take("u1", (size + 7) // 8), None if last else take("<u8", -(-size // RANK_BITS))))

    def token(self, i: int) -> int:
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = 0
        for k, (chunk, more, ranks) in enumerate(self.levels):
            value |= int(chunk[i]) << 8 * k
            if more is None or not more[i >> 3] >> (i & 7) & 1:
                return value
            block = i // RANK_BITS * (RANK_BITS // 8)
            full = int.from_bytes(more[block : (i >> 3) + 1].tobytes(), "little") & (1 << (i - block * 8)) - 1
            i = int(ranks[i // RANK_BITS]) + full.bit_count()
        return value

    def ids(self) -> np.ndarray:
        """All ids at once."""
        value: np.ndarray = np.zeros(0, np.uint32)
        for chunk, more, _ in reversed(self.levels):
            own = chunk.astype(np.uint32)
            if more is not None:
                own[np.unpackbits(more, count=len(chunk), bitorder="little").astype(bool)] |= value << 8
            value = own
        return value


def _store(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder if urlparse(folder).scheme else f"file://{os.path.abspath(folder)}")


def narrow(ids: bytes) -> bytes:
    """Little-endian unsigned 32-bit ids as numbers of 2 bytes where they fit, after a byte that tells their size."""
    wide = np.frombuffer(ids, "<u4")
    return b"\4" + ids if len(wide) and wide.max() > 0xFFFF else b"\2" + wide.astype("<u2").tobytes()


def widened(data: bytes) -> np.ndarray:
    """The ids in what ``narrow`` made."""
    return np.frombuffer(data, f"<u{data[0]}", offset=1)


#: What stands for a null id where ranges are cut: nulls come first.
_NULL = -(1 << 63)


def _cuts(docs: DataFrame, shards: int) -> np.ndarray:
    """Document ids that part the rows into about equal shards; one that many rows have occurs several times."""
    if shards < 2:
        return np.zeros(0, np.int64)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL))
    found = docs.agg(F.percentile_approx(key, [k / shards for k in range(1, shards)], max(10_000, 20 * shards))).first()[0]
    return np.array(found or [], np.int64)


def shard_of(keys: np.ndarray, ties: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The shard of each row, ascending in (key, tie); rows of a key that is cut more than once are spread by their ties."""
    low, high = np.searchsorted(cuts, keys, "left"), np.searchsorted(cuts, keys, "right")
    place = (ties.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)
    return low + (place * (high - low + 1).astype(np.uint64) >> np.uint64(32)).astype(np.int64)


def encoded(docs: DataFrame, path: str, end: int, cuts: np.ndarray) -> DataFrame:
    """(shard, doc_id, tie, ids) of every row: a hash of the text, and its ids and ``end`` as ``narrow`` has them."""

    def run(batches):
        encode, last = encoder(path), np.array([end], "<u4").tobytes()
        for b in batches:
            doc = b.column(0).cast(pa.int64())
            shard = shard_of(doc.fill_null(_NULL).to_numpy(), b.column(1).to_numpy(), cuts)
            ids = [narrow(x + last) for x in encode(b.column(2).cast(pa.binary()).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), doc, b.column(1), pa.array(ids, pa.binary())], names=["shard", "doc_id", "tie", "ids"])

    rows = texts(docs).select("doc_id", F.xxhash64("text").alias("tie"), "text")
    return rows.mapInArrow(run, "shard int, doc_id long, tie long, ids binary")


def write(docs: DataFrame, folder: str, path: str | None = None, end: int = 0, file_tokens: int = FILE_TOKENS) -> list[int]:
    """Encode and write ``docs`` under ``folder`` in ascending document id; ids before each shard.

    Ranges of ids are cut at quantiles of the ids; rows of one id may fall into several
    ranges, in order of their texts' hash. The driver receives one row a shard.
    """
    path, spark = path or vocabulary(BYTE), docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = encoded(docs, path, end, _cuts(docs, shards)).repartitionById(shards, "shard").sortWithinPartitions("shard", "doc_id", "tie").select("shard", "doc_id", "ids")
    fs, at = _store(folder)
    fs.create_dir(at, recursive=True)

    def run(batches):
        release()
        fs, at = _store(folder)
        held, names, size, before, files, own = [], [], 0, 0, 0, -1

        def close():
            nonlocal held, names, size, before, files
            starts = np.r_[0, np.cumsum([len(x) for x in held])]
            name = f"{at}/shard-{own:06d}-{files:06d}.dac"
            private = f"{at}/_{uuid.uuid4().hex}"
            with fs.open_output_stream(private) as f:
                for data in to_parts(own, before, names, starts, np.concatenate(held)):
                    f.write(data)
            fs.move(private, name)
            held, names, size, before, files = [], [], 0, before + size, files + 1

        totals = []
        for b in batches:
            for shard, doc, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if held and (shard != own or size >= file_tokens):
                    close()
                if shard != own:
                    totals.append((own, before))
                    own, before, files = shard, 0, 0
                held.append(widened(data))
                names.append(doc)
                size += len(held[-1])
        if held:
            close()
        totals = [*totals, (own, before)][1:]
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in totals], pa.int64()), pa.array([n for _, n in totals], pa.int64())], names=["shard", "n"])

    totals = dict(dealt.mapInArrow(run, "shard long, n long").collect())
    return np.r_[0, np.cumsum([totals.get(i, 0) for i in range(shards)])].tolist()


def read(spark, folder: str, bases: list[int]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files under ``folder``.

    ``bases`` (a number for each shard) come from ``write``.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.dac").load(folder).select("content")

    def run(batches):
        release()
        for b in batches:
            for data in b.column(0):
                r = Reader(memoryview(data.as_buffer()))
                raw, cut = memoryview(r.ids().astype("<u4", copy=False).view(np.uint8)), (r.starts * 4).tolist()
                crc = [zlib.crc32(raw[i:j]) for i, j in zip(cut, cut[1:], strict=False)]
                start = r.starts + (bases[r.shard] + r.before)
                yield pa.RecordBatch.from_arrays([pa.array(r.doc_ids, pa.int64()), pa.array(start[:-1]), pa.array(np.diff(r.starts)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``docs``, then read what the files hold."""
    folder = folder or scratch_dir(docs.sparkSession)
    bases = write(docs, folder)
    return read(docs.sparkSession, folder, bases)
