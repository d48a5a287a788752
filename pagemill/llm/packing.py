"""Best-fit packing of token sequences with a bounded number of open bins.

Each task packs its own stream online: a piece goes to the open bin it fills best,
found in a bitset keyed by free space; when no open bin has room and all are in use,
the fullest closes. Bins still open at the end of a stream are not given up: the
pieces in them form the stream of a later round with far fewer tasks, until one task
is left. Only round one reads texts; its output is written to the shared folder.

Defined results: a null or empty text is its end id alone; repeated rows are packed
as often as they occur; an empty table gives no rows; other columns are ignored. A
null id stays null.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, release, texts, trim
from .tokens import WORD, encoder, vocabulary

LENGTH = 4096
#: Bins that a task holds open.
OPEN = 256
#: Pieces of open bins that one task of a later round takes.
ROUND = 200_000
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, open boolean"


def pack(pieces: Iterable[tuple[int, object]], length: int = LENGTH, most: int = OPEN) -> Iterator[tuple[list[tuple[object, int]], bool]]:
    """Bins of (item, offset) from a stream of (size, item), and whether the stream ended with the bin open.

    Sizes are 1 to ``length``. ``room`` has bit f set while an open bin has f free.
    """
    free: dict[int, list[list]] = {}
    room, count = 0, 0
    for size, item in pieces:
        fits = room >> size
        if fits:
            f = size + (fits & -fits).bit_length() - 1
            held = free[f]
            b = held.pop()
            if not held:
                room ^= 1 << f
            b.append((item, length - f))
        else:
            if count == most:  # the fullest closes
                f = (room & -room).bit_length() - 1
                held = free[f]
                yield held.pop(), False
                count -= 1
                if not held:
                    room ^= 1 << f
            f, b = length, [(item, 0)]
            count += 1
        f -= size
        if not f:
            yield b, False
            count -= 1
            continue
        room |= 1 << f
        free.setdefault(f, []).append(b)
    for f in sorted(free):
        for b in free[f]:
            yield b, True


def _rows(bins, number: int):
    """Arrow batches of packed pieces; sequence ids carry the round, the task and the bin."""
    base = (number << 24) + TaskContext.get().partitionId() << 32
    out: list[tuple] = []
    for n, (b, still_open) in enumerate(bins):
        out.extend((*item, base + n, offset, still_open) for item, offset in b)
        if len(out) >= 20_000:
            yield _batch(out)
            out = []
    if out:
        yield _batch(out)


_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=names)


def _encoded(batches, path: str, length: int, end: int) -> Iterator[tuple[int, tuple]]:
    encode, last = encoder(path, lean=True), np.array([end], "<u4").tobytes()
    for b in batches:
        for doc, ids in zip(b.column(0).to_pylist(), encode(b.column(1).cast(pa.binary()).to_pylist()), strict=True):
            ids += last
            for piece, at in enumerate(range(0, len(ids), 4 * length)):
                part = ids[at : at + 4 * length]
                yield len(part) // 4, (doc, piece, at // 4, len(part) // 4, zlib.crc32(part))
        trim()


def packed(docs: DataFrame, length: int = LENGTH, most: int = OPEN, path: str | None = None, end: int = 1, per_round: int = ROUND) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    path = path or vocabulary(WORD)

    def first(batches):
        return _rows(pack(_encoded(batches, path, length, end), length, most), 0)

    done = durable(texts(docs).mapInArrow(first, SCHEMA))
    closed, left, tasks = [done.where("not open")], done.where("open"), 1 << 40
    for number in range(1, 128):
        n = left.count()
        if not n:
            break
        tasks = max(1, min(-(-n // per_round), tasks // 2))  # fewer each round, whatever the pieces are

        def again(batches, number=number, final=tasks == 1):
            release()
            items = ((r["length"], tuple(r.values())[:5]) for b in batches for r in b.to_pylist())
            bins = pack(items, length, most)
            return _rows(((b, still_open and not final) for b, still_open in bins), number)

        # longest first where one task's share allows it: best fit then wastes least
        dealt = left.drop("sequence_id", "offset", "open").repartition(tasks).sortWithinPartitions(F.desc("length"))
        done = durable(dealt.mapInArrow(again, SCHEMA))
        closed.append(done.where("not open"))
        left = done.where("open")
        if tasks == 1:
            break
    out = closed[0]
    for part in closed[1:]:
        out = out.unionByName(part)
    return out.drop("open")
