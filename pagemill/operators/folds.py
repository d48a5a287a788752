"""Folds over each key's rows in order, in blocks that run in parallel whatever one key holds.

Rows are range-partitioned and sorted by key and order, so a partition is a run of that
order and only its first key can begin in an earlier one. A block (a key's rows in a
partition) is summed up as a step function from the state before it to the state after
it; only blocks that touch a partition's edge need one. Functions are applied one after
another, a short scan a key, to give every block the state it begins with; then all
blocks fold their own rows at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import kept

State = tuple[int, ...]


@dataclass(frozen=True)
class Fold:
    """``summed(rows)``: the arrays that ``passed(state, arrays, n)`` needs to move a state over n rows at once;
    ``stepped(state, rows)``: (state after, output columns) of rows in order; ``schema``: of those columns."""

    start: State
    columns: list[str]
    summed: Callable[[pd.DataFrame], list[np.ndarray]]
    passed: Callable[[State, list[np.ndarray], int], State]
    stepped: Callable[[State, pd.DataFrame], tuple[State, dict[str, np.ndarray]]]
    schema: str


def _runs(b: pd.DataFrame, key: str) -> Iterator[tuple[tuple, int, int]]:
    """(key, from, to) of the runs of one key in sorted rows; null keys are one key."""
    values, null = b[key].to_numpy(), b[key].isna().to_numpy()
    turn = np.flatnonzero((values[1:] != values[:-1]) & ~(null[1:] & null[:-1])) + 1
    for x, y in zip([0, *turn.tolist()], [*turn.tolist(), len(b)], strict=True):
        if x < y:
            yield (bool(null[x]), None if null[x] else values[x]), x, y


def folded(rows: DataFrame, key: str, order: list[str], fold: Fold) -> DataFrame:
    """``rows`` with the fold's output columns, folded by ``key`` in the order of ``order``.

    Rows equal in key and order lie in one block; null keys are one key; other columns
    stay. What a step function takes is the fold's to bound.
    """
    spread = kept(rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order))
    placed = spread.withColumn("__part", F.spark_partition_id())
    kind, names = dict(rows.dtypes)[key], rows.columns

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The first and the last block of the partition, which others may continue."""
        held: list[pd.DataFrame] = []
        own, first, done = None, True, []

        def block(part: int) -> tuple:
            every = pd.concat(held)
            return every[key].iloc[0], part, first, len(every), [a.tolist() for a in fold.summed(every)]

        part = 0
        for b in batches:
            for k, x, y in _runs(b, key):
                part = int(b["__part"].iloc[0])
                if k != own and held:
                    if first:
                        done.append(block(part))
                    first, held = False, []
                own = k
                held.append(b[[key, *fold.columns]].iloc[x:y])
        if held:
            done.append(block(part))
        yield pd.DataFrame(done, columns=[key, "part", "first", "n", "arrays"])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The state that each partition's first block begins with."""
        own, state = None, fold.start
        for b in batches:
            out = []
            for k, x, y in _runs(b, key):
                state = state if k == own else fold.start
                own = k
                for r in b.iloc[x:y].itertuples(index=False):
                    if r.first:
                        out.append((r.part, list(state)))
                    state = fold.passed(state, [np.array(a, np.int64) for a in r.arrays], r.n)
            yield pd.DataFrame(out, columns=["__part", "__state"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, state = None, fold.start
        for b in batches:
            made = []
            for k, x, y in _runs(b, key):
                if own is None:
                    given = b["__state"].iloc[0]
                    state = fold.start if given is None else tuple(int(v) for v in given)
                elif k != own:
                    state = fold.start
                own = k
                state, out = fold.stepped(state, b.iloc[x:y])
                made.append(out)
            if made:
                yield b[names].assign(**{c: np.concatenate([m[c] for m in made]) for c in made[0]})

    ends = placed.select(key, *fold.columns, "__part").mapInPandas(edges, f"`{key}` {kind}, part int, first boolean, n long, arrays array<array<long>>")
    begun = kept(ends.repartition(key).sortWithinPartitions(key, "part").mapInPandas(scan, "__part int, __state array<long>"))
    with_state = placed.join(F.broadcast(begun), "__part", "left").select(*names, "__state")  # a row a partition
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return with_state.mapInPandas(run, f"{own}, {fold.schema}")
