"""Work in order along a key: rows are dealt out by key, sorted, and passed through Arrow a slice at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE = 4_096


def _cut(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    columns = [np.array(batch.column(k).to_pylist(), dtype=object) for k in keys]
    new = np.zeros(max(0, batch.num_rows - 1), bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield tuple(c[a] for c in columns), batch.slice(a, b - a)


def _joined(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches of one schema as larger ones: each costs Spark about as much as hundreds of rows."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in found:
        if held and (n + batch.num_rows > SLICE or not batch.schema.equals(held[0].schema)):
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
        held.append(batch)
        n += batch.num_rows
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def in_order(rows: DataFrame, keys: list[str], order: list[str], work: Callable[[tuple, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``work`` on each key's rows in order: it gets the key and the rows' slices, and holds only what it must remember of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = (x for b in batches for at in range(0, b.num_rows, SLICE) for x in _cut(b.slice(at, SLICE), keys))
        for key, own in groupby(slices, key=lambda x: x[0]):
            rest = (part for _, part in own)
            yield from work(key, rest)
            for _ in rest:  # whatever it left unread
                pass

    return rows.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order).mapInArrow(lambda batches: _joined(run(batches)), schema)
