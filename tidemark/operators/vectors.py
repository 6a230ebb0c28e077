"""Sums of vector-valued functions of rows by key: one exchange, no row expansion.

A task turns each batch into a matrix of values, adds it up by key and hands on one row for each (key, position); these
partial sums are the only thing shuffled.  Rows are never repeated over the positions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS_AT_ONCE = 4096
CELLS_AT_ONCE = 1 << 20


def vector_sums(df: DataFrame, by: Sequence[str], inputs: Sequence[str], values: Callable[..., np.ndarray], positions: int) -> DataFrame:
    """(by, step, total, rows): sums over each key's rows of ``values(*inputs)``, which gives a row of ``positions`` numbers
    for each row; ``rows`` is their count.

    ``inputs`` are numeric columns without nulls.  Null keys are equal to each other.  A task holds the sums of at most
    ``KEYS_AT_ONCE`` keys and hands them on when there are more.
    """
    keys, n = list(by), len(by)
    sent = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in inputs])
    at_once = max(1, CELLS_AT_ONCE // positions)

    def rows_of(sums: dict[tuple, tuple[np.ndarray, int]]) -> pa.RecordBatch:
        named = [pa.array([k[i] for k in sums for _ in range(positions)], sent_types[i]) for i in range(n)]
        steps = pa.array(np.tile(np.arange(positions, dtype=np.int32), len(sums)))
        totals = pa.array(np.concatenate([s for s, _ in sums.values()]))
        counts = pa.array(np.repeat(np.array([c for _, c in sums.values()], np.int64), positions))
        return pa.RecordBatch.from_arrays([*named, steps, totals, counts], [*keys, "step", "total", "rows"])

    sent_types: list[pa.DataType] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, tuple[np.ndarray, int]] = {}
        for arrived in batches:
            sent_types[:] = [c.type for c in arrived.columns[:n]]
            for lo in range(0, arrived.num_rows, at_once):
                batch = arrived.slice(lo, at_once)
                names = list(zip(*[c.to_pylist() for c in batch.columns[:n]])) if n else [()] * batch.num_rows
                place: dict[tuple, int] = {}
                code = np.fromiter((place.setdefault(k, len(place)) for k in names), np.int64, len(names))
                found = values(*[c.to_numpy(zero_copy_only=False) for c in batch.columns[n:]])
                order = np.argsort(code, kind="stable")
                starts = np.flatnonzero(np.diff(code[order], prepend=-1))
                totals, counts = np.add.reduceat(found[order], starts, axis=0), np.bincount(code)
                for k, i in place.items():
                    total, count = sums.get(k, (0.0, 0))
                    sums[k] = total + totals[i], count + int(counts[i])
                if len(sums) > KEYS_AT_ONCE:
                    yield rows_of(sums)
                    sums = {}
        if sums:
            yield rows_of(sums)

    kinds = ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys], "step int, total double, rows long"])
    return sent.mapInArrow(run, kinds).groupBy(*keys, "step").agg(F.sum("total").alias("total"), F.sum("rows").alias("rows"))
