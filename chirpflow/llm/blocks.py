"""Sums of small arrays over all tasks, brought together in two levels.

A task turns its rows into one block (a few numpy arrays of a size that the model
fixes, never the data). Blocks are added up by about the square root of the number of
tasks first, each of them reading one block at a time, and the driver adds the rest.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Up to so many tasks the driver adds their blocks itself.
DIRECT_TASKS = 16
Block = tuple[np.ndarray, ...]


def _packed(block: Block | None) -> Iterator[pa.RecordBatch]:
    if block is not None:
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block)], pa.binary())], ["block"])


def _added(total: Block | None, block: Block) -> Block:
    return block if total is None else tuple(a + b for a, b in zip(total, block, strict=True))


def sum_blocks(rows: DataFrame, block_of: Callable[[Iterator[pa.RecordBatch]], Block | None], tasks: int | None = None) -> Block | None:
    """The element-wise sum of ``block_of`` over all tasks (None if no task had rows).

    Arrays of Python integers (dtype object) stay exact. ``tasks``: partitions of rows, if known."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _packed(block_of(b for b in batches if b.num_rows))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for data in batch.column(0).to_pylist():
                total = _added(total, pickle.loads(data))
        yield from _packed(total)

    partial = rows.mapInArrow(per_task, "block binary")
    tasks = rows.rdd.getNumPartitions() if tasks is None else tasks
    if tasks > DIRECT_TASKS:
        partial = partial.repartition(int(tasks**0.5)).mapInArrow(merged, "block binary")
    total = None
    for row in partial.collect():
        total = _added(total, pickle.loads(row["block"]))
    return total
