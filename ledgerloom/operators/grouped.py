"""Vectorised passes over sorted groups.

``groupBy(..).applyInPandas`` pays a fixed price per group, which dominates when groups are many
and small. Here a task gets its groups sorted in Arrow batches and handles all complete groups of a
batch in one call; only the group that is still open at the end of a batch is carried over.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def group_starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Positions at which a row's keys differ from those of the row before, beginning with 0."""
    n = table.num_rows
    if n == 0:
        return np.empty(0, dtype=np.int64)
    changed = np.zeros(n, dtype=bool)
    changed[0] = True
    for k in keys:
        column = table.column(k)
        now, before = column.slice(1), column.slice(0, n - 1)
        unequal = pc.fill_null(pc.not_equal(now, before), False).to_numpy(zero_copy_only=False)
        one_null = pc.xor(pc.is_null(now), pc.is_null(before)).to_numpy(zero_copy_only=False)
        changed[1:] |= unequal | one_null
    return np.flatnonzero(changed)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches as tables of complete groups, with the position of each group's first row."""
    pending: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        # Rows up to the last key change are complete; the rest may go on in the next batch.
        joint = pa.Table.from_batches([pending[-1].slice(pending[-1].num_rows - 1), batch]) if pending else None
        if joint is not None and len(group_starts(joint, keys)) == 1:
            pending.append(batch)
            continue
        whole = pa.Table.from_batches([*pending, batch]).combine_chunks()
        starts = group_starts(whole, keys)
        cut = int(starts[-1])
        if cut:
            yield whole.slice(0, cut), starts[:-1]
        pending = whole.slice(cut).to_batches()
    if pending:
        whole = pa.Table.from_batches(pending).combine_chunks()
        yield whole, group_starts(whole, keys)


def sorted_groups(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    fn: Callable[[pa.Table, np.ndarray], pa.Table],
    schema: T.StructType,
) -> DataFrame:
    """Run ``fn(rows, starts)`` over whole groups of ``keys``, rows sorted by ``order`` within a group.

    ``starts`` holds the position of each group's first row. One shuffle on the keys; adaptive
    execution may merge small partitions of it but never splits one, so groups stay whole.
    """
    keys = list(keys)
    placed = df.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(batches, keys):
            yield from fn(rows, starts).to_batches()

    return placed.mapInArrow(run, schema)
