"""Stretches of time that hold a bounded number of a key's rows, however the rows cluster.

Time is halved again and again in steps of 64: a key's stretch of 19 hours that holds too many rows is cut into
64 of 18 minutes, these into stretches of 17 seconds, and so on down to a single microsecond. The
borders follow from counts alone, so they are the same wherever the rows lie.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import rows_if_bounded

# Lengths of stretches as powers of two in microseconds: from 19 hours to one microsecond.
LENGTHS = (36, 30, 24, 18, 12, 6, 0)
SLICE_ROWS = 250_000


def same(left: DataFrame, right: DataFrame, names: Sequence[tuple[str, str]]) -> Column:
    """Equality of columns of both sides in which null equals null."""
    return reduce(lambda a, b: a & b, [left[a].eqNullSafe(right[b]) for a, b in names])


class TimeSlices:
    """Slices of the time line of every key, of at most ``rows`` points each where times differ at all.

    ``points`` has the keys and a time ``us`` in microseconds. Counting runs one job per length that some key
    fills; a table of cells that are cut further holds at most (points / rows) rows per length.
    """

    def __init__(self, points: DataFrame, keys: Sequence[str], us: str = "_us", rows: int = SLICE_ROWS):
        self.keys, self.us = list(keys), us
        self.cut: list[tuple[int, DataFrame]] = []
        inside = points.select(*self.keys, us)
        for length in LENGTHS[:-1]:
            cells = inside.withColumn("_cell", F.shiftright(us, length)).groupBy(*self.keys, "_cell")
            full = cells.agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows).drop("_n")
            few = rows_if_bounded(full)
            if few is not None and not few:
                break
            full = full if few is None else F.broadcast(full.sparkSession.createDataFrame(few, full.schema))
            self.cut.append((length, full))
            inside = inside.join(self._named(full, len(self.cut)), self._on(inside, length), "left_semi")

    def _named(self, cells: DataFrame, level: int) -> DataFrame:
        names = {k: f"_k{i}" for i, k in enumerate(self.keys)}
        return cells.withColumnsRenamed(names).withColumn(f"_full{level}", F.lit(True))

    def _on(self, df: DataFrame, length: int) -> Column:
        here = [df[k].eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(self.keys)]
        return reduce(lambda a, b: a & b, here, F.shiftright(df[self.us], length) == F.col("_cell"))

    def add(self, df: DataFrame) -> DataFrame:
        """``df`` with ``_slice``, the slice's first microsecond, and ``_slice_end``, the first one after it."""
        out = df
        for level, (length, cells) in enumerate(self.cut, 1):
            out = out.join(self._named(cells, level), self._on(out, length), "left").drop("_cell", *[f"_k{i}" for i in range(len(self.keys))])
        length = F.lit(LENGTHS[len(self.cut)])
        for level in range(len(self.cut), 0, -1):
            length = F.when(F.col(f"_full{level}"), length).otherwise(LENGTHS[level - 1])
        at = F.col(self.us)
        sized = out.withColumn("_size", F.pow(F.lit(2.0), length).cast("bigint"))
        start = at - F.pmod(at, F.col("_size"))
        sliced = sized.withColumn("_slice", start).withColumn("_slice_end", start + F.col("_size"))
        return sliced.select(*df.columns, "_slice", "_slice_end")
