"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import shared_dir

# Texts of one slice are split into words together; a slice holds at most this many bytes (or one text) and rows.
SLICE_BYTES, SLICE_ROWS = 4 << 20, 512


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet below the cluster's shared folder and read it back.

    Cuts the lineage without losing column pruning, and survives the loss of any executor.
    """
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` of at most ``rows`` rows whose texts hold at most ``limit`` bytes together (or a single row)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        done = int(ends[start - 1]) if start else 0
        stop = max(start + 1, min(start + rows, int(np.searchsorted(ends, done + limit, side="right"))))
        yield batch.slice(start, stop - start)
        start = stop


def with_judgement(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    keep: tuple[str, ...],
    added: dict[str, str],
    make: Callable[[], Callable[[list[str | None]], list[pa.Array]]],
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """The id, the columns in ``keep`` and the columns ``added`` (names and types), in one narrow pass.

    Each task calls ``make()`` for a function from the texts of a slice to the added columns. A text column
    in ``keep`` is sent to the task once and given back as it came.
    """
    carried = [id_col, *keep]
    kinds = dict(docs.dtypes)
    once = text_col in carried and kinds[text_col] == "string"
    at = carried.index(text_col) if once else len(carried)
    names = [*(f"c{i}" for i in range(len(carried))), *(f"a{i}" for i in range(len(added)))]
    columns = [F.col(c).alias(f"c{i}") for i, c in enumerate(carried)]
    if not once:
        columns.append(F.col(text_col).cast("string").alias("text"))
    schema = ", ".join(f"{n} {k}" for n, k in zip(names, [*(kinds[c] for c in carried), *added.values()], strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = make()
        for batch in batches:
            for rows in text_slices(batch, at, rows=slice_rows):
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(carried)], *judge(rows.column(at).to_pylist())], names=names)

    return docs.select(*columns).mapInArrow(run, schema).toDF(*carried, *added)


def per_worker(name: str, content: str, make: Callable[[str], object]):
    """``make(content)``, kept as long as the Python worker lives, so that later tasks find what it has cached."""
    kept = sys.__dict__.get(f"_ledgerloom_{name}")
    if kept is None or kept[0] != content:
        kept = (content, make(content))
        setattr(sys, f"_ledgerloom_{name}", kept)
    return kept[1]


def lower_latin(column):
    """``column`` with A-Z, and nothing else, in lower case."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def least_hashes(rows: DataFrame, group: str, bounds: dict[object, int]) -> DataFrame:
    """Of distinct (group, mark) rows, the ``bounds[group]`` with the least mark, a 64-bit hash that spreads evenly.

    Groups are counted first, so that only about twice the bound of a group has to be ranked.
    """
    totals = {r[0]: r[1] for r in rows.groupBy(group).count().collect()}
    picked = [(g, n, min(0, -(1 << 63) + (1 << 64) * (2 * n + 64) // totals[g]) if 2 * n + 64 < totals[g] // 2 else (1 << 63) - 1)
              for g, n in bounds.items() if totals.get(g)]
    if not picked:
        return rows.limit(0)
    likely = F.coalesce(*(F.when(F.col(group) == g, F.col("mark") <= F.lit(cut)) for g, _, cut in picked), F.lit(False))
    bound = F.coalesce(*(F.when(F.col(group) == g, n) for g, n, _ in picked))
    place = F.row_number().over(Window.partitionBy(group).orderBy("mark"))
    return rows.where(likely).withColumn("place", place).where(F.col("place") <= bound).drop("place")


def labelled_sample(
    docs: DataFrame, labels: DataFrame, train: Column, rows: dict[int, int] | int, id_col: str, text_col: str, label_col: str
) -> DataFrame:
    """At most ``rows[label]`` distinct texts per label, as (label, mark, text): those with the least hash of the text.

    A plain number bounds the texts of both labels together. ``train`` is a condition on the label table's
    id. Copies of a text are one row, whatever their ids, so the choice does not depend on partitions or on
    how often an id occurs. Null texts count as empty; null ids and labels other than 0 and 1 are left out.
    """
    named = labels.where(train & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    named = named.select(F.col(id_col).alias("doc"), F.col(label_col).cast("int").alias("label")).distinct()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).alias("doc"), text.alias("text")).withColumn("mark", F.xxhash64("text"))
    marks = texts.select("doc", "mark").where("doc IS NOT NULL").distinct().join(named, "doc")
    marks = marks.groupBy("label", "mark").agg(F.min("doc").alias("doc"))
    if isinstance(rows, dict):
        chosen = least_hashes(marks, "label", rows)
    else:
        chosen = marks.orderBy("mark", "label").limit(rows)
    # The broadcast side holds one row per chosen text.
    return texts.join(F.broadcast(chosen), ["doc", "mark"]).groupBy("label", "mark").agg(F.min("text").alias("text"))
