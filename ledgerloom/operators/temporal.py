"""Joins in time: the value visible at a moment, and points within intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.slices import SLICE_ROWS, TimeSlices
from ledgerloom.session import rows_if_bounded

# An interval is covered by cells of at most this share of its length, a power of two.
COVER_BITS = 3


def latest_at(reads: DataFrame, writes: DataFrame, keys: Sequence[str], slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``reads`` with ``_w`` of the last write of the same keys at or before each read, null without one.

    Both sides have the keys and ``_us``, microseconds; writes are ordered by ``_us`` and ``_w``, a struct. One sort
    over both sides, in slices of at most ``slice_rows`` rows of a key: a key with a long log or a burst spreads over
    its slices, and what earlier slices left behind comes from a table with one row per key and slice.
    """
    keys = list(keys)
    log = writes.dropna(subset=keys).select(*keys, "_us", F.lit(0).alias("_side"), "_w")
    asked = reads.select(*keys, "_us", F.lit(1).alias("_side"), F.struct(*reads.columns).alias("_r"))
    both = log.unionByName(asked, allowMissingColumns=True)
    both = TimeSlices(both, keys, rows=slice_rows).add(both)
    so_far = Window.partitionBy(*keys, "_slice").orderBy("_us", "_side", "_w")
    seen = F.last("_w", ignorenulls=True).over(so_far.rowsBetween(Window.unboundedPreceding, 0))
    answered = both.withColumn("_seen", seen).filter("_side = 1")
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col("_w").isNotNull(), F.struct("_us", "_w")))
    carry = both.groupBy(*keys, "_slice").agg(last.alias("_last")).select(
        *keys, "_slice", F.last("_last._w", ignorenulls=True).over(earlier).alias("_carry")
    )
    return answered.join(carry, [*keys, "_slice"], "left").select("_r.*", F.coalesce("_seen", "_carry").alias("_w"))


def asof_ttl(
    reads: DataFrame, writes: DataFrame, key: str = "key", seq: str | None = None, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Add ``value`` as a read would see it: the last write at or before it, if not deleted or expired.

    ``reads`` has key and ts; ``writes`` is (key, ts, op set/delete, value, ttl_s or null) and an
    optional order column ``seq`` for writes at one instant. A write at the read's instant is
    visible; one whose age reaches its ttl is not. See :func:`latest_at`.
    """
    order = F.col(seq) if seq else F.lit(0)
    us = F.unix_micros("ts").alias("_us")
    fields = F.struct(order.cast("bigint").alias("seq"), "op", "value", F.col("ttl_s").cast("bigint").alias("ttl_s"), us.alias("us"))
    found = latest_at(reads.select("*", us), writes.select(key, us, fields.alias("_w")), [key], slice_rows)
    w = F.col("_w")
    alive = (w["op"] != "delete") & (w["ttl_s"].isNull() | (F.col("_us") - w["us"] < w["ttl_s"] * 1_000_000))
    return found.withColumn("value", F.when(alive, w["value"])).drop("_us", "_w")


def points_in_intervals(
    points: DataFrame, intervals: DataFrame, keys: Sequence[str], cell_rows: int = SLICE_ROWS
) -> DataFrame:
    """All pairs of a point and an interval of the same keys that holds it: ``_from <= _at < _to``, in microseconds.

    An interval is covered by cells of time of one length, at most an eighth of its own (so 8 to 33 cells), and a
    point looks into one cell of each length that its keys use. Pairs that meet without overlapping come from an interval's first and
    last cell only, at most a quarter of its own. Cells with more than ``cell_rows`` points are split among
    tasks, each of which gets the intervals of the cell. Null keys meet nothing.
    """
    return _meeting(points, intervals, list(keys), cell_rows).filter("_from <= _at and _at < _to").drop("_level", "_cell", "_part")


def _meeting(points: DataFrame, intervals: DataFrame, keys: list[str], cell_rows: int) -> DataFrame:
    """Pairs of a point and an interval that share a cell."""
    length = F.floor(F.log2((F.col("_to") - F.col("_from")).cast("double"))).cast("int")
    level = F.greatest(F.lit(0), F.floor((length - COVER_BITS) / 2).cast("int") * 2)
    placed = intervals.filter("_from < _to").withColumn("_level", level)
    covered = placed.withColumn("_cell", F.explode(F.expr("sequence(shiftright(_from, _level), shiftright(_to - 1, _level))")))
    # Every second power of two at most: some 30 levels, and most keys use few of them.
    used = placed.groupBy(*keys).agg(F.collect_set("_level").alias("_levels"))
    probes = points.join(used, keys).withColumn("_level", F.explode("_levels")).drop("_levels").withColumn("_cell", F.expr("shiftright(_at, _level)"))
    place = [*keys, "_level", "_cell"]
    held = probes.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / cell_rows).cast("int").alias("_parts")).filter("_parts > 1")
    few = rows_if_bounded(held)
    if few is None or few:
        held = held if few is None else F.broadcast(held.sparkSession.createDataFrame(few, held.schema))
        probes, covered = (df.join(held, place, "left").fillna(1, ["_parts"]) for df in (probes, covered))
        probes = probes.withColumn("_part", F.pmod(F.xxhash64(*points.columns), F.col("_parts")).cast("int")).drop("_parts")
        covered = covered.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
        place = [*place, "_part"]
    return probes.join(covered, place)


def deliver_events(subscriptions: DataFrame, events: DataFrame, cell_rows: int = SLICE_ROWS) -> DataFrame:
    """Every subscriber's copy of its channel's events from subscribing on, until unsubscribing.

    ``subscriptions`` is (subscriber, channel, from_ts, to_ts or null), ``events`` is (channel, ts,
    ...). Events before the subscription are not replayed. See :func:`points_in_intervals`.
    """
    # No interval need reach further than the last event.
    end = F.lit(events.agg(F.max(F.unix_micros("ts"))).first()[0]).cast("bigint") + 1
    until = F.least(F.unix_micros("to_ts"), end).alias("_to")
    taken = subscriptions.select("subscriber", "channel", F.unix_micros("from_ts").alias("_from"), until)
    points = events.withColumn("_at", F.unix_micros("ts"))
    return points_in_intervals(points, taken, ["channel"], cell_rows).select("subscriber", *events.columns)


def segments(intervals: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Intervals (``_from``, ``_to``, null: open) as steps without overlaps: (keys, _us, _w), ``_w`` null in gaps.

    From each border on, the interval that is last by ``order`` among those that hold it counts. ``_w`` is a
    struct of the intervals' other columns.
    """
    keys = list(keys)
    rest = [c for c in intervals.columns if c not in (*keys, "_from", "_to")]
    starts, ends = (intervals.select(*keys, F.col(c).alias("_at")) for c in ("_from", "_to"))
    borders = starts.unionByName(ends).filter("_at is not null").distinct()
    last = borders.agg(F.max("_at")).first()[0]
    closed = intervals.withColumn("_to", F.coalesce("_to", F.lit(last) + 1))
    best = F.max_by(F.struct(*rest), F.struct(*[F.col(c) for c in order]))
    met = points_in_intervals(borders, closed, keys).groupBy(*keys, "_at").agg(best.alias("_w"))
    # Borders that no interval holds begin a gap; a write of nothing must still be seen.
    return borders.join(met, [*keys, "_at"], "left").select(*keys, F.col("_at").alias("_us"), F.struct(F.col("_w").alias("valid")).alias("_w"))
