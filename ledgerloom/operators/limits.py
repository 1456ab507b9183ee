"""Rate limits whose windows open at a key's first request.

Where a window begins depends on every earlier request of the key, so no ``window()`` or frame can
express it, and a plain fold would put all of a key's requests into one task. Only the instants matter
for that, and how many requests each holds. A key's time is cut into slices of about equally many
instants, and a slice is summarised as a function: given when the window that is open at its start
expires, which window is open at its end? Only expiries that some earlier instant could bring are
answered. One pass over a key's summaries tells each slice the window it begins with; then all slices
work out their instants on their own, and requests meet their instant's count.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators.grouped import group_starts, sorted_groups, whole_groups
from ledgerloom.operators.slices import SLICE_ROWS, TimeSlices, same
from ledgerloom.session import cut_lineage

# Window length, limits per window, and which paths are stricter.
WINDOW_S = 60
LIMITS = {"ip": 120, "auth_ip": 20, "user": 300}
AUTH_PREFIX = "/api/v1/auth"

NO_WINDOW = np.iinfo(np.int64).min // 2  # "no window is open", far before any time


class _Slices:
    """The sorted instants of many slices, worked on together.

    Times are counted from each slice's start and slices are laid out one after the other with a
    gap wider than a slice and two windows, so one search finds for every instant where the next
    window would open, and a search never leaves its own slice.
    """

    def __init__(self, since: np.ndarray, weight: np.ndarray, owner: np.ndarray, lengths: np.ndarray, ttl: int):
        self.since, self.owner, self.lengths, self.ttl = since, owner, lengths, ttl
        self.gap = int(lengths.max()) + 2 * ttl + 2
        self.line = owner * self.gap + since
        slices = np.arange(len(lengths))
        self.first, self.stop = (np.searchsorted(owner, slices, side) for side in ("left", "right"))
        self.before = np.concatenate([[0], np.cumsum(weight)])
        self.following = np.searchsorted(self.line, self.line + ttl, "left")
        self.goes_on = self.following < self.stop[owner]

    @staticmethod
    def most(length: int, ttl: int) -> int:
        """How many slices fit on one line of 64-bit numbers."""
        return max(1, 2**62 // (length + 2 * ttl + 2))

    def last_starts(self) -> np.ndarray:
        """For a window opening at each instant: where the last window of its slice then opens."""
        at = np.where(self.goes_on, self.following, np.arange(len(self.line)))
        while not np.array_equal(further := at[at], at):
            at = further
        return at

    def summaries(self, asked: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, ...]:
        """Every slice as a function: (owner, upto, exit, held) with times from the slice's start.

        A window that expires at or before ``upto`` (and after the previous ``upto``), within the slice, leads to ``exit``,
        the start of the window open at the end, which holds ``held``. ``asked`` are the expiries, in slices ``of``.
        """
        head = np.zeros(len(self.line), dtype=bool)
        head[self.first[self.first < self.stop]] = True
        place = np.searchsorted(self.line, of * self.gap + asked, "left")
        head[place[place < self.stop[of]]] = True
        at = np.flatnonzero(head)
        ends, owner = self.last_starts()[at], self.owner[at]
        closed = self.since[ends] + self.ttl <= self.lengths[owner]
        exits = np.where(closed, NO_WINDOW, self.since[ends])
        held = np.where(closed, 0, self.before[self.stop[owner]] - self.before[ends])
        keep = np.ones(len(at), dtype=bool)
        keep[:-1] = (exits[1:] != exits[:-1]) | (owner[1:] != owner[:-1])
        return owner[keep], self.since[at][keep], exits[keep], held[keep]

    def counts(self, in_start: np.ndarray, in_held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per instant the start of its window (from the slice's start) and the requests before it in the window."""
        expiry = np.clip(in_start + self.ttl, 0, self.lengths + self.ttl)
        at = np.searchsorted(self.line, np.arange(len(self.first)) * self.gap + expiry, "left")
        opens = np.zeros(len(self.line), dtype=bool)
        at = at[at < self.stop]
        while len(at):
            opens[at] = True
            at = self.following[at][self.goes_on[at]]
        here = np.arange(len(self.line))
        begun = np.maximum.accumulate(np.where(opens, here, -1))
        carried = begun < self.first[self.owner]
        starts = np.where(carried, in_start[self.owner], self.since[begun])
        since = np.where(carried, self.before[self.first[self.owner]], self.before[begun])
        return starts, self.before[here] - since + np.where(carried, in_held[self.owner], 0)


def count_windows(t: np.ndarray, in_start: int, in_held: int, ttl: int) -> tuple[np.ndarray, np.ndarray]:
    """Window start and running count for the sorted times of one key, from the window open before them."""
    starts, counts = np.empty(len(t), np.int64), np.empty(len(t), np.int64)
    at = int(np.searchsorted(t, in_start + ttl, "left"))
    starts[:at], counts[:at] = in_start, in_held + np.arange(1, at + 1)
    while at < len(t):
        end = int(np.searchsorted(t, t[at] + ttl, "left"))
        starts[at:end], counts[at:end] = t[at], np.arange(1, end - at + 1)
        at = end
    return starts, counts


def _ints(table: pa.Table, *names: str) -> list[np.ndarray]:
    """Columns of whole numbers; null (a column of the other kind of row) becomes 0."""
    return [pc.fill_null(table.column(n), 0).to_numpy() for n in names]


def _with(table: pa.Table, source: np.ndarray, keys: Sequence[str], columns: Mapping[str, np.ndarray]) -> pa.Table:
    """Key values of the rows in ``source`` next to new whole-number columns."""
    taken = table.select(list(keys)).take(pa.array(source, pa.int64()))
    for name, column in columns.items():
        taken = taken.append_column(name, pa.array(column, pa.int64()))
    return taken


def fixed_window(
    requests: DataFrame,
    keys: Sequence[str],
    ts: str = "ts",
    ttl_s: int = WINDOW_S,
    limit: int | Column | None = None,
    tie: str = "event_id",
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Add window_start, count (1, 2, ... within the window) and, with ``limit``, allowed.

    A key's window opens at its first request and lasts ``ttl_s``; the first request at or after
    its end opens the next. Rejected requests count too. Requests at one instant are counted in
    ``tie`` order; one without a time is in no window and gets nulls.

    Requests are first counted per key and instant. A task holds at most ``slice_rows`` instants of a key,
    whether they lie within a second or a year; one task streams over the summaries of a key, a handful
    of numbers per slice. Requests are shuffled once, by key and instant; instants with more than
    ``slice_rows`` requests are counted in ranges of ``tie``. Runs jobs that count rows.
    """
    keys, ttl = list(keys), int(ttl_s * 1_000_000)
    key_fields = [requests.schema[k] for k in keys]

    def schema_of(*names: str) -> T.StructType:
        return T.StructType([*key_fields, *[T.StructField(c, T.LongType()) for c in names]])

    us = F.unix_micros(F.col(ts).cast("timestamp"))
    untimed, timed = requests.filter(us.isNull()), requests.filter(us.isNotNull()).withColumn("_us", us)
    instants = cut_lineage(timed.groupBy(*keys, "_us").agg(F.count(F.lit(1)).alias("_n")))
    # Where a window that opens at an instant expires: the questions that a later slice may be asked.
    expiries = instants.select(*keys, (F.col("_us") + ttl).alias("_us"), F.lit(0).alias("_kind"), F.lit(0).cast("bigint").alias("_n"))
    points = expiries.unionByName(instants.withColumn("_kind", F.lit(1)))
    slices = TimeSlices(points, keys, rows=slice_rows)

    def lines(table: pa.Table, starts: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """Runs of whole slices that fit on one line: rows from, rows to, and the slice of every row."""
        begin, end = _ints(table, "_slice", "_slice_end")
        most = _Slices.most(int((end - begin).max()), ttl)
        for i in range(0, len(starts), most):
            stops = np.append(starts[i + 1 : i + most], starts[i + most] if i + most < len(starts) else table.num_rows)
            yield int(starts[i]), int(stops[-1]), np.repeat(np.arange(len(stops)), np.diff(np.append(starts[i], stops)))

    map_names = ("_slice", "_slice_end", "total", "upto", "exit", "held")

    def summarise(table: pa.Table, starts: np.ndarray) -> pa.Table:
        kind, t, n, begin, end = _ints(table, "_kind", "_us", "_n", "_slice", "_slice_end")
        out = []
        for a, b, of in lines(table, starts):
            here, since = kind[a:b] == 1, t[a:b] - begin[a:b]
            first = np.searchsorted(of, np.arange(of[-1] + 1), "left") + a
            line = _Slices(since[here], n[a:b][here], of[here], (end - begin)[first], ttl)
            owner, upto, exits, held = line.summaries(since[~here], of[~here])
            total = line.before[line.stop] - line.before[line.first]
            source = first[owner]
            exits = np.where(exits == NO_WINDOW, NO_WINDOW, exits + begin[source])
            out.append(_with(table, source, keys, dict(zip(map_names, (begin[source], end[source], total[owner], upto + begin[source], exits, held)))))
        return pa.concat_tables(out)

    maps = sorted_groups(slices.add(points), [*keys, "_slice"], ["_kind", "_us"], summarise, schema_of(*map_names))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The window open at the start of each slice, from slice to slice of a key."""
        key, start, held = None, NO_WINDOW, 0
        for table, starts in whole_groups(batches, [*keys, "_slice"]):
            end, total, upto, exits, counts = _ints(table, "_slice_end", "total", "upto", "exit", "held")
            new_key = np.isin(starts, group_starts(table, keys))
            stops = np.append(starts[1:], table.num_rows)
            entries = np.empty((2, len(starts)), dtype=np.int64)
            for i, (a, b) in enumerate(zip(starts.tolist(), stops.tolist())):
                if new_key[i]:
                    mine = tuple(table.column(k)[a].as_py() for k in keys)
                    if key != mine:
                        key, start, held = mine, NO_WINDOW, 0
                entries[:, i] = start, held
                if start != NO_WINDOW and start + ttl >= end[a]:
                    held += int(total[a])
                    continue
                place = a + int(np.searchsorted(upto[a:b], start + ttl, "left"))
                start, held = (int(exits[place]), int(counts[place])) if place < b else (NO_WINDOW, 0)
            slice_no = _ints(table, "_slice")[0][starts]
            yield from _with(table, starts, keys, {"_slice": slice_no, "in_start": entries[0], "in_held": entries[1]}).to_batches()

    order = [*keys, "_slice", "upto"]
    entries = maps.repartition(*keys).sortWithinPartitions(*order).mapInArrow(follow, schema_of("_slice", "in_start", "in_held"))

    def count(table: pa.Table, starts: np.ndarray) -> pa.Table:
        """The slice's entry sorts before its instants; every slice has one of each at least."""
        kind, t, n, begin, end, in_start, in_held = _ints(table, "_kind", "_us", "_n", "_slice", "_slice_end", "in_start", "in_held")
        out = []
        for a, b, of in lines(table, starts):
            rows = np.flatnonzero(kind[a:b] == 1)
            entry = np.flatnonzero(kind[a:b] == 0) + a
            own = rows + a
            lengths = (end - begin)[own[np.searchsorted(of[rows], np.arange(len(entry)), "left")]]
            line = _Slices(t[own] - begin[own], n[own], of[rows], lengths, ttl)
            carried = np.where(in_start[entry] == NO_WINDOW, NO_WINDOW, in_start[entry] - begin[entry])
            opened, before = line.counts(carried, in_held[entry])
            out.append(_with(table, own, keys, {"_us": t[own], "_start": opened + begin[own], "_before": before}))
        return pa.concat_tables(out)

    heads = entries.withColumn("_kind", F.lit(0))
    both = heads.unionByName(slices.add(instants).withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    placed = sorted_groups(both, [*keys, "_slice"], ["_kind", "_us"], count, schema_of("_us", "_start", "_before"))
    ranked = _ranked(timed, instants.filter(F.col("_n") > slice_rows), keys, tie)
    placed = placed.withColumnsRenamed({k: f"_of_{k}" for k in [*keys, "_us"]})
    counted = ranked.join(placed, same(ranked, placed, [(k, f"_of_{k}") for k in [*keys, "_us"]]))
    result = counted.select(
        *requests.columns, F.timestamp_micros("_start").alias("window_start"), (F.col("_before") + F.col("_at")).alias("count")
    )
    result = result.unionByName(untimed, allowMissingColumns=True)
    if limit is not None:
        result = result.withColumn("allowed", F.col("count") <= limit)
    return result


def _ranked(timed: DataFrame, crowded: DataFrame, keys: Sequence[str], tie: str) -> DataFrame:
    """``timed`` with ``_at``, the place of a request among those of its key and instant, from 1.

    ``crowded`` lists instants whose requests are too many for one task: they are range-partitioned by
    ``tie``, and a range's requests come after those of the ranges before it.
    """
    instant = [*keys, "_us"]
    by_instant = Window.partitionBy(*instant).orderBy(tie)
    if crowded.isEmpty():
        return timed.withColumn("_at", F.row_number().over(by_instant))
    marks = crowded.select(*[F.col(k).alias(f"_c_{k}") for k in instant])
    hit = same(timed, marks, [(k, f"_c_{k}") for k in instant])
    usual = timed.join(marks, hit, "left_anti").withColumn("_at", F.row_number().over(by_instant))
    ranges = timed.join(marks, hit, "left_semi").repartitionByRange(*instant, tie).withColumn("_range", F.spark_partition_id())
    ranges = cut_lineage(ranges)
    earlier = Window.partitionBy(*instant).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranges.groupBy(*instant, "_range").agg(F.count(F.lit(1)).alias("_size"))
    sizes = sizes.withColumn("_offset", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
    sizes = sizes.select(*[F.col(k).alias(f"_c_{k}") for k in [*instant, "_range"]], "_offset")
    joined = ranges.join(sizes, same(ranges, sizes, [(k, f"_c_{k}") for k in [*instant, "_range"]]))
    in_range = F.row_number().over(Window.partitionBy(*instant, "_range").orderBy(tie))
    return usual.unionByName(joined.withColumn("_at", in_range + F.col("_offset")).select(*timed.columns, "_at"))


def rate_limit(
    requests: DataFrame,
    limits: Mapping[str, int] = LIMITS,
    ttl_s: int = WINDOW_S,
    auth_prefix: str = AUTH_PREFIX,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Decide every request (event_id, ts, ip, path, user_id): by address first, then by user.

    Paths of the sign-in area have an address window of their own with a stricter limit. A request
    refused by address does not count for its user; without a user only the address decides. Adds
    ip_count, user_count (null when not reached), decision ``allowed``/``rejected_ip``/``rejected_user``;
    a request without a time is undecided (null) and counts for nobody.
    The result of the first level is checkpointed, since the second reads it several times.
    """
    is_auth = F.coalesce(F.col("path").startswith(auth_prefix), F.lit(False))
    tagged = requests.withColumn("_bucket", F.when(is_auth, "auth").otherwise("all")).withColumn(
        "_address", F.coalesce("ip", F.lit("unknown"))
    )
    ip_limit = F.when(F.col("_bucket") == "auth", limits["auth_ip"]).otherwise(limits["ip"])
    by_ip = fixed_window(tagged, ["_bucket", "_address"], ttl_s=ttl_s, limit=ip_limit, slice_rows=slice_rows)
    by_ip = cut_lineage(
        by_ip.withColumnRenamed("count", "ip_count").withColumnRenamed("allowed", "_ip_ok").drop("window_start")
    )
    reaches_user = F.coalesce("_ip_ok", F.lit(False)) & F.col("user_id").isNotNull()
    by_user = fixed_window(by_ip.filter(reaches_user), ["user_id"], ttl_s=ttl_s, limit=limits["user"], slice_rows=slice_rows)
    shown = [*requests.columns, "ip_count"]
    decided = by_user.select(
        *shown, F.col("count").alias("user_count"), F.when(F.col("allowed"), "allowed").otherwise("rejected_user").alias("decision")
    )
    early = by_ip.filter(~reaches_user).select(
        *shown,
        F.lit(None).cast("bigint").alias("user_count"),
        F.when(F.col("_ip_ok"), "allowed").when(~F.col("_ip_ok"), "rejected_ip").alias("decision"),
    )
    return decided.unionByName(early)
