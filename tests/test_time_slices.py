"""Slices of equally many rows, intervals that meet only what they hold, price periods: against plain rules, with bursts."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom.operators import limits, stages, temporal, usage
from ledgerloom.operators.slices import TimeSlices

MINUTE = 60_000_000


def burst(rng, n=6000):
    """(key, microseconds): a key with a third of all rows within one minute, others over a year."""
    year = 365 * 1440 * MINUTE
    hot = [("hot", 200 * 1440 * MINUTE + rng.randrange(MINUTE)) for _ in range(n // 3)]
    return hot + [(rng.choice(["hot", "b", "c", None]), rng.randrange(year)) for _ in range(n - n // 3)]


def test_slices_hold_bounded_rows(spark):
    rng = random.Random(1)
    points = burst(rng) + [("b", 7)] * 500 + [("c", -5), ("c", -(1 << 40))]
    df = spark.createDataFrame(points, "k string, _us bigint")
    rows = TimeSlices(df, ["k"], rows=100).add(df).collect()
    assert len(rows) == len(points)
    slices = {}
    for r in rows:
        assert r["_slice"] <= r["_us"] < r["_slice_end"]
        slices.setdefault((r["k"], r["_slice"], r["_slice_end"]), []).append(r["_us"])
    assert max(len(v) for v in slices.values() if len(set(v)) > 1) <= 100
    for k in ("hot", "b", "c", None):
        mine = sorted((a, b) for key, a, b in slices if key == k)
        assert all(b <= c for (_, b), (c, _) in zip(mine, mine[1:]))
    in_burst = [len(v) for (k, a, b), v in slices.items() if k == "hot" and b - a <= MINUTE]
    assert sum(in_burst) >= 1900 and max(in_burst) <= 100


def plain_counts(requests, ttl):
    out, open_ = {}, {}
    for i, k, t in sorted(requests, key=lambda r: (r[2], r[0])):
        start, n = open_.get(k, (None, 0))
        if start is None or t >= start + ttl:
            start, n = t, 0
        open_[k] = (start, n + 1)
        out[i] = (start, n + 1)
    return out


def test_windows_of_a_burst(spark):
    rng = random.Random(2)
    points = burst(rng, 3000) + [("b", 9 * MINUTE)] * 300
    requests = [(i, k, t) for i, (k, t) in enumerate(points)]
    df = spark.createDataFrame(requests, "event_id long, k string, t bigint").withColumn("ts", F.timestamp_micros("t")).repartition(4)
    for ttl_s in (7, 86_400):
        got = limits.fixed_window(df, ["k"], ttl_s=ttl_s, slice_rows=60).select("event_id", F.unix_micros("window_start"), "count").collect()
        assert {r[0]: (r[1], r[2]) for r in got} == plain_counts(requests, ttl_s * 1_000_000)


def test_no_group_holds_the_burst(spark, monkeypatch):
    """The groups that tasks get whole stay small, though one key has a third of the rows in one minute."""
    rng = random.Random(3)
    points = burst(rng, 6000)
    df = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(points)], "event_id long, k string, t bigint").withColumn("ts", F.timestamp_micros("t"))
    seen = []
    monkeypatch.setattr(limits, "sorted_groups", lambda d, keys, order, fn, schema, go=limits.sorted_groups: (seen.append(d.groupBy(*keys).count().agg(F.max("count")).first()[0]), go(d, keys, order, fn, schema))[1])
    assert limits.fixed_window(df, ["k"], ttl_s=60, slice_rows=200).count() == 6000
    assert len(seen) == 2 and max(seen) <= 201


def test_stage_times_of_a_burst(spark):
    rng = random.Random(4)
    points = sorted((k or "n", t, i) for i, (k, t) in enumerate(burst(rng, 2000)))
    rows = [(i, k, "s", "x", t) for k, t, i in points]
    df = spark.createDataFrame(rows, "event_id long, document_id string, stage string, status string, t bigint").withColumn("ts", F.timestamp_micros("t"))
    got = {r["event_id"]: r["seconds"] for r in stages.stage_times(df, slice_rows=50).collect()}
    for (k, t, i), after in zip(points, [*points[1:], None]):
        want = (after[1] - t) / 1e6 if after and after[0] == k else None
        assert got[i] == want


def test_points_in_intervals(spark):
    rng = random.Random(5)
    points = [(rng.choice(["a", "b"]), rng.choice([rng.randrange(1 << 38), rng.randrange(1 << 20)]), i) for i in range(1500)] + [(None, 5, 9000)]
    intervals = []
    for i in range(120):
        start = rng.randrange(1 << rng.choice([10, 20, 38]))
        intervals.append((rng.choice(["a", "b"]), start, start + rng.choice([-5, 0, 1, 100, 5000, 1 << 20, 1 << 36]), i))
    intervals.append((None, 0, 10, 500))
    p = spark.createDataFrame(points, "k string, _at bigint, p int")
    q = spark.createDataFrame(intervals, "k string, _from bigint, _to bigint, q int")
    want = sorted((x[2], y[3]) for x in points for y in intervals if x[0] and x[0] == y[0] and y[1] <= x[1] < y[2])
    for cell_rows in (3, 100_000):
        got = temporal.points_in_intervals(p, q, ["k"], cell_rows).select("p", "q").collect()
        assert sorted(map(tuple, got)) == want
    # On a hot channel few pairs meet that do not belong together.
    met = temporal._meeting(p.withColumn("k", F.lit("hot")), q.withColumn("k", F.lit("hot")), ["k"], 100_000).count()
    assert met <= 1.5 * temporal.points_in_intervals(p.withColumn("k", F.lit("hot")), q.withColumn("k", F.lit("hot")), ["k"]).count() + 100
    assert temporal.points_in_intervals(p, q.filter("q < 0"), ["k"]).count() == 0


def test_prices_of_overlapping_periods(spark):
    at = lambda s: dt.datetime(2025, 1, 1) + dt.timedelta(seconds=s)
    rng = random.Random(6)
    prices = [("p", m, Decimal(rng.randrange(1, 50)), Decimal(1), at(a), None if rng.random() < 0.2 else at(a + rng.randrange(0, 300)))
              for m in "xy" for a in rng.sample(range(2000), 25)]
    calls = [(i, "p", rng.choice(["x", "y", "z", None]), 1000, 0, at(rng.randrange(-50, 2500)), Decimal(9)) for i in range(400)]
    calls += [(900, "p", "x", None, 0, at(5), None), (901, "p", "x", 5, 0, None, None)]
    given = spark.createDataFrame(prices, "provider string, model string, usd_per_1k_in decimal(10,6), usd_per_1k_out decimal(10,6), valid_from timestamp, valid_to timestamp")
    log = spark.createDataFrame(calls, "id int, provider string, model string, tokens_in int, tokens_out int, created_at timestamp, cost_estimate decimal(10,6)")
    for slice_rows in (5, 100_000):
        got = {r["id"]: r["cost_estimate"] for r in usage.estimate_cost(log, given, slice_rows).collect()}
        assert len(got) == len(calls)
        for i, _, m, tokens, _, t, _ in calls:
            valid = [p for p in prices if p[1] == m and t and p[4] <= t and (p[5] is None or t < p[5])]
            want = max(valid, key=lambda p: (p[4], p[5] or at(10**6), p[2]))[2] if valid and tokens else None
            assert got[i] == want, i
