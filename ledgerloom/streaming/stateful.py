"""Operators that keep a small state per key."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerloom.operators.limits import NO_WINDOW, count_windows
from ledgerloom.streaming.runner import watermarked

# Rows that leave a buffer at a time.
RELEASED = 10_000
# Keys share this many states: calls to the state store cost far more than the rows of a key.
GROUPS = 1024
STALLED = "stalled"


def _as_texts(df: DataFrame, *also: str) -> DataFrame:
    """Whole numbers (and ``also``) as texts, so that nulls among them reach Python and come back unchanged."""
    whole = (T.LongType, T.IntegerType, T.ShortType, T.ByteType)
    return df.select(*[F.col(f.name).cast("string") if isinstance(f.dataType, whole) or f.name in also else F.col(f.name) for f in df.schema.fields])


def _like(df: DataFrame, schema: T.StructType) -> DataFrame:
    kinds = {f.name: f.dataType for f in schema.fields}
    return df.select(*[F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in df.columns])


def _grouped(df: DataFrame, key: str):
    """Rows by a hash of their key; all rows of a key, null or not, share one group."""
    return df.withColumn("_group", F.pmod(F.xxhash64(key), F.lit(GROUPS))).groupBy("_group")


def _micros(times: pd.Series) -> np.ndarray:
    if times.isna().any():
        raise ValueError("a row of the stream has no time")
    return times.astype("datetime64[us]").astype("int64").to_numpy()


def _ranks(values: pd.Series, numeric: bool, nulls_last: bool = False) -> list[np.ndarray]:
    """Keys for ``np.lexsort`` that put values in order, null first or last."""
    there = values.notna().to_numpy()
    if numeric:
        rank = np.array([int(v) if ok else 0 for v, ok in zip(values, there)], dtype=np.int64)
    else:
        rank = pd.factorize(values, sort=True)[0]
    return [rank, ~there if nulls_last else there]


def _rearm(handle: StatefulProcessorHandle, at_ms: int | None) -> None:
    """Leave one timer, or none."""
    timers = list(handle.listTimers())
    for t in timers:
        if t != at_ms:
            handle.deleteTimer(t)
    if at_ms is not None and at_ms not in timers:
        handle.registerTimer(at_ms)


class _WindowCounter(StatefulProcessor):
    """State of a group of keys: the batches that wait for the watermark, with their first and last time in
    microseconds, and per key the start of the open window and how many requests it has seen."""

    def __init__(self, key: str, ttl_s: int, limit: int, names: list[str], tie: str, numeric: bool):
        self.key, self.ttl, self.limit = key, ttl_s * 1_000_000, limit
        self.names, self.tie, self.numeric = names, tie, numeric

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "first bigint, last bigint, rows binary")
        self.open = handle.getValueState("open", "windows binary")

    @staticmethod
    def _packed(rows: pd.DataFrame, us: np.ndarray) -> tuple:
        return (int(us.min()), int(us.max()), pickle.dumps(rows))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        taken = [self._packed(batch[self.names], _micros(batch["ts"])) for batch in rows if len(batch)]
        if taken:
            self.waiting.appendList(taken)
            wake = min(t[0] for t in taken) // 1000 + 1
            timers = list(self.handle.listTimers())
            if not timers or min(timers) > wake:
                _rearm(self.handle, wake)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # No row at or before the watermark can come any more.
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        due, later = [], []
        for first, last, packed in self.waiting.get():
            if first > passed:
                later.append((first, last, packed))
                continue
            rows = pickle.loads(packed)
            if last > passed:
                us = _micros(rows["ts"])
                later.append(self._packed(rows[us > passed], us[us > passed]))
                rows = rows[us <= passed]
            due.append(rows)
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        held = self.open.get()
        windows = pickle.loads(held[0]) if held is not None else {}
        if due:
            yield from self._decided(pd.concat(due, ignore_index=True), windows)
        windows = {k: w for k, w in windows.items() if w[0] + self.ttl > passed}
        if windows:
            self.open.update((pickle.dumps(windows),))
        else:
            self.open.clear()
        ends = [first for first, _, _ in later] + [start + self.ttl for start, _ in windows.values()]
        if ends:
            self.handle.registerTimer(min(ends) // 1000 + 1)

    def _decided(self, rows: pd.DataFrame, windows: dict) -> Iterator[pd.DataFrame]:
        """Rows in order of key, time and tie with their windows, which go on in ``windows``."""
        codes, keys = pd.factorize(rows[self.key])
        us = _micros(rows["ts"])
        order = np.lexsort([*_ranks(rows[self.tie], self.numeric), us, codes])
        rows, us, codes = rows.iloc[order].reset_index(drop=True), us[order], codes[order]
        edges = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
        starts, counts = np.empty(len(us), np.int64), np.empty(len(us), np.int64)
        for a, b in zip(edges, edges[1:]):
            key = None if codes[a] < 0 else keys[codes[a]]
            start, count = windows.get(key, (NO_WINDOW, 0))
            starts[a:b], counts[a:b] = count_windows(us[a:b], start, count, self.ttl)
            windows[key] = (int(starts[b - 1]), int(counts[b - 1]))
        out = rows.assign(window_start=pd.to_datetime(pd.Series(starts), unit="us"), count=counts, allowed=counts <= self.limit)
        for i in range(0, len(out), RELEASED):
            yield out.iloc[i : i + RELEASED].reset_index(drop=True)

    def close(self) -> None:
        pass


def stream_rate_limit(
    requests: DataFrame, key: str, ttl_s: int, limit: int, watermark: str = "10 minutes", tie: str = "event_id"
) -> DataFrame:
    """``fixed_window`` on a stream: adds window_start, count, allowed, once the watermark has passed a request.

    Requests wait until the watermark passes them and are then decided in order of time and ``tie``, so decisions do not
    depend on how requests were dealt to files and batches. Later ones are dropped and counted (:func:`late_rows`); those
    of the last moments come out when the stream is closed (:func:`write_closing`). A key's state is the requests of
    one watermark delay and two numbers; it is gone once the watermark passes the end of its window. ``GROUPS`` states hold
    all keys, so a task holds the waiting requests of one of so many shares at a time.
    """
    plain = watermarked(requests, "ts", watermark)
    texts = _as_texts(plain)
    schema = T.StructType(
        [
            *texts.schema.fields,
            T.StructField("window_start", T.TimestampType()),
            T.StructField("count", T.LongType()),
            T.StructField("allowed", T.BooleanType()),
        ]
    )
    numeric = isinstance(plain.schema[tie].dataType, T.IntegralType)
    processor = _WindowCounter(key, ttl_s, limit, texts.columns, tie, numeric)
    decided = _grouped(texts, key).transformWithStateInPandas(processor, schema, outputMode="Append", timeMode="EventTime")
    return _like(decided, plain.schema)


class _Progress(StatefulProcessor):
    """State of a group of documents: per document its stage, since when, and when it was last heard of (microseconds)."""

    def __init__(self, terminal: tuple[str, ...], expiry_us: int | None, numeric: bool):
        self.terminal, self.expiry, self.numeric = terminal, expiry_us, numeric

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.current = handle.getValueState("current", "documents binary")

    def _held(self) -> dict:
        held = self.current.get()
        return pickle.loads(held[0]) if held is not None else {}

    def _keep(self, documents: dict) -> None:
        if documents:
            self.current.update((pickle.dumps(documents),))
        else:
            self.current.clear()

    def _wakes(self, heard: int) -> int:
        return (heard + self.expiry) // 1000 + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        # Without expiry an event without a time comes before all others, and leaves without one.
        us = batch["ts"].astype("datetime64[us]").astype("int64").to_numpy() if self.expiry is None else _micros(batch["ts"])
        order = np.lexsort([*_ranks(batch["event_id"], self.numeric, nulls_last=True), us])
        columns = [batch[c].astype(object).where(batch[c].notna(), None).to_numpy()[order] for c in ("document_id", "event_id", "stage", "status")]
        documents = self._held()
        changes: list[tuple] = []
        for document, event_id, new, status, at in zip(*columns, us[order].tolist()):
            stage, since, heard = documents.get(document, (None, None, None))
            if stage is not None and self.expiry is not None and at - heard > self.expiry:
                changes.append(self._stalled(document, stage, since, heard))
                stage, since = None, None
            ended = status in self.terminal
            if new != stage or ended:
                seconds = None if since is None else (at - since) / 1e6
                changes.append((document, event_id, at, new, status, stage, seconds))
                stage, since = new, at
            documents[document] = (None, None, at) if ended else (stage, since, at)
        documents = {d: held for d, held in documents.items() if held[0] is not None}
        self._keep(documents)
        if self.expiry is not None:
            _rearm(self.handle, min((self._wakes(heard) for _, _, heard in documents.values()), default=None))
        yield from self._frames(changes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        documents = self._held()
        stalled = {d: held for d, held in documents.items() if self._wakes(held[2]) <= passed}
        for d in stalled:
            del documents[d]
        self._keep(documents)
        if documents:
            self.handle.registerTimer(min(self._wakes(heard) for _, _, heard in documents.values()))
        yield from self._frames([self._stalled(d, *held) for d, held in stalled.items()])

    def _stalled(self, document, stage: str, since: int, heard: int) -> tuple:
        at = heard + self.expiry
        return (document, None, at, stage, STALLED, stage, (at - since) / 1e6)

    @staticmethod
    def _frames(changes: list[tuple]) -> Iterator[pd.DataFrame]:
        names = ["document_id", "event_id", "ts", "stage", "status", "previous_stage", "previous_seconds"]
        for i in range(0, len(changes), RELEASED):
            out = pd.DataFrame(changes[i : i + RELEASED], columns=names, dtype=object)
            out["ts"] = pd.to_datetime(out["ts"].astype("int64"), unit="us")
            out["previous_seconds"] = out["previous_seconds"].astype("float64")
            yield out

    def close(self) -> None:
        pass


def stream_progress(
    stage_events: DataFrame,
    terminal: tuple[str, ...] = ("ready", "failed"),
    expire_s: int | None = None,
    watermark: str = "1 hour",
) -> DataFrame:
    """One row whenever a document enters another stage, with the time it spent in the one before.

    A terminal status always gives a row and forgets the document; its next event starts afresh. With
    ``expire_s`` a document without an event for longer than that gives a row with status ``stalled`` (no event id, at the
    moment it expired) and is forgotten too, when its next event comes or the watermark passes that moment, so
    no document is kept for ever. ``GROUPS`` states hold all documents.
    """
    plain = stage_events if expire_s is None else watermarked(stage_events, "ts", watermark)
    fields = plain.schema
    schema = T.StructType(
        [
            T.StructField("document_id", T.StringType()),
            T.StructField("event_id", T.StringType()),
            T.StructField("ts", T.TimestampType()),
            T.StructField("stage", T.StringType()),
            T.StructField("status", T.StringType()),
            T.StructField("previous_stage", T.StringType()),
            T.StructField("previous_seconds", T.DoubleType()),
        ]
    )
    # Events are put in order by their own kind of id; ids travel as texts, and a stalled row has none.
    numeric = isinstance(fields["event_id"].dataType, T.IntegralType)
    processor = _Progress(terminal, None if expire_s is None else expire_s * 1_000_000, numeric)
    needed = _as_texts(plain.select("document_id", "event_id", "ts", "stage", "status"), "document_id", "event_id")
    processor_rows = _grouped(needed, "document_id").transformWithStateInPandas(
        processor, schema, outputMode="Update", timeMode="None" if expire_s is None else "EventTime"
    )
    return _like(processor_rows, T.StructType([fields["document_id"], fields["event_id"]]))
