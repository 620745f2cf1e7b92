"""Scan sessions as a keyed state machine: they end when finalised, when the next one starts, or when idle."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENT = "at long, seq long, kind string, view int, n_damages long"
CLOSED = (
    "session_id long, started_at timestamp, closed_at timestamp, reason string, n_views long, n_photos long, n_retakes long, n_removed long, n_damages long"
)


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Timers and maps need the RocksDB state store; the session's own setting comes back afterwards."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(key, before)


class ScanSessions(StatefulProcessor):
    """Events wait until the watermark has passed them and are then taken in order of (at, seq), however they arrived.

    Times are microseconds. The state of a key: the waiting events, the open session's times and count, and one entry per view.
    """

    def __init__(self, idle: int, n_views: int):
        self.idle, self.n_views = idle, n_views

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", EVENT)
        self.session = handle.getValueState("session", "started long, last long, n_photos long")
        self.views = handle.getMapState("views", "view int", "removed boolean, n_damages long")

    def wake(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))  # timers know milliseconds

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r.at, r.seq, r.kind, r.view, r.n_damages) for r in rows]
        self.waiting.appendList(new)
        self.wake(min(e[0] for e in new))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        events = sorted((tuple(e) for e in self.waiting.get()), key=lambda e: (e[0], e[1])) if self.waiting.exists() else []
        due = [e for e in events if e[0] <= now]
        if due:
            if len(due) < len(events):
                self.waiting.put(events[len(due):])
                self.wake(events[len(due)][0])
            else:
                self.waiting.clear()
        started, last, n_photos = self.session.get() if self.session.exists() else (None, None, 0)
        views = {k[0]: tuple(v) for k, v in self.views.iterator()} if started is not None else {}
        out, was_open, touched = [], started is not None, set()

        def close(at: int, reason: str) -> None:
            nonlocal started, last, n_photos, was_open
            live = [n for removed, n in views.values() if not removed]
            out.append(Row(
                session_id=key[0], started_at=started, closed_at=at, reason=reason, n_views=len(live), n_photos=n_photos,
                n_retakes=n_photos - len(views), n_removed=len(views) - len(live), n_damages=sum(n or 0 for n in live),
            ))
            if was_open:
                self.views.clear()
            started, last, n_photos, was_open = None, None, 0, False
            views.clear()
            touched.clear()

        for at, _, kind, view, n_damages in due:
            if started is not None and at - last > self.idle:
                close(last + self.idle, "idle")
            if kind == "finalize":
                if started is not None:
                    close(at, "finalized")
                continue
            if kind == "start" and started is not None:
                close(at, "next_start")
            if started is None:
                started = at
            last = at
            if kind != "start":
                slot = view if view is not None and 0 <= view < self.n_views else -1
                views[slot] = (kind == "remove", n_damages)
                touched.add(slot)
                n_photos += 1
        if started is not None and last + self.idle <= now:
            close(last + self.idle, "idle")
        if started is None:
            self.session.clear()
        else:
            self.session.update((started, last, n_photos))
            for slot in touched:
                self.views.updateValue((slot,), views[slot])
            self.wake(last + self.idle)
        return iter(out)

    def close(self) -> None:
        pass


def scan_sessions(events: DataFrame, idle_minutes: int = 30, delay: str = "10 minutes", n_views: int = 12) -> DataFrame:
    """Events (session_id, captured_at, seq, kind, view_idx, n_damages) of a stream to one row per closed session.

    ``kind`` is start, photo, remove or finalize; any other kind is taken as photo. A session of a session_id opens with a
    start, or with a photo or removal while none is open. It closes with reason ``finalized`` at a finalize, ``next_start``
    when the next start comes, ``idle`` when nothing follows for ``idle_minutes``; a finalize while none is open is
    ignored. Of each view the newest photo or removal counts; ``n_retakes`` are the others, ``n_removed`` the views that end
    removed. Views outside 0 ... ``n_views`` - 1, and null, count as one more view, so the state is bounded.

    Events that arrive behind the watermark are dropped, as are ones without a time or a session_id. Restarted from its
    checkpoint the query goes on with the open sessions, the waiting events and their timers; rows of a batch that
    was not committed are computed again from the same state and come out the same.
    """
    usable = events.where(F.col("captured_at").isNotNull() & F.col("session_id").isNotNull())
    timed = usable.withWatermark("captured_at", delay).select(
        "session_id", "captured_at", F.unix_micros("captured_at").alias("at"), "seq", "kind", F.col("view_idx").alias("view"), "n_damages"
    )
    raw = CLOSED.replace("timestamp", "long")
    closed = timed.groupBy("session_id").transformWithState(
        ScanSessions(idle_minutes * 60_000_000, n_views), outputStructType=raw, outputMode="append", timeMode="eventTime"
    )
    return closed.withColumns({c: F.timestamp_micros(c) for c in ("started_at", "closed_at")})
