"""Scan sessions of a stream: the three endings, events out of order, restarts, views outside the vocabulary."""

import random

import pytest
from pyspark.sql import functions as F

from fleetlens.streaming import scans, sessions

SCHEMA = "session_id long, captured_at timestamp, seq long, kind string, view_idx int, n_damages long"


def land(spark, folder, rows):
    """Rows (session, minute, kind, view, damages); seq is the place in the list."""
    made = [(s, float(m) + 10_000, q, k, v, n) for q, s, m, k, v, n in rows]  # the clock of a stream starts at 0
    df = spark.createDataFrame(made, SCHEMA.replace("timestamp", "double"))
    df.withColumn("captured_at", F.timestamp_micros((F.col("captured_at") * 60_000_000).cast("long"))).coalesce(1).write.parquet(folder)


def run(spark, batches, tmp_path, one_by_one=False):
    """Closed sessions as (session, minute of start, minute of end, reason, views, photos, retakes, removed, damages)."""
    source, out, log = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "log")
    with sessions.rocksdb_state(spark):
        for i, rows in enumerate(batches):
            land(spark, f"{source}/{i:03d}", rows)
            if one_by_one or i == len(batches) - 1:  # each run starts the query anew from its checkpoint
                stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(source)
                scans.run_append(sessions.scan_sessions(stream), out, log)
    minute = lambda t: F.unix_micros(t) / 60_000_000 - 10_000
    rows = spark.read.parquet(out).withColumns({c: minute(F.col(c)) for c in ("started_at", "closed_at")}).collect()
    return sorted((r.session_id, r.started_at, r.closed_at, r.reason, r.n_views, r.n_photos, r.n_retakes, r.n_removed, r.n_damages) for r in rows)


EVENTS = [
    (1, 0, "start", None, 0), (1, 1, "photo", 0, 2), (1, 2, "photo", 1, 3), (1, 3, "photo", 0, 5), (1, 4, "remove", 1, 0), (1, 5, "finalize", None, 0),
    (1, 6, "finalize", None, 0),  # nothing is open
    (1, 7, "photo", 3, 1), (1, 10, "start", None, 0), (1, 11, "photo", 3, 4), (1, 100, "photo", 4, 8),  # next start, then idle
    (2, 3, "photo", 12, 1), (2, 4, "photo", -1, 2), (2, 5, "photo", None, 4), (2, 6, "photo", 11, 8),  # one more view for all others
    (3, 500, "start", None, 0),
]
WANT = [
    (1, 0, 5, "finalized", 1, 4, 2, 1, 5), (1, 7, 10, "next_start", 1, 1, 0, 0, 1), (1, 10, 41, "idle", 1, 1, 0, 0, 4), (1, 100, 130, "idle", 1, 1, 0, 0, 8),
    (2, 3, 36, "idle", 2, 4, 2, 0, 12),
]


def numbered(events):
    return [(q, *e) for q, e in enumerate(events)]


def test_three_endings(spark, tmp_path):
    assert run(spark, [numbered(EVENTS)], tmp_path) == WANT


@pytest.mark.parametrize("one_by_one", [False, True])
def test_batches_out_of_order_and_restarts(spark, tmp_path, one_by_one):
    """Events up to five minutes late, in several batches: the sessions are the same, also when the query starts anew for each."""
    rnd = random.Random(3)
    rows = sorted(numbered(EVENTS), key=lambda r: r[2] + rnd.random() * 5)
    assert run(spark, [rows[:4], rows[4:9], rows[9:]], tmp_path, one_by_one) == WANT


def test_events_behind_the_watermark_are_dropped(spark, tmp_path):
    late = [(98, 1, 1, "photo", 7, 100), (99, 9, 90, "photo", 0, 7)]
    got = run(spark, [numbered(EVENTS[:-1]), numbered(EVENTS)[-1:], late, [(100, 3, 900, "photo", 1, 1)]], tmp_path)
    assert [r for r in got if r[0] != 3] == WANT


def test_rows_without_time_or_session(spark, tmp_path):
    source = str(tmp_path / "bare")
    land(spark, source, numbered([(None, 1, "photo", 0, 1), (5, 1, "photo", 0, 1), (5, 200, "start", None, None)]))
    with sessions.rocksdb_state(spark):
        stream = spark.readStream.schema(SCHEMA).parquet(source).withColumn("captured_at", F.when(F.col("seq") != 9, F.col("captured_at")))
        scans.run_append(sessions.scan_sessions(stream), str(tmp_path / "out"), str(tmp_path / "log"))
    assert [(r.session_id, r.n_photos) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(5, 1)]


def test_the_state_store_setting_comes_back(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    with sessions.rocksdb_state(spark):
        assert spark.conf.get(key) == sessions.ROCKSDB
    assert spark.conf.get(key) == before
