"""Tables that change, in batch and as streams."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.operators import store
from fleetlens.plans.registry import query
from fleetlens.plans.sources import brand_files
from fleetlens.plans.standins import VIEWS, Tables
from fleetlens.session import scratch_path
from fleetlens.sources.versions import VersionedTables, replace_cars
from fleetlens.streaming import scans, sessions, upserts


@query("t04_upsert_predictions", """
WITH split AS (SELECT *, created_at < TIMESTAMP '2024-01-16' AS old FROM v_predictions WHERE NOT failed),
had AS (SELECT * FROM split WHERE old QUALIFY row_number() OVER (PARTITION BY image_id, model ORDER BY created_at DESC, seq DESC) = 1),
new AS (SELECT * FROM split WHERE NOT old QUALIFY row_number() OVER (PARTITION BY image_id, model ORDER BY created_at, seq) = 1)
SELECT image_id, model, created_at, seq, n_damages FROM had
UNION ALL SELECT image_id, model, created_at, seq, n_damages FROM new WHERE (image_id, model) NOT IN (SELECT image_id, model FROM had)""")
def _(t):
    old = F.col("created_at") < F.lit("2024-01-16").cast("timestamp_ntz")
    rows = t.predictions
    stored = store.upsert_predictions(rows.drop("failed").where(F.lit(False)), rows.where(old), force=True)
    return store.upsert_predictions(stored, rows.where(~old))


@query("t04_upsert_forced", """
SELECT image_id, model, created_at, seq, n_damages FROM v_predictions WHERE NOT failed QUALIFY row_number() OVER (PARTITION BY image_id, model ORDER BY created_at DESC, seq DESC) = 1""")
def _(t):
    old = F.col("created_at") < F.lit("2024-01-16").cast("timestamp_ntz")
    rows = t.predictions
    stored = store.upsert_predictions(rows.drop("failed").where(F.lit(False)), rows.where(old), force=True)
    return store.upsert_predictions(stored, rows.where(~old), force=True)


@query("t05_annotation_log", """
WITH ok AS (SELECT anno_id, min(seq) AS born FROM v_annotation_log WHERE op = 'create' AND label IN ('scratch', 'stone_chip', 'dent', 'crack', 'missing', 'major', 'other') GROUP BY anno_id),
live AS (SELECT l.*, born FROM v_annotation_log l JOIN ok ON l.anno_id = ok.anno_id WHERE seq = born OR (seq > born AND op <> 'create'))
SELECT anno_id, arg_min(image_id, seq) AS image_id, arg_min(source, seq) AS source, arg_max(x, seq) FILTER (WHERE x IS NOT NULL) AS x, arg_max(y, seq) FILTER (WHERE y IS NOT NULL) AS y,
  arg_max(w, seq) FILTER (WHERE w IS NOT NULL) AS w, arg_max(h, seq) FILTER (WHERE h IS NOT NULL) AS h, arg_max(label, seq) FILTER (WHERE label IS NOT NULL) AS label,
  arg_max(severity, seq) FILTER (WHERE severity IS NOT NULL) AS severity, min(ts) AS created_at,
  max(ts) FILTER (WHERE coalesce(x, y, w, h) IS NOT NULL OR label IS NOT NULL OR severity IS NOT NULL) AS updated_at
FROM live GROUP BY anno_id HAVING NOT bool_or(op = 'delete')""")
def _(t):
    return store.annotation_state(t.annotation_log)


@query("t06_replace_test_cars", """
WITH p AS (SELECT concat('TEST_', replace(p_brand, '#', '_')) AS plate_safe, concat('TEST · ', replace(p_brand, '#', '_')) AS plate_original, p_partkey FROM part WHERE p_partkey % 9 <> 0)
SELECT 'cars' AS relation, plate_safe, plate_original AS item, car_score AS score, n_unique_views AS n, 0 AS is_test FROM v_held_cars WHERE plate_safe NOT IN (SELECT plate_safe FROM p)
UNION ALL SELECT 'cars', plate_safe, plate_original, 100, count(*), 1 FROM p GROUP BY ALL
UNION ALL SELECT 'images', plate_safe, view, quality_score, 0, NULL FROM v_held_images WHERE plate_safe NOT IN (SELECT plate_safe FROM p)
UNION ALL SELECT 'images', plate_safe, concat('TEST_', p_partkey), 100, 0, NULL FROM p
UNION ALL SELECT 'db_damages', plate_safe, damage_id, NULL, 0, NULL FROM v_held_damages WHERE plate_safe NOT IN (SELECT plate_safe FROM p)""")
def _(t):
    """Test photos replace the cars of the same key in all three tables."""
    tables = VersionedTables(t.spark, scratch_path(t.spark, "store"))
    tables.create({
        "cars": (t.held_cars, "plate_safe"), "images": (t.held_images, "plate_safe"), "db_damages": (t.held_damages, "plate_safe"),
    })
    cars, images = store.cars_from_test_photos(brand_files(t))
    version = replace_cars(tables, cars, images.drop("path"))
    number = lambda c: F.col(c).cast("long").alias("n")
    return tables.read("cars", version).select(
        F.lit("cars").alias("relation"), "plate_safe", F.col("plate_original").alias("item"), F.col("car_score").alias("score"), number("n_unique_views"), "is_test"
    ).unionByName(tables.read("images", version).select(
        F.lit("images").alias("relation"), "plate_safe", F.col("view").alias("item"), F.col("quality_score").alias("score"), number("is_hard_fail"),
        F.lit(None).cast("int").alias("is_test"),
    )).unionByName(tables.read("db_damages", version).select(
        F.lit("db_damages").alias("relation"), "plate_safe", F.col("damage_id").alias("item"), F.lit(None).cast("double").alias("score"),
        F.lit(0).cast("long").alias("n"), F.lit(None).cast("int").alias("is_test"),
    ))


def stream_of(t: Tables, name: str) -> DataFrame:
    """A stand-in over the event file, read as a stream."""
    events = t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/events.parq*")
    return t.sql(VIEWS[name], events=events)


@query("t01_stream_session_totals", """
SELECT session_id, count(*) AS n_attempts, count_if(attempt > 1) AS n_retries, count(error) AS n_errors, sum(bytes_sent)::BIGINT AS bytes_sent, sum(bytes_received)::BIGINT AS bytes_received,
  sum(latency_ms)::BIGINT AS latency_ms, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens FROM v_attempts GROUP BY session_id""")
def _(t):
    path = scratch_path(t.spark, "totals")
    scans.run_session_totals(stream_of(t, "v_attempts"), path, scratch_path(t.spark, "totals-log"))
    return scans.read_session_totals(t.spark, path)


@query("t02_stream_latest_photo", """
WITH e AS (SELECT *, coalesce(captured_at - lag(captured_at) OVER (PARTITION BY session_id ORDER BY captured_at) > INTERVAL 30 MINUTE, false) AS cut FROM v_photo_events),
g AS (SELECT *, count_if(cut) OVER (PARTITION BY session_id ORDER BY captured_at ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS part FROM e),
v AS (SELECT session_id, part, view_idx, count(*) AS n, max(captured_at) AS last_at, arg_max(removed, (captured_at, seq)) AS gone,
  arg_max(n_damages, (captured_at, seq)) AS found FROM g GROUP BY ALL),
s AS (SELECT session_id, count_if(NOT gone) AS n_views, sum(n)::BIGINT AS n_photos, sum(n - 1)::BIGINT AS n_retakes, count_if(gone) AS n_removed,
  coalesce(sum(found) FILTER (WHERE NOT gone), 0)::BIGINT AS n_damages, max(last_at) + INTERVAL 30 MINUTE AS closed_at FROM v GROUP BY session_id, part)
SELECT * FROM s WHERE closed_at <= (SELECT max(captured_at) - INTERVAL 10 MINUTE FROM v_photo_events)""")
def _(t):
    photos = stream_of(t, "v_photo_events").withColumn("captured_at", F.col("captured_at").cast("timestamp"))
    return scans.drain(t.spark, scans.session_photos(photos), "sessions")


@query("t03_stream_windows", """
SELECT * FROM (SELECT time_bucket(INTERVAL 6 HOUR, captured_at, TIMESTAMP '2000-01-01') AS chunk_start, time_bucket(INTERVAL 6 HOUR, captured_at, TIMESTAMP '2000-01-01') + INTERVAL 6 HOUR AS chunk_end, count(*) AS n
  FROM v_photo_events GROUP BY ALL) s WHERE chunk_end <= (SELECT max(captured_at) - INTERVAL 10 MINUTE FROM v_photo_events)""")
def _(t):
    rows = stream_of(t, "v_photo_events").withColumn("captured_at", F.col("captured_at").cast("timestamp"))
    return scans.drain(t.spark, scans.coverage_windows(rows, "captured_at"), "coverage")


WEEK = "least(floor((day(created_at) - 1) / 8), 3)"


@query("t04_stream_upsert", f"""
WITH r AS (SELECT *, {WEEK} AS w FROM v_predictions WHERE NOT failed)
SELECT image_id, model, created_at, seq, n_damages FROM r QUALIFY row_number() OVER (PARTITION BY image_id, model ORDER BY w, created_at, seq) = 1""")
def _(t):
    """Results that arrive week by week: a stored one is a cache hit."""
    return stream_upserts(t, force=False)


@query("t04_stream_upsert_forced", f"""
WITH r AS (SELECT *, {WEEK} AS w FROM v_predictions WHERE NOT failed)
SELECT image_id, model, created_at, seq, n_damages FROM r QUALIFY row_number() OVER (PARTITION BY image_id, model ORDER BY w DESC, created_at DESC, seq DESC) = 1""")
def _(t):
    return stream_upserts(t, force=True)


def stream_upserts(t: Tables, force: bool) -> DataFrame:
    rows = t.predictions
    tables = VersionedTables(t.spark, scratch_path(t.spark, "predictions"))
    tables.create({upserts.TABLE: (rows.drop("failed").where(F.lit(False)), "image_id")})
    landing, checkpoint = scratch_path(t.spark, "landing"), scratch_path(t.spark, "upserts-log")
    for week in range(4):
        rows.where(F.expr(f"{WEEK} = {week}")).write.parquet(f"{landing}/week={week}")
        stream = t.spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(landing)
        upserts.run_upserts(stream, tables, "results", checkpoint, force)
    return tables.read(upserts.TABLE)


@query("t02_stream_scan_sessions", """
WITH e AS (SELECT *, lag(kind) OVER w AS before, lag(captured_at) OVER w AS before_at FROM v_scan_events WINDOW w AS (PARTITION BY session_id ORDER BY captured_at, seq)),
g AS (SELECT *, count_if(before IS NULL OR before = 'finalize' OR kind = 'start' OR captured_at - before_at > INTERVAL 30 MINUTE)
  OVER (PARTITION BY session_id ORDER BY captured_at, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS part FROM e),
b AS (SELECT session_id, part, arg_min(kind, (captured_at, seq)) AS first_kind, arg_max(kind, (captured_at, seq)) AS last_kind, min(captured_at) AS started_at,
  max(captured_at) AS last_at FROM g GROUP BY ALL),
c AS (SELECT *, lead(first_kind) OVER w AS next_kind, lead(started_at) OVER w AS next_at FROM b WINDOW w AS (PARTITION BY session_id ORDER BY part)),
s AS (SELECT session_id, part, started_at, CASE WHEN last_kind = 'finalize' THEN 'finalized' WHEN next_kind = 'start' AND next_at - last_at <= INTERVAL 30 MINUTE THEN 'next_start' ELSE 'idle' END AS reason,
  CASE WHEN last_kind = 'finalize' THEN last_at WHEN next_kind = 'start' AND next_at - last_at <= INTERVAL 30 MINUTE THEN next_at ELSE last_at + INTERVAL 30 MINUTE END AS closed_at
  FROM c WHERE first_kind <> 'finalize'),
v AS (SELECT session_id, part, CASE WHEN view_idx BETWEEN 0 AND 11 THEN view_idx ELSE -1 END AS slot, count(*) AS n, arg_max(kind, (captured_at, seq)) = 'remove' AS gone,
  arg_max(n_damages, (captured_at, seq)) AS found FROM g WHERE kind IN ('photo', 'remove') GROUP BY ALL)
SELECT s.session_id, started_at, closed_at, reason, coalesce(count_if(NOT gone), 0) AS n_views, coalesce(sum(n), 0)::BIGINT AS n_photos, coalesce(sum(n - 1), 0)::BIGINT AS n_retakes,
  coalesce(count_if(gone), 0) AS n_removed, coalesce(sum(found) FILTER (WHERE NOT gone), 0)::BIGINT AS n_damages
FROM s LEFT JOIN v ON s.session_id = v.session_id AND s.part = v.part WHERE closed_at <= (SELECT max(captured_at) - INTERVAL 10 MINUTE FROM v_scan_events)
GROUP BY s.session_id, s.part, started_at, closed_at, reason""")
def _(t):
    """Sessions that end at a finalize, at the next start, or when idle."""
    events = stream_of(t, "v_scan_events").withColumn("captured_at", F.col("captured_at").cast("timestamp"))
    with sessions.rocksdb_state(t.spark):
        return scans.drain(t.spark, sessions.scan_sessions(events), "scan-sessions")
