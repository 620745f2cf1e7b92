"""Sources. File-based readers work on documents that Spark first derives from the whole tables and writes
to the shared scratch folder."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.operators import store
from fleetlens.plans.registry import query, relation
from fleetlens.plans.standins import VIEWS, Tables
from fleetlens.session import scratch_path
from fleetlens.sources import readers, sinks

relation("r_export_tasks", """
SELECT plate_original, CAST(image_id AS VARCHAR) AS task_id,
  CASE WHEN o_orderstatus = 'P' THEN '' WHEN image_id % 7 = 0 THEN 'n/a' ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS completed_at
FROM v_images JOIN orders ON image_id = o_orderkey""")

relation("r_export_photos", """
SELECT plate_original, CAST(image_id AS VARCHAR) AS task_id,
  CASE view WHEN 'exterior_legacy' THEN 'exterior' WHEN 'UNKNOWN' THEN 'INTERIOR' ELSE view END AS photo_type, CAST(i AS INT) AS idx,
  concat('https://img.invalid/', image_id, '/', i, CASE WHEN image_id % 4 = 0 THEN '' ELSE
    concat('?X-Amz-Date=2024', lpad(CAST(1 + image_id % 12 AS VARCHAR), 2, '0'), lpad(CAST(1 + image_id % 28 AS VARCHAR), 2, '0'), 'T101500Z') END) AS url
FROM v_images, range(3) r(i) WHERE i <= image_id % 3""")


def export_docs(t: Tables) -> DataFrame:
    """One vehicle document per task, as an export by time chunk holds them."""
    rows = t.images.select("image_id", "plate_original", "view").join(
        t.orders.select(F.col("o_orderkey").alias("image_id"), "o_orderstatus", "o_orderdate"), "image_id"
    )
    key = F.col("image_id")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    stamp = F.when(key % 4 == 0, "").otherwise(
        F.concat(F.lit("?X-Amz-Date=2024"), two(1 + key % 12), two(1 + key % 28), F.lit("T101500Z"))
    )
    urls = F.transform(
        F.sequence(F.lit(0), (key % 3).cast("int")),
        lambda i: F.concat(F.lit("https://img.invalid/"), key.cast("string"), F.lit("/"), i.cast("string"), stamp),
    )
    kind = F.when(F.col("view") == "exterior_legacy", "exterior").when(F.col("view") == "UNKNOWN", "INTERIOR").otherwise(F.col("view"))
    done = F.when(F.col("o_orderstatus") == "P", "").when(key % 7 == 0, "n/a").otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    )
    task = F.struct(key.cast("string").alias("task_id"), done.alias("completed_at"),
                    F.array(F.struct(kind.alias("type"), urls.alias("urls"))).alias("photos"))
    return rows.select(F.col("plate_original").alias("license_plate"), F.array(task).alias("tasks"))


def export_tasks(t: Tables) -> DataFrame:
    return readers.flatten_tasks(export_docs(t))


def export_photos(t: Tables) -> DataFrame:
    return readers.flatten_photos(export_docs(t))


def register_docs(t: Tables) -> DataFrame:
    """(plate_original, payload): one keyed document per registered damage."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    signed = F.when(F.col("case_id") % 3 == 0, "").otherwise(F.concat(
        F.lit("?X-Amz-Date=2024"), two(1 + F.col("case_id") % 12), two(1 + F.col("pos") % 28), F.lit("T101500Z")
    ))
    mark = lambda i: F.struct(
        F.concat(F.lit("P"), i.cast("string")).alias("projection"), F.lit("S").alias("segment"),
        F.array(F.struct(
            F.concat("damage_id", F.lit("."), i.cast("string")).alias("photo_id"),
            F.when(F.col("case_id") % 2 == 0, "DETAIL").alias("type"),
            F.when(F.col("case_id") % 5 != 0, F.concat(F.lit("https://img.invalid/d/"), F.col("pos").cast("string"), signed)).alias("url"),
        )).alias("photos"),
    )
    coords = F.when(F.col("n_coords") > 0, F.transform(F.sequence(F.lit(1), F.greatest("n_coords", F.lit(1))), mark)).otherwise(
        F.array().cast("array<struct<projection:string,segment:string,photos:array<struct<photo_id:string,type:string,url:string>>>>")
    )
    damage = F.struct(
        "damage_id", "type", "part", "side", "severity", F.col("grp").alias("group"),
        F.struct(F.col("part_local").alias("part"), F.col("severity_local").alias("severity")).alias("localized_values"),
        coords.alias("coordinates"),
    )
    case = F.struct(
        F.col("case_id").cast("string").alias("damage_case_id"),
        F.struct(F.unix_timestamp("case_ts").cast("string").alias("seconds")).alias("damage_created_at"),
        F.array(damage).alias("damages"),
    )
    return t.damages.select("plate_original", F.struct(F.array(case).alias("damage_cases")).alias("payload"))


def register(t: Tables) -> DataFrame:
    return readers.flatten_register(register_docs(t).withColumn("source_pos", F.lit(0)))


@query("s01_read_manifest", "SELECT image_id, plate, view, width, height, sharpness FROM v_images")
def _(t):
    orders = readers.read_manifest(t.spark, f"{t.folder}/orders.parquet")
    return t.sql(VIEWS["v_images"], orders=orders).select("image_id", "plate", "view", "width", "height", "sharpness")


@query("s02_read_photo_export", "SELECT * FROM r_export_photos")
def _(t):
    path = scratch_path(t.spark, "photo-export")
    export_docs(t).write.json(path)
    return readers.flatten_photos(readers.read_photo_export(t.spark, path, multi_line=False))


@query("s02_read_whole_export", "SELECT * FROM r_export_photos")
def _(t):
    """Exports as they come: one JSON array per file."""
    path = scratch_path(t.spark, "whole-export")
    sinks.write_json_documents(export_docs(t).select(F.to_json(F.struct("license_plate", "tasks"))), path)
    return readers.flatten_photos(readers.read_photo_export(t.spark, path))


@query("s03_read_damage_register", """
SELECT plate_original, CAST(case_id AS VARCHAR) AS case_id, case_ts, damage_id, type, grp, side, part, part_local, severity, severity_local, n_coords FROM v_damages""")
def _(t):
    path = scratch_path(t.spark, "register")
    line = F.to_json(F.create_map("plate_original", "payload"))
    # compressed files are read whole: their lines are bounded, so that a task reads a bounded piece
    register_docs(t).select(line.alias("value")).write.option("maxRecordsPerFile", 500_000).text(path, compression="gzip")
    return flat_register(readers.read_damage_register(t.spark, path, whole_files=False))


def flat_register(register: DataFrame) -> DataFrame:
    return readers.flatten_register(register).select(
        "plate_original", "case_id", "case_ts", "damage_id", "type", "grp", "side", "part", "part_local", "severity",
        "severity_local", F.size("coordinates").alias("n_coords"),
    )


@query("s03_read_whole_register", """
SELECT plate_original, CAST(case_id AS VARCHAR) AS case_id, case_ts, damage_id, type, grp, side, part, part_local, severity, severity_local, n_coords FROM v_damages""")
def _(t):
    """Registers as they come: one JSON object per file, keyed by plate."""
    path = scratch_path(t.spark, "whole-register")
    text = register_docs(t).select(F.to_json(F.create_map("plate_original", "payload")).alias("text"))  # by itself, so that it is made once
    entries = text.select(F.substr("text", F.lit(2), F.length("text") - 2))
    # compressed documents are read whole: their entries are bounded, so that a task reads a bounded piece
    sinks.write_json_documents(entries, path, "{}", most=500_000, compression="gzip")
    return flat_register(readers.read_damage_register(t.spark, path))


@query("s04_scan_images", """
SELECT plate, concat(image_id, '_', view, '_0', suffix) AS filename, CASE WHEN view = 'exterior_legacy' THEN 'UNKNOWN' ELSE view END AS view, file_size
FROM (SELECT image_id, plate, view, CASE image_id % 4 WHEN 0 THEN '.jpg' WHEN 1 THEN '.JPEG' WHEN 2 THEN '.JPG' ELSE '.png' END AS suffix, width * height AS file_size FROM v_images) s
WHERE suffix <> '.png'""")
def _(t):
    turn = F.col("image_id") % 4
    suffix = F.when(turn == 0, ".jpg").when(turn == 1, ".JPEG").when(turn == 2, ".JPG").otherwise(".png")
    path = F.concat(F.lit("file:/photos/"), "plate", F.lit("/"), F.col("image_id").cast("string"), F.lit("_"), "view", F.lit("_0"), suffix)
    files = t.images.select(path.alias("path"), (F.col("width") * F.col("height")).alias("length"))
    return readers.image_files(files).drop("path")


@query("s05_scan_case_photos", """
SELECT replace(plate_original, ' ', '_') AS plate, CAST(case_id AS VARCHAR) AS case_id, CASE WHEN pos % 3 = 0 THEN 'UNKNOWN' ELSE coalesce(type, 'X') END AS photo_type,
  CASE WHEN pos % 3 = 0 THEN CAST(pos AS VARCHAR) ELSE concat(pos, '__b') END AS photo_id FROM v_damages""")
def _(t):
    pos = F.col("pos").cast("string")
    name = F.when(F.col("pos") % 3 == 0, F.concat(pos, F.lit(".jpg"))).otherwise(
        F.concat(F.coalesce("type", F.lit("X")), F.lit("__"), pos, F.lit("__b.jpeg"))
    )
    path = F.concat_ws("/", F.lit("file:/damage"), F.replace("plate_original", F.lit(" "), F.lit("_")), F.col("case_id").cast("string"), name)
    return readers.case_photo_files(t.damages.select(path.alias("path"))).drop("filename")


def session_logs(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(photo logs, session logs) as text. A session is twelve consecutive events, so its list is short."""
    e = t.attempts.withColumn("k", F.floor((F.col("call_id") + F.col("attempt") - 1) / 12))
    attempt = F.struct("attempt", "http_status", "bytes_sent", "bytes_received", "latency_ms", "error", F.lit(False).alias("will_retry"))
    call = F.struct("tile_idx", "http_status", "bytes_sent", "bytes_received", "latency_ms", "prompt_tokens", "completion_tokens", "error",
                    F.array(attempt).alias("attempts"))
    damage = F.struct(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(4.0)).alias("bbox_2d"),
                      F.when(F.col("view_idx") % 2 == 0, "dent").otherwise("rust").alias("label"), F.lit(0.5).alias("confidence"))
    photo = F.struct(
        F.concat(F.lit("VIEW_"), F.col("view_idx").cast("string")).alias("view"), F.col("view_idx").alias("idx"),
        F.date_format("captured_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("captured_at"), "model", "tile_mode",
        F.col("max_side").alias("max_side_setting"), F.array(call).alias("calls"),
        F.struct(F.array(damage).alias("damages")).alias("analysis"),
    )
    session = F.concat(F.lit("s"), F.lpad(F.col("k").cast("string"), 12, "0"))
    photos = e.groupBy("k").agg(F.collect_list(photo).alias("p")).select(
        session.alias("session_id"), F.when(F.col("k") % 10 == 0, "[broken").otherwise(F.to_json("p")).alias("text")
    )
    meta = e.groupBy("k").agg(F.min("model").alias("model"), F.count("error").alias("n_errors")).where(F.col("k") % 3 != 0).select(
        session.alias("session_id"),
        F.to_json(F.struct(F.lit("finalized").alias("status"), F.struct("model").alias("session_settings"),
                           F.struct("n_errors").alias("aggregates"))).alias("text"),
    )
    return photos, meta


relation("r_sessions", """
SELECT concat('s', lpad(CAST(k AS VARCHAR), 12, '0')) AS session_id, k, n_photos, model, n_errors FROM (
  SELECT CAST(floor((call_id + attempt - 1) / 12) AS BIGINT) AS k, count(*) AS n_photos, min(model) AS model, count(error) AS n_errors
  FROM v_attempts GROUP BY ALL) s WHERE k % 10 <> 0""")


@query("s06_read_sessions", """
SELECT session_id, n_photos, 'VIEW_0' AS first_view, CASE WHEN k % 3 <> 0 THEN 'finalized' END AS status,
  CASE WHEN k % 3 <> 0 THEN model END AS model, CASE WHEN k % 3 <> 0 THEN n_errors END AS n_errors FROM r_sessions""")
def _(t):
    rows = readers.sessions_from_logs(*session_logs(t))
    return rows.select(
        "session_id", F.size("photos").alias("n_photos"), F.get("photos", F.lit(0))["view"].alias("first_view"), "status", "model", "n_errors"
    )


def brand_files(t: Tables) -> DataFrame:
    path = F.concat(F.lit("file:/test/"), F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit("/"), F.col("p_partkey").cast("string"),
                    F.when(F.col("p_partkey") % 9 == 0, ".png").otherwise(".jpg"))
    side = F.when(F.col("p_size") == 1, -1).otherwise(F.col("p_size") * 20)
    return readers.brand_files(t.part.select(path.alias("path"), side.alias("width"), side.alias("height")))


@query("s07_load_test_cars", """
SELECT concat('TEST_', replace(p_brand, '#', '_')) AS plate_safe, concat('TEST_', p_partkey) AS view, CASE WHEN p_size = 1 THEN 0 ELSE p_size * 20 END AS width,
  CAST(100 AS DOUBLE) AS quality_score, 0 AS is_hard_fail FROM part WHERE p_partkey % 9 <> 0""")
def _(t):
    return store.cars_from_test_photos(brand_files(t))[1].drop("path", "height")


@query("s07_test_car_rows", """
SELECT concat('TEST_', replace(p_brand, '#', '_')) AS plate_safe, concat('TEST · ', replace(p_brand, '#', '_')) AS plate_original, CAST(100 AS DOUBLE) AS car_score,
  count(*) AS n_unique_views, 0 AS n_damages, 'test_case' AS damage_classes, 1 AS is_test FROM part WHERE p_partkey % 9 <> 0 GROUP BY p_brand""")
def _(t):
    return store.cars_from_test_photos(brand_files(t))[0]


@query("s08_time_chunks", """
WITH span AS (SELECT date_trunc('day', min(ts)) AS a, max(ts) AS b FROM events),
c AS (SELECT unnest(range(a, b, INTERVAL 6 HOUR)) AS chunk_start, b FROM span)
SELECT chunk_start, least(chunk_start + INTERVAL 6 HOUR, b) AS chunk_end,
  (SELECT count(*) FROM events WHERE ts >= chunk_start AND ts < chunk_start + INTERVAL 6 HOUR) AS n FROM c""")
def _(t):
    span = t.events.agg(F.date_trunc("day", F.min("ts")).alias("start_ts"), F.max("ts").alias("end_ts"))
    landed = readers.chunk_coverage(t.events, "ts").drop("chunk_end")
    return readers.time_chunks(span).join(landed, "chunk_start", "left").select(
        "chunk_start", "chunk_end", F.coalesce("n", F.lit(0)).alias("n")
    )
