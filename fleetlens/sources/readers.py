"""Sources: manifests, nested JSON documents, file trees, session logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens import schemas
from fleetlens.functions import boxes as B
from fleetlens.functions import scalars as S
from fleetlens.sources.json_parts import json_entries


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_photo_export(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Vehicles of a photo export: one JSON array per file, cut at its elements and so read by many tasks, or one array or object
    per line (``multi_line=False``)."""
    if not multi_line:
        return spark.read.schema(schemas.PHOTO_EXPORT).json(path)
    vehicle = F.from_json("entry", schemas.PHOTO_EXPORT)
    return json_entries(spark, path).select(vehicle.alias("v")).select("v.*")


def flatten_tasks(export: DataFrame) -> DataFrame:
    """One row per task; a vehicle without tasks gives none."""
    return export.select(
        F.coalesce("license_plate", F.lit("")).alias("plate_original"), F.explode("tasks").alias("t")
    ).select("plate_original", "t.task_id", "t.completed_at", "t.photos")


def flatten_photos(export: DataFrame) -> DataFrame:
    """One row per photo link, with its 0-based place in the list."""
    return (
        flatten_tasks(export)
        .select("plate_original", "task_id", F.explode("photos").alias("p"))
        .select("plate_original", "task_id", F.col("p.type").alias("photo_type"), F.posexplode("p.urls").alias("idx", "url"))
    )


def read_damage_register(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """(plate_original, source_pos, payload) of a register keyed by plate.

    A file is a single JSON object, cut at its keys and so read by many tasks, or has one keyed object per line
    (``whole_files=False``). ``source_pos`` grows in the order of the source, over files or lines and within an object.
    """
    kind = f"MAP<STRING, {schemas.REGISTER_PLATE}>"
    if whole_files:
        plates = json_entries(spark, path).select(F.col("pos").alias("line"), F.concat(F.lit("{"), "entry", F.lit("}")).alias("value"))
    else:
        plates = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), "value")
    return plates.select("line", F.posexplode(F.from_json("value", kind))).select(
        F.col("key").alias("plate_original"), (F.col("line") + F.col("pos")).alias("source_pos"), F.col("value").alias("payload")
    )


def flatten_register(register: DataFrame) -> DataFrame:
    """One row per damage. Plates without cases and cases without damages keep one row with NULLs."""
    cases = register.select(
        "plate_original", "source_pos", F.col("payload.damage_cases").isNull().alias("payload_empty"),
        F.posexplode_outer("payload.damage_cases").alias("case_pos", "c"),
    )
    rows = cases.select(
        "plate_original", "source_pos", "payload_empty", "case_pos",
        F.when(F.col("case_pos").isNotNull(), F.coalesce("c.damage_case_id", F.lit(""))).alias("case_id"),
        F.when(
            F.try_to_number("c.damage_created_at.seconds", F.lit("999999999999")) > 0,
            F.timestamp_seconds(F.try_to_number("c.damage_created_at.seconds", F.lit("999999999999")).cast("long")),
        ).alias("case_ts"),
        F.posexplode_outer("c.damages").alias("damage_pos", "d"),
    )
    return rows.select(
        "plate_original", "source_pos", "payload_empty", "case_pos", "case_id", "case_ts", "damage_pos",
        F.col("damage_pos").alias("pos"), "d.damage_id", "d.type", F.col("d.group").alias("grp"), "d.side",
        "d.part", F.col("d.localized_values.part").alias("part_local"), "d.severity",
        F.col("d.localized_values.severity").alias("severity_local"), "d.coordinates",
    )


def flatten_register_photos(register: DataFrame) -> DataFrame:
    """One row per register photo with its link."""
    return (
        flatten_register(register)
        .select("plate_original", F.col("case_id"), F.explode("coordinates").alias("c"))
        .select("plate_original", "case_id", F.explode("c.photos").alias("p"))
        .select("plate_original", "case_id", "p.photo_id", F.coalesce("p.type", F.lit("UNKNOWN")).alias("photo_type"), "p.url")
    )


def _is_jpeg(path: Column) -> Column:
    return F.lower(path).rlike(r"\.jpe?g$")


def image_files(files: DataFrame) -> DataFrame:
    """Plate (parent folder), file name and view of every JPEG in a file listing (path, length)."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.where(_is_jpeg(F.col("path"))).select(
        "path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("plate"), name.alias("filename"),
        S.view_of(name).alias("view"), F.col("length").alias("file_size"),
    )


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) below ``root``; the contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")


def scan_images(spark: SparkSession, root: str) -> DataFrame:
    return image_files(list_files(spark, root))


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """Decoded images; a broken file is kept with size -1."""
    return (
        spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.{jpg,jpeg,JPG,JPEG}").load(root)
    )


def case_photo_files(files: DataFrame) -> DataFrame:
    """``<plate>/<case>/<TYPE>__<id>.jpeg`` taken apart; names without ``__`` have type UNKNOWN."""
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    typed = stem.contains("__")
    pieces = F.split(stem, "__", 2)
    return files.where(_is_jpeg(F.col("path"))).select(
        F.regexp_extract("path", r"([^/]+)/[^/]+/[^/]+$", 1).alias("plate"),
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("case_id"),
        F.when(typed, pieces[0]).otherwise("UNKNOWN").alias("photo_type"),
        F.when(typed, F.get(pieces, F.lit(1))).otherwise(stem).alias("photo_id"),
        F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"),
    )


def scan_case_photos(spark: SparkSession, root: str) -> DataFrame:
    return case_photo_files(list_files(spark, root))


def brand_files(files: DataFrame) -> DataFrame:
    """Test photos: the folder is the brand."""
    return files.where(F.col("path").endswith(".jpg")).select(
        "path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("brand"),
        F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), "width", "height",
    )


def load_test_cars(spark: SparkSession, root: str) -> DataFrame:
    image = read_images(spark, root).select(
        F.col("image.origin").alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height")
    )
    return brand_files(image)


def log_files(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(session_id, text) of every ``<root>/<session>/<name>``."""
    text = spark.read.text(f"{root}/*/{name}", wholetext=True)
    return text.select(
        F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1).alias("session_id"), F.col("value").alias("text")
    )


def sessions_from_logs(photo_logs: DataFrame, session_logs: DataFrame) -> DataFrame:
    """One row per session with a readable photo log; the session log is optional.

    Both sides: (session_id, text). A photo log is a JSON array, its photos are returned in idx order.
    """
    photos = F.from_json("text", f"ARRAY<STRUCT<{schemas.PHOTO}>>")
    parsed = photo_logs.select("session_id", photos.alias("photos")).where(F.col("photos").isNotNull())
    by_idx = F.array_sort(
        "photos", lambda a, b: F.coalesce(a["idx"], F.lit(0)) - F.coalesce(b["idx"], F.lit(0))
    )
    meta = session_logs.select("session_id", F.from_json("text", schemas.SESSION).alias("s"))
    return parsed.join(meta, "session_id", "left").select(
        "session_id", by_idx.alias("photos"), F.col("s.status").alias("status"), F.col("s.plate").alias("plate"),
        F.col("s.session_settings.model").alias("model"), F.col("s.session_settings.tile_mode").alias("tile_mode"),
        F.col("s.expected_views").alias("expected_views"),
        F.col("s.aggregates.n_errors").alias("n_errors"),
    )


def read_sessions(spark: SparkSession, root: str) -> DataFrame:
    return sessions_from_logs(log_files(spark, root, "photos.json"), log_files(spark, root, "session.json"))


def flatten_attempts(sessions: DataFrame) -> DataFrame:
    """One row per attempt. Calls are numbered within the session by photo and place."""
    calls = sessions.select("session_id", F.explode("photos").alias("p")).select(
        "session_id", "p.view", F.col("p.idx").alias("view_idx"), "p.model", "p.tile_mode",
        F.col("p.max_side_setting").alias("max_side"), F.to_timestamp("p.captured_at").alias("captured_at"),
        F.posexplode("p.calls").alias("pos", "c"),
    )
    return calls.select(
        "session_id", "view", "view_idx", "model", "tile_mode", "max_side", "captured_at",
        (F.col("view_idx") * 1000 + F.col("pos")).alias("call_id"), "c.tile_idx",
        "c.prompt_tokens", "c.completion_tokens", F.explode("c.attempts").alias("a"),
    ).select(
        *["session_id", "view", "view_idx", "model", "tile_mode", "max_side", "captured_at", "call_id", "tile_idx",
          "prompt_tokens", "completion_tokens"],
        "a.attempt", "a.http_status", "a.error", "a.bytes_sent", "a.bytes_received", "a.latency_ms",
    )


def scan_damages(sessions: DataFrame) -> DataFrame:
    """Detections of scan sessions in the shape of register damages."""
    return (
        sessions.select("session_id", F.explode("photos").alias("p"))
        .select("session_id", F.coalesce("p.view", F.lit("UNKNOWN")).alias("view"), F.posexplode("p.analysis.damages").alias("pos", "d"))
        .select(
            "session_id",
            F.concat_ws(":", "session_id", "view", F.col("pos").cast("string")).alias("damage_id"),
            F.coalesce("d.label", F.lit("other")).alias("type"), S.known_label(F.col("d.label")).alias("master_class"),
            F.coalesce(S.filled(F.col("d.panel")), "view").alias("part"), F.col("view").alias("side"),
            F.coalesce("d.severity", F.lit("")).alias("severity"), F.lit("APP_SCAN").alias("grp"), "d.confidence",
        )
    )


def time_chunks(span: DataFrame, hours: int = 6) -> DataFrame:
    """Half-open chunks of ``span`` (one row: start_ts, end_ts); the last one is clipped."""
    step = F.make_dt_interval(hours=F.lit(hours))
    return (
        span.select(F.explode(F.sequence("start_ts", "end_ts", step)).alias("chunk_start"), "end_ts")
        .where(F.col("chunk_start") < F.col("end_ts"))
        .select("chunk_start", F.least(F.col("chunk_start") + step, F.col("end_ts")).alias("chunk_end"))
    )


def chunk_coverage(rows: DataFrame, ts: str, hours: int = 6) -> DataFrame:
    """Landed rows per chunk of a six-hour grid that starts at midnight."""
    return rows.groupBy(F.window(ts, f"{hours} hours").alias("w")).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("chunk_start"), F.col("w.end").alias("chunk_end"), "n"
    )


def parse_responses(responses: DataFrame) -> DataFrame:
    """Detections of raw model answers in ``raw``.

    Code fences are stripped, then the whole text or its outermost braces are read as JSON, strictly; ``damages``
    is used unless empty, else ``visible_damages``. Adds ``parsed_ok``, ``error`` (``empty_response``, ``parse_error`` or
    null) and ``detections`` (complete boxes only).
    """
    # a step that is used more than once is a column of its own, so that it runs once a row (inside from_json nothing is shared)
    raw = F.trim(F.make_valid_utf8("raw"))  # as the readers of JSON take it
    fenced = F.regexp_replace(raw, r"(?m)^```(?:json)?\s*|\s*```\s*$", "")
    bare, inner, first = F.col("_bare"), F.col("_inner"), F.instr("_bare", "{")
    size = F.length("_bare") - F.length(F.substring_index("_bare", "}", -1)) - first + 1  # up to the last closing brace
    rows = responses.withColumn("_bare", F.trim(F.when(raw.contains("```"), fenced).otherwise(raw)))
    rows = rows.withColumn("_inner", F.when((first > 0) & (size > 1), F.substr("_bare", first, size)))
    # from_json reads malformed text as a struct of nulls, so what is read must parse as an object first
    strict = lambda x: F.when(F.try_parse_json(x).isNotNull(), x)
    whole = F.when(inner.isNotNull() & bare.startswith("{"), strict(bare))  # without both braces there is no object
    rows = rows.withColumn("_t", F.coalesce(whole, F.when(inner != bare, strict(inner))))
    rows = rows.withColumn("_p", F.when(F.col("_t").isNotNull(), F.from_json("_t", schemas.RESPONSE)))
    some = F.when(F.size("_p.damages") > 0, F.col("_p.damages")).otherwise(F.col("_p.visible_damages"))
    error = F.when(F.coalesce(F.trim("raw"), F.lit("")) == "", "empty_response").when(F.col("_t").isNull(), "parse_error")
    return rows.withColumn("parsed_ok", F.col("_t").isNotNull()).withColumn("error", error).withColumn(
        "detections", B.valid_boxes(F.coalesce(some, F.array()))
    ).drop("_p", "_t", "_inner", "_bare")
