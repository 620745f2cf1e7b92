"""Input schemas, as Spark DDL. Unknown fields of a source are ignored, missing ones read as NULL."""

PHOTO_EXPORT = (
    "license_plate STRING, tasks ARRAY<STRUCT<task_id: STRING, completed_at: STRING, "
    "photos: ARRAY<STRUCT<type: STRING, urls: ARRAY<STRING>>>>>"
)

REGISTER_PLATE = (
    "STRUCT<damage_cases: ARRAY<STRUCT<damage_case_id: STRING, damage_created_at: STRUCT<seconds: STRING>, "
    "damages: ARRAY<STRUCT<damage_id: STRING, type: STRING, part: STRING, side: STRING, severity: STRING, "
    "`group`: STRING, localized_values: STRUCT<part: STRING, severity: STRING>, "
    "coordinates: ARRAY<STRUCT<projection: STRING, segment: STRING, "
    "photos: ARRAY<STRUCT<photo_id: STRING, type: STRING, url: STRING>>>>>>>>>"
)

ATTEMPT = (
    "STRUCT<attempt: INT, http_status: INT, bytes_sent: BIGINT, bytes_received: BIGINT, latency_ms: BIGINT, "
    "error: STRING, will_retry: BOOLEAN>"
)
CALL = (
    "STRUCT<tile_idx: INT, http_status: INT, bytes_sent: BIGINT, bytes_received: BIGINT, latency_ms: BIGINT, "
    f"prompt_tokens: BIGINT, completion_tokens: BIGINT, error: STRING, attempts: ARRAY<{ATTEMPT}>>"
)
DETECTION = (
    "STRUCT<bbox_2d: ARRAY<DOUBLE>, label: STRING, confidence: DOUBLE, severity: STRING, panel: STRING, "
    "reasoning: STRING, is_cluster: BOOLEAN, cluster_size: INT, source: STRING>"
)
PHOTO = (
    "view STRING, idx INT, captured_at STRING, original_file STRING, model STRING, model_id STRING, "
    f"tile_mode BOOLEAN, max_side_setting INT, auto_retry_count INT, calls ARRAY<{CALL}>, "
    "analysis STRUCT<n_pre_nms: INT, n_post_nms: INT, n_after_cluster_filter: INT, n_reflection_clusters: INT, "
    f"damages: ARRAY<{DETECTION}>>"
)
SESSION = (
    "session_id STRING, status STRING, started_at STRING, ended_at STRING, plate STRING, "
    "session_settings STRUCT<model: STRING, model_id: STRING, tile_mode: BOOLEAN>, expected_views ARRAY<STRING>, "
    "aggregates STRUCT<n_errors: BIGINT>"
)
RESPONSE = f"damages ARRAY<{DETECTION}>, visible_damages ARRAY<{DETECTION}>"
