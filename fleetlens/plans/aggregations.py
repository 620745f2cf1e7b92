"""Aggregations."""

from pyspark.sql import functions as F

from fleetlens.functions import scalars as S
from fleetlens.functions import vocab as V
from fleetlens.operators import cars as C
from fleetlens.operators import damages as D
from fleetlens.operators import dedup, quality, selection, store
from fleetlens.operators import detections as DET
from fleetlens.operators import telemetry as T
from fleetlens.plans import common as X
from fleetlens.plans.registry import query, relation
from fleetlens.plans.sources import export_tasks


@query("a01_image_score", "SELECT image_id, quality_score FROM r_scored")
def _(t):
    return quality.image_score(t.images).select("image_id", "quality_score")


@query("a02_score_cut", """
SELECT image_id, quality_score, score_pass, keep_pre_dedup, array_to_string(filter_reasons, ',') AS filter_reasons FROM r_filtered""")
def _(t):
    return quality.filtered_images(t.images).select(
        "image_id", "quality_score", "score_pass", "keep_pre_dedup", X.joined("filter_reasons").alias("filter_reasons")
    )


@query("a03_car_aggregate", """
SELECT plate_safe, plate_original, n_images, n_unique_views, completeness, n_hard_fail, round(hard_fail_pct, 9) AS hard_fail_pct,
  mean_quality, median_quality, min_quality, n_damages, n_damage_cases FROM r_car_counts""")
def _(t):
    return X.plain_cars(t).withColumn("hard_fail_pct", F.round("hard_fail_pct", 9))


@query("a04_car_score", "SELECT plate_safe, car_score FROM r_cars")
def _(t):
    return C.car_score(X.plain_cars(t)).select("plate_safe", "car_score")


@query("a05_reason_histogram", """
SELECT reason, count(*) AS n FROM (SELECT unnest(filter_reasons) AS reason FROM r_filtered) s GROUP BY reason
UNION ALL SELECT 'duplicates', count(*) FROM r_curated WHERE keep_pre_dedup AND NOT is_cluster_best""")
def _(t):
    return quality.reason_histogram(dedup.curate(X.images(t)))


@query("a06_keep_by_view", """
SELECT view, count_if(keep_pre_dedup) AS kept, count(*) AS total, round(100.0::DOUBLE * count_if(keep_pre_dedup) / count(*), 6) AS kept_pct FROM r_filtered GROUP BY view""")
def _(t):
    return quality.keep_by_view(quality.filtered_images(t.images), "keep_pre_dedup")


@query("a07_filter_summary", """
SELECT count(*) AS total, count_if(keep_pre_dedup) AS kept, count(*) - count_if(keep_pre_dedup) AS discarded, count_if(is_hard_fail) AS n_hard_fail,
  round(100.0::DOUBLE * count_if(keep_pre_dedup) / count(*), 6) AS kept_pct FROM r_filtered""")
def _(t):
    return quality.filter_summary(quality.filtered_images(t.images), "keep_pre_dedup")


@query("a08_visible_damages", "SELECT * FROM r_visible")
def _(t):
    return X.visible(t)


@query("a08_filter_stats", """
SELECT plate_original, sum(by_time)::BIGINT AS by_time, sum(by_group)::BIGINT AS by_group, sum(kept)::BIGINT AS kept FROM (
  SELECT plate_original, 1 AS by_time, 0 AS by_group, 0 AS kept FROM r_flagged WHERE is_late
  UNION ALL SELECT plate_original, 0, CASE WHEN grp IN ('WINDOWS', 'TYRES') THEN 1 ELSE 0 END, CASE WHEN grp IN ('WINDOWS', 'TYRES') THEN 0 ELSE 1 END FROM r_first) s
GROUP BY plate_original""")
def _(t):
    return D.filter_stats(t.damages, t.plate_photo_time)


@query("a09_store_stats", """
SELECT (SELECT count(*) FROM v_store_cars) AS cars, (SELECT count(*) FROM v_images) AS images,
  (SELECT count(*) FROM v_annotations WHERE source = 'human') AS human_annotations, (SELECT count(*) FROM v_predictions) AS predictions_cached,
  (SELECT count(DISTINCT i.plate) FROM v_annotations a JOIN v_images i ON a.image_id = i.image_id WHERE a.source = 'human') AS cars_with_annotations""")
def _(t):
    return store.store_stats(t.store_cars, t.images, t.annotations, t.predictions)


@query("a10_detections_per_model", """
SELECT model, count(det_id) AS n_detections, count(DISTINCT d.image_id) AS n_images_with_detections
FROM (SELECT model FROM v_predictions UNION SELECT model FROM v_detections) m LEFT JOIN v_detections d USING (model) GROUP BY model""")
def _(t):
    return DET.detections_per_model(t.detections, t.predictions)


@query("a11_label_summary", f"""
SELECT plate_original, string_agg(concat(n, '× ', cls), ' · ' ORDER BY n DESC, cls) AS summary, sum(n)::BIGINT AS n_total FROM (
  SELECT plate_original, {X.CLASS_CASE} AS cls, count(*) AS n FROM v_damages GROUP BY ALL) s GROUP BY plate_original""")
def _(t):
    return DET.label_summary(t.damages.withColumn("cls", S.damage_class(F.col("type"))), ["plate_original"], "cls")


@query("a12_damage_classes", "SELECT plate_original, array_to_string(damage_classes, ',') AS damage_classes FROM r_classes")
def _(t):
    return D.damage_classes(t.damages).select("plate_original", X.joined("damage_classes").alias("damage_classes"))


@query("a13_photo_time", """
SELECT plate_original, max(CAST(replace(completed_at, 'T', ' ') AS TIMESTAMP)) AS photo_ts FROM r_export_tasks WHERE completed_at LIKE '____-%' GROUP BY plate_original""")
def _(t):
    return D.photo_times(export_tasks(t))


@query("a14_run_totals", """
SELECT count(*) AS n_images, sum(CASE WHEN failed THEN 0 ELSE n_damages END)::BIGINT AS n_detections, sum(n_damages * 3)::BIGINT AS tokens_in, sum(seq % 7)::BIGINT AS tokens_out,
  round(sum(CASE WHEN failed THEN 0 ELSE n_damages END) / count(DISTINCT image_id % 100), 6) AS detections_per_car FROM v_predictions""")
def _(t):
    rows = t.predictions.select(
        F.concat(F.lit("M "), (F.col("image_id") % 100).cast("string")).alias("plate"),
        F.when(~F.col("failed"), F.col("n_damages")).alias("n_damages"),
        (F.col("n_damages") * 3).alias("tokens_in"), (F.col("seq") % 7).alias("tokens_out"),
    )
    return store.run_totals(rows)


def calls(t):
    return T.call_rollup(t.attempts)


def photos(t):
    return T.photo_rollup(calls(t)).withColumns({
        "n_damages": F.col("prompt_tokens") % 4, "auto_retry_count": F.col("retry_count") % 2,
    })


def with_views(rows):
    return rows.withColumn("view", F.concat(F.lit("VIEW_"), F.col("view_idx").cast("string")))


@query("a15_call_rollup", "SELECT * FROM r_calls")
def _(t):
    return calls(t)


@query("a16_photo_rollup", "SELECT * EXCLUDE (usd), round(usd, 9) AS usd FROM r_photos")
def _(t):
    return T.photo_rollup(calls(t)).withColumn("usd", F.round("usd", 9))


relation("r_session_totals", """
SELECT session_id, 12 AS n_expected_views, count(DISTINCT view_idx) AS n_completed_views, greatest(12 - count(DISTINCT view_idx), 0) AS n_missing_views,
  count(*) AS n_photos, sum(prompt_tokens % 4)::BIGINT AS n_damages_total, count_if(had_error) AS n_errors, sum(retry_count)::BIGINT AS n_retries,
  sum(retry_count % 2)::BIGINT AS n_auto_retries, sum(bytes_sent)::BIGINT AS total_bytes_sent, sum(bytes_received)::BIGINT AS total_bytes_received,
  sum(prompt_tokens)::BIGINT AS total_prompt_tokens, sum(completion_tokens)::BIGINT AS total_completion_tokens, round(sum(usd), 9) AS total_usd_estimated,
  round(avg(latency_ms) / 1000.0::DOUBLE, 9) AS avg_latency_s,
  (epoch_us(max(captured_at)) - epoch_us(min(captured_at))) / 1000000.0::DOUBLE AS duration_s,
  list_sort(list(latency_ms))[1 + least(CAST(floor(count(*) * 0.95::DOUBLE) AS BIGINT), count(*) - 1)] / 1000.0::DOUBLE AS p95_latency_s
FROM r_photos GROUP BY session_id""")


@query("a17_session_rollup", "SELECT * FROM r_session_totals")
def _(t):
    return T.session_rollup(photos(t))


VIEW_NAMES = [f"VIEW_{i}" for i in (3, 1, 4, 0, 5, 9, 2, 6, 8, 7, 10, 11, 12)]


@query("a18_view_coverage", f"""
SELECT session_id, string_agg(concat('VIEW_', view_idx), ',' ORDER BY view_idx) AS completed_views,
  array_to_string(list_filter({VIEW_NAMES}, lambda v: NOT list_contains(list(concat('VIEW_', view_idx)), v)), ',') AS missing_views FROM r_photos GROUP BY session_id""")
def _(t):
    rows = T.view_coverage(with_views(photos(t)), VIEW_NAMES)
    return rows.select("session_id", X.joined("completed_views").alias("completed_views"), X.joined("missing_views").alias("missing_views"))


@query("a19_class_coverage", """
SELECT damage_class, target, (SELECT count(*) FROM r_cars WHERE list_contains(damage_classes, damage_class)) AS n_cars
FROM (VALUES ('scratch', 150), ('stone_chip', 100), ('dent', 75), ('crack', 50), ('missing', 50), ('major', 25), ('other', 50)) v(damage_class, target)""")
def _(t):
    return selection.class_coverage(X.cars(t), V.STRATA_TARGETS)


@query("a20_metric_histogram", """
WITH long AS (SELECT 'sharpness' AS metric, greatest(sharpness, 0.001) AS value FROM v_images UNION ALL SELECT 'brightness', brightness FROM v_images
  UNION ALL SELECT 'contrast', contrast FROM v_images),
ends AS (SELECT metric, min(value) AS lo, max(value) AS hi FROM long GROUP BY metric)
SELECT metric, CAST(least(floor((value - lo) / (hi - lo) * 60), 59) AS INT) AS bin, count(*) AS n FROM long JOIN ends USING (metric) GROUP BY 1, 2""")
def _(t):
    return quality.metric_histogram(t.images, ["sharpness", "brightness", "contrast"], log=("sharpness",))


@query("a22_session_report", """
SELECT session_id, n_photos, n_damages_total, total_usd_estimated AS usd, avg_latency_s FROM r_session_totals""")
def _(t):
    return T.session_report(T.session_rollup(photos(t)))


@query("a23_tile_effectiveness", """
SELECT tile_idx, count(*) AS n_calls, round(avg(latency_ms), 6) AS avg_latency_ms, sum(completion_tokens)::BIGINT AS completion_tokens FROM r_calls GROUP BY tile_idx""")
def _(t):
    return T.tile_effectiveness(calls(t))


@query("a24_config_comparison", """
SELECT model, tile_mode, max_side, count(*) AS n_photos, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens,
  round(sum(usd), 9) AS usd, round(avg(latency_ms) / 1000.0::DOUBLE, 9) AS avg_latency_s, max(latency_ms) AS max_latency_ms FROM r_photos GROUP BY ALL""")
def _(t):
    return T.config_comparison(photos(t))


@query("a25_scan_case_summary", """
SELECT session_id, count(*) AS n_photos, sum(prompt_tokens % 4)::BIGINT AS n_damages, count_if(had_error) AS n_errors, arg_max(model, captured_at) AS model,
  session_id = (SELECT max(session_id) FROM r_photos) AS is_newest FROM r_photos GROUP BY session_id""")
def _(t):
    return T.case_summary(photos(t))


@query("a26_car_sheet", f"""
WITH n AS (SELECT plate_original, {X.CLASS_CASE} AS cls, coalesce(nullif(part_local, ''), part) AS p, side, substr(coalesce(nullif(severity_local, ''), severity), 1, 50) AS sev,
  row_number() OVER (PARTITION BY plate_original ORDER BY case_id, pos) AS rn FROM v_damages)
SELECT plate_original, count(*) AS n_damages, string_agg(concat_ws(' · ', cls, p, side, sev), ' | ' ORDER BY rn) FILTER (WHERE rn <= 30) AS rows,
  greatest(count(*) - 30, 0) AS n_more FROM n GROUP BY plate_original""")
def _(t):
    return D.car_sheet(t.damages)
