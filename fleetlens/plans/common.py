"""Inputs shared by the registered queries, and the relations their checks share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.operators import cars as C
from fleetlens.operators import damages as D
from fleetlens.operators import dedup, quality, selection
from fleetlens.plans.registry import relation
from fleetlens.plans.standins import Tables


def joined(c: str | Column, sep: str = ",") -> Column:
    """Array as text, so that results compare across engines."""
    return F.array_join(c, sep)


def images(t: Tables) -> DataFrame:
    """The image manifest with its hash as 64 hex digits."""
    digits = [F.lower(F.lpad(F.hex(w), 16, "0")) for w in dedup.WORDS]
    return t.images.withColumn("phash", F.concat(*digits)).drop(*dedup.WORDS)


def scored(t: Tables) -> DataFrame:
    return quality.hard_fail(quality.image_score(images(t)))


def cars(t: Tables) -> DataFrame:
    return selection.scored_cars(images(t), t.damages)


def plain_cars(t: Tables) -> DataFrame:
    """Cars with register counts but without the score."""
    return C.car_aggregate(scored(t), C.register_counts(t.damages))


def visible(t: Tables) -> DataFrame:
    return D.visible_damages(t.damages, t.plate_photo_time)


def _norm(column: str, marks: str) -> str:
    return f"greatest(least(({column} - {marks}[1]) / greatest({marks}[2] - {marks}[1], 1e-9), 1.0), 0.0)"


relation("r_marks", """
SELECT quantile_cont(sharpness, [0.05, 0.95]) AS m1, quantile_cont(contrast, [0.05, 0.95]) AS m2,
  quantile_cont(saturation, [0.05, 0.95]) AS m3, quantile_cont(CAST(least(width, height) AS DOUBLE), [0.05, 0.95]) AS m4,
  quantile_cont(overexp_pct, [0.05, 0.95]) AS m5, quantile_cont(underexp_pct, [0.05, 0.95]) AS m6
FROM v_images""")

relation("r_scored", f"""
SELECT v_images.*,
  round_even((0.35 * {_norm('sharpness', 'm1')} + 0.20 * {_norm('contrast', 'm2')} + 0.10 * {_norm('saturation', 'm3')}
    + 0.10 * {_norm('CAST(least(width, height) AS DOUBLE)', 'm4')} + 0.15 * (1 - {_norm('overexp_pct', 'm5')})
    + 0.10 * (1 - {_norm('underexp_pct', 'm6')})) * 100 * 10, 0) / 10 AS quality_score,
  list_filter([CASE WHEN least(width, height) < 800 THEN 'low_resolution' END, CASE WHEN sharpness < 30 THEN 'very_blurry' END,
    CASE WHEN brightness < 40 THEN 'too_dark' END, CASE WHEN brightness > 220 THEN 'too_bright' END,
    CASE WHEN overexp_pct > 10 THEN 'burnt_out' END, CASE WHEN underexp_pct > 30 THEN 'black_out' END,
    CASE WHEN saturation < 10 THEN 'monochrome' END], lambda r: r IS NOT NULL) AS reasons
FROM v_images, r_marks""")

relation("r_cut", """
SELECT coalesce(quantile_cont(quality_score, 0.65) FILTER (WHERE len(reasons) = 0), 100) AS score_cut FROM r_scored""")

relation("r_filtered", """
SELECT r_scored.*, len(reasons) > 0 AS is_hard_fail, score_cut, quality_score >= score_cut AS score_pass,
  len(reasons) = 0 AND quality_score >= score_cut AS keep_pre_dedup,
  CASE WHEN len(reasons) = 0 AND quality_score < score_cut THEN ['below_score_threshold'] ELSE reasons END AS filter_reasons
FROM r_scored, r_cut""")

CLASS_CASE = """CASE type WHEN 'TYPE_SCRATCH' THEN 'scratch' WHEN 'TYPE_STONE_CHIP' THEN 'stone_chip' WHEN 'TYPE_STONE_CHIP_WITH_CRACK' THEN 'stone_chip'
  WHEN 'TYPE_DENT' THEN 'dent' WHEN 'TYPE_DENTED' THEN 'dent' WHEN 'TYPE_CRACK' THEN 'crack' WHEN 'TYPE_HOLE' THEN 'crack'
  WHEN 'TYPE_BROKEN' THEN 'crack' WHEN 'TYPE_MISSING' THEN 'missing' WHEN 'TYPE_LOOSE' THEN 'missing'
  WHEN 'TYPE_CRASH' THEN 'major' WHEN 'TYPE_HAIL_DAMAGE' THEN 'major' ELSE 'other' END"""

relation("r_classes", f"""
SELECT plate_original, list_sort(list(DISTINCT {CLASS_CASE})) AS damage_classes FROM v_damages GROUP BY plate_original""")

relation("r_register", """
SELECT plate_original, regexp_replace(plate_original, '[^A-Za-z0-9._-]+', '_', 'g') AS plate_safe,
  count(*) AS n_damages, count(DISTINCT case_id) AS n_damage_cases FROM v_damages GROUP BY plate_original""")

relation("r_car_base", """
SELECT plate AS plate_safe, count(*) AS n_images,
  count(DISTINCT CASE WHEN view NOT IN ('exterior_legacy', 'UNKNOWN') THEN view END) AS n_unique_views,
  count(DISTINCT CASE WHEN view NOT IN ('exterior_legacy', 'UNKNOWN') THEN view END) / 10 AS completeness,
  count_if(len(reasons) > 0) AS n_hard_fail, count_if(len(reasons) > 0) / count(*) AS hard_fail_pct,
  coalesce(round_even(sum(CAST(round_even(quality_score * 10, 0) AS BIGINT)) FILTER (WHERE len(reasons) = 0) / count(*) FILTER (WHERE len(reasons) = 0), 0) / 10, 0) AS mean_quality,
  coalesce(round_even(quantile_cont(round_even(quality_score * 10, 0), 0.5) FILTER (WHERE len(reasons) = 0), 0) / 10, 0) AS median_quality,
  coalesce(min(quality_score) FILTER (WHERE len(reasons) = 0), 0) AS min_quality
FROM r_scored GROUP BY plate""")

relation("r_car_counts", """
SELECT r_car_base.*, coalesce(plate_original, r_car_base.plate_safe) AS plate_original,
  coalesce(n_damages, 0) AS n_damages, coalesce(n_damage_cases, 0) AS n_damage_cases
FROM r_car_base LEFT JOIN r_register ON r_car_base.plate_safe = r_register.plate_safe""")

relation("r_car_marks", """
SELECT quantile_cont(mean_quality, [0.05, 0.95]) AS c1, quantile_cont(hard_fail_pct, [0.05, 0.95]) AS c2,
  quantile_cont(min_quality, [0.05, 0.95]) AS c3 FROM r_car_counts""")

relation("r_cars", f"""
SELECT r_car_counts.*, coalesce(damage_classes, []) AS damage_classes,
  round_even((0.40 * {_norm('mean_quality', 'c1')} + 0.30 * completeness + 0.15 * (1 - {_norm('hard_fail_pct', 'c2')})
    + 0.15 * {_norm('min_quality', 'c3')}) * 100 * 10, 0) / 10 AS car_score
FROM r_car_counts CROSS JOIN r_car_marks LEFT JOIN r_classes ON r_car_counts.plate_original = r_classes.plate_original""")

relation("r_flagged", """
SELECT v_damages.*, coalesce(case_ts >= photo_ts, false) AS is_late
FROM v_damages LEFT JOIN v_plate_photo_time ON v_damages.plate_original = v_plate_photo_time.plate_original""")

relation("r_first", """
SELECT * FROM r_flagged WHERE NOT is_late
QUALIFY row_number() OVER (PARTITION BY plate_original, case_id, coalesce(damage_id, '') ORDER BY pos) = 1""")

relation("r_visible", f"""
SELECT plate_original, case_id, damage_id, type, {CLASS_CASE} AS master_class,
  coalesce(nullif(part_local, ''), nullif(part, ''), '?') AS part, side,
  lower(replace(replace(coalesce(nullif(severity_local, ''), nullif(severity, ''), ''), 'SEVERITY_', ''), '_', ' ')) AS severity, grp
FROM r_first WHERE coalesce(grp, '') NOT IN ('WINDOWS', 'TYRES')""")

relation("r_calls", """
SELECT session_id, call_id, sum(bytes_sent)::BIGINT AS bytes_sent, sum(bytes_received)::BIGINT AS bytes_received,
  sum(latency_ms)::BIGINT AS latency_ms, count_if(attempt > 1) AS retry_count,
  arg_max(view_idx, attempt) AS view_idx, arg_max(tile_idx, attempt) AS tile_idx, arg_max(http_status, attempt) AS http_status,
  CASE WHEN bool_or(attempt = 2) THEN max(error) FILTER (WHERE attempt = 2) ELSE max(error) END AS error,
  arg_max(prompt_tokens, attempt) AS prompt_tokens, arg_max(completion_tokens, attempt) AS completion_tokens,
  arg_max(model, attempt) AS model, arg_max(tile_mode, attempt) AS tile_mode, arg_max(max_side, attempt) AS max_side,
  arg_max(captured_at, attempt) AS captured_at
FROM v_attempts GROUP BY session_id, call_id""")

relation("r_photos", """
SELECT session_id, view_idx, count(*) AS n_calls, max(latency_ms) AS latency_ms, sum(bytes_sent)::BIGINT AS bytes_sent,
  sum(bytes_received)::BIGINT AS bytes_received, sum(prompt_tokens)::BIGINT AS prompt_tokens,
  sum(completion_tokens)::BIGINT AS completion_tokens, sum(retry_count)::BIGINT AS retry_count,
  bool_or(error IS NOT NULL) AS had_error, max(captured_at) AS captured_at, arg_max(model, call_id) AS model,
  arg_max(tile_mode, call_id) AS tile_mode, arg_max(max_side, call_id) AS max_side,
  sum(prompt_tokens) / 1000000.0::DOUBLE * CASE WHEN arg_max(model, call_id) = 'flash' THEN 0.075::DOUBLE ELSE 1.25::DOUBLE END
    + sum(completion_tokens) / 1000000.0::DOUBLE * CASE WHEN arg_max(model, call_id) = 'flash' THEN 0.3::DOUBLE ELSE 5.0::DOUBLE END AS usd
FROM r_calls GROUP BY session_id, view_idx""")
