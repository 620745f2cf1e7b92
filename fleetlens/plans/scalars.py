"""Row-level expressions over whole tables."""

from pyspark.sql import functions as F

from fleetlens.functions import boxes as B
from fleetlens.functions import scalars as S
from fleetlens.functions import vocab as V
from fleetlens.operators import detections as DET
from fleetlens.plans import common as X
from fleetlens.plans.registry import query
from fleetlens.plans.sources import export_photos, export_tasks
from fleetlens.sources import readers


def _case(column, table, default):
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {default} END"


@query("p01_slug", """
SELECT c_custkey, trim(regexp_replace(concat(' #', c_name, '/', c_mktsegment, '! '), '[^A-Za-z0-9._-]+', '_', 'g'), '_') AS slug FROM customer""")
def _(t):
    name = F.concat(F.lit(" #"), "c_name", F.lit("/"), "c_mktsegment", F.lit("! "))
    return t.customer.select("c_custkey", S.slug(name).alias("slug"))


@query("p02_plate_slug", """
SELECT o_orderkey, coalesce(nullif(regexp_replace(CASE o_orderstatus WHEN 'P' THEN '##' WHEN 'F' THEN NULL ELSE concat('M ', o_custkey, '/', o_orderpriority) END, '[^A-Za-z0-9-]', '', 'g'), ''), 'no-plate') AS slug,
  concat(strftime(o_orderdate, '%Y-%m-%d_%H-%M-%S'), '_', coalesce(nullif(regexp_replace(CASE o_orderstatus WHEN 'P' THEN '##' WHEN 'F' THEN NULL ELSE concat('M ', o_custkey, '/', o_orderpriority) END, '[^A-Za-z0-9-]', '', 'g'), ''), 'no-plate'), '_', lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0')) AS folder
FROM orders""")
def _(t):
    plate = F.when(F.col("o_orderstatus") == "P", "##").when(
        F.col("o_orderstatus") != "F",
        F.concat(F.lit("M "), F.col("o_custkey").cast("string"), F.lit("/"), "o_orderpriority"),
    )
    suffix = F.lpad((F.col("o_orderkey") % 1000000).cast("string"), 6, "0")
    return t.orders.select(
        "o_orderkey", S.session_slug(plate).alias("slug"), S.session_folder(F.col("o_orderdate"), plate, suffix).alias("folder")
    )


@query("p03_extract_view", """
SELECT image_id, CASE WHEN view = 'UNKNOWN' THEN 'UNKNOWN' WHEN image_id % 24 = 10 THEN 'exterior_legacy' WHEN view = 'exterior_legacy' THEN 'UNKNOWN' ELSE view END AS view FROM v_images""")
def _(t):
    legacy = F.when(F.col("image_id") % 24 == 10, F.concat(F.hex("image_id"), F.lit("_0.jpg"))).otherwise("Photo_0.jpg")
    number = F.col("image_id").cast("string")
    name = F.when(F.col("view") == "exterior_legacy", F.lower(legacy)).when(
        F.col("view") == "UNKNOWN", F.concat(number, F.lit("_0.png"))
    ).otherwise(F.concat(number, F.lit("_"), "view", F.lit("_0.jpg")))
    return t.images.select("image_id", S.view_of(F.when(F.col("image_id") % 24 == 22, "Photo_0.jpg").otherwise(name)).alias("view"))


@query("p04_hard_fail_reasons", """
SELECT image_id, array_to_string(reasons, ',') AS reasons, len(reasons) > 0 AS hard_fail FROM r_scored""")
def _(t):
    reasons = S.hard_fail_reasons()
    return t.images.select("image_id", X.joined(reasons).alias("reasons"), (F.size(reasons) > 0).alias("hard_fail"))


@query("p05_damage_class", f"SELECT case_id, pos, {X.CLASS_CASE} AS damage_class FROM v_damages")
def _(t):
    return t.damages.select("case_id", "pos", S.damage_class(F.col("type")).alias("damage_class"))


@query("p06_damage_fields", """
SELECT case_id, pos, coalesce(nullif(part_local, ''), nullif(part, ''), '?') AS part,
  lower(replace(replace(coalesce(nullif(severity_local, ''), severity, ''), 'SEVERITY_', ''), '_', ' ')) AS severity FROM v_damages""")
def _(t):
    return t.damages.select(
        "case_id", "pos", S.damage_part(F.col("part_local"), F.col("part")).alias("part"),
        S.damage_severity(F.col("severity_local"), F.col("severity")).alias("severity"),
    )


@query("p07_exterior_type_filter", """
SELECT photo_type, count(*) AS n FROM r_export_photos WHERE photo_type <> 'INTERIOR' GROUP BY photo_type""")
def _(t):
    return export_photos(t).where(S.is_exterior(F.col("photo_type"))).groupBy("photo_type").agg(F.count("*").alias("n"))


@query("p08_image_filename", """
SELECT task_id, idx, CASE photo_type WHEN 'exterior' THEN concat(task_id, '_', idx, '.jpg') ELSE concat(task_id, '_', photo_type, '_', idx, '.jpg') END AS exterior_name,
  concat(photo_type, '__', task_id, '.jpeg') AS damage_name, printf('%02d_%s.jpg', idx, photo_type) AS session_name FROM r_export_photos""")
def _(t):
    return export_photos(t).select(
        "task_id", "idx", S.exterior_filename(F.col("task_id"), F.col("photo_type"), F.col("idx")).alias("exterior_name"),
        S.damage_filename(F.col("photo_type"), F.col("task_id")).alias("damage_name"),
        S.session_filename(F.col("idx"), F.col("photo_type")).alias("session_name"),
    )


@query("p09_group_filter", """
SELECT grp, count(*) AS n FROM v_damages WHERE coalesce(grp, '') NOT IN ('WINDOWS', 'TYRES') GROUP BY grp""")
def _(t):
    return t.damages.where(S.group_allowed(F.col("grp"))).groupBy("grp").agg(F.count("*").alias("n"))


@query("p10_signature_time", """
SELECT url, coalesce(nullif(regexp_extract(url, 'X-Amz-Date=([0-9]{8}T[0-9]{6}Z)', 1), ''), '99999999T999999Z') AS signed FROM r_export_photos""")
def _(t):
    return export_photos(t).select("url", S.signature_time(F.col("url")).alias("signed"))


@query("p11_safe_timestamp", """
SELECT task_id, CASE WHEN completed_at LIKE '____-%' THEN CAST(replace(completed_at, 'T', ' ') AS TIMESTAMP) END AS completed FROM r_export_tasks""")
def _(t):
    return export_tasks(t).select("task_id", S.safe_timestamp(F.col("completed_at")).alias("completed"))


@query("p12_bbox_convert", """
SELECT image_id, det_id, round(xmin / 1000 * width, 6) AS px_x1, round(ymax / 1000 * height, 6) AS px_y2,
  xmin / 10 AS pct_x, (ymax - ymin) / 10 AS pct_h, round(xmin / 1000 * width / width * 1000, 6) AS back_xmin,
  round((xmax - xmin) / 1000 * width, 6) AS anno_px_w
FROM v_detections JOIN v_images USING (image_id)""")
def _(t):
    rows = t.detections.join(t.images.select("image_id", "width", "height"), "image_id")
    w, h = F.col("width"), F.col("height")
    x1, y1, x2, y2 = B.to_pixels(*B.corners(), w, h)
    px, _, _, ph = B.to_percent(*B.corners())
    _, back, _, _ = B.from_pixels(y1, x1, y2, x2, w, h)
    k = F.lit(1000.0)
    anno = B.unit_to_pixels(F.col("xmin") / k, F.col("ymin") / k, (F.col("xmax") - F.col("xmin")) / k, F.lit(0.0), w, h)
    return rows.select(
        "image_id", "det_id", F.round(x1, 6).alias("px_x1"), F.round(y2, 6).alias("px_y2"), px.alias("pct_x"),
        ph.alias("pct_h"), F.round(back, 6).alias("back_xmin"), F.round(anno[2], 6).alias("anno_px_w"),
    )


TILES = """
SELECT image_id, width, height, CAST(i AS INT) AS tile_idx, tile_x, tile_y,
  least(width, tile_x + CAST(floor(width * (1.0::DOUBLE / 3 + 0.1::DOUBLE)) AS INT)) - tile_x AS tile_w,
  least(height, tile_y + CAST(floor(height * (1.0::DOUBLE / 3 + 0.1::DOUBLE)) AS INT)) - tile_y AS tile_h
FROM (SELECT image_id, width, height, i,
  greatest(0, CAST(floor(width * (1.0::DOUBLE / 3) * (i % 3)) AS INT) - CASE WHEN i % 3 > 0 THEN CAST(floor(width * 0.1::DOUBLE / 2) AS INT) ELSE 0 END) AS tile_x,
  greatest(0, CAST(floor(height * (1.0::DOUBLE / 3) * (i // 3)) AS INT) - CASE WHEN i // 3 > 0 THEN CAST(floor(height * 0.1::DOUBLE / 2) AS INT) ELSE 0 END) AS tile_y
FROM v_images, range(9) r(i)) s"""


@query("p13_tiles", TILES)
def _(t):
    return B.add_tiles(t.images.select("image_id", "width", "height"))


@query("p14_rebase_tile_bbox", """
SELECT image_id, model, det_id, round(ymin, 6) AS ymin, round(xmin, 6) AS xmin, round(ymax, 6) AS ymax, round(xmax, 6) AS xmax, found_in FROM r_placed""")
def _(t):
    placed = DET.place_tiles(t.detections, t.images)
    return placed.select("image_id", "model", "det_id", *[F.round(c, 6).alias(c) for c in B.CORNERS], "found_in")


@query("p15_parse_response", """
SELECT image_id, tile_idx, det_id, det_id % 5 <> 4 AS parsed_ok,
  CASE WHEN det_id % 5 = 4 THEN CASE WHEN det_id % 4 = 3 THEN 'empty_response' ELSE 'parse_error' END END AS error, CASE WHEN det_id % 5 IN (0, 1, 3) THEN 1 ELSE 0 END AS n_detections,
  CASE WHEN det_id % 5 IN (0, 1, 3) THEN label END AS label, CASE WHEN det_id % 5 = 0 THEN CAST(0.5 AS DOUBLE) END AS confidence,
  CASE WHEN det_id % 5 IN (0, 1, 3) THEN box_text END AS box FROM v_responses""")
def _(t):
    d = F.get("detections", F.lit(0))
    return readers.parse_responses(t.responses).select(
        "image_id", "tile_idx", "det_id", "parsed_ok", "error", F.size("detections").alias("n_detections"), d["label"].alias("label"),
        d["confidence"].alias("confidence"),
        F.array_join(F.transform(d["bbox_2d"], lambda v: v.cast("bigint").cast("string")), ",").alias("box"),
    )


@query("p16_valid_bbox", """
SELECT image_id, det_id, CASE WHEN det_id % 5 = 0 THEN 1 ELSE 0 END AS n_short, 1 AS n_valid FROM v_detections""")
def _(t):
    whole = F.struct(F.array(*B.corners()).alias("bbox_2d"))
    bad = F.struct(F.when(F.col("det_id") % 5 == 0, F.array("ymin", "xmin", "ymax")).alias("bbox_2d"))
    rows = t.detections.select("image_id", "det_id", F.array(bad, whole).alias("d"))
    short = F.size(F.filter("d", lambda d: d["bbox_2d"].isNotNull() & (F.size(d["bbox_2d"]) != 4)))
    return rows.select("image_id", "det_id", short.alias("n_short"), F.size(B.valid_boxes(F.col("d"))).alias("n_valid"))


@query("p17_usd_cost", """
SELECT session_id, call_id, attempt, round(CASE WHEN tile_idx = 8 THEN 0 WHEN model = 'flash'
  THEN prompt_tokens / 1000000.0::DOUBLE * 0.075::DOUBLE + completion_tokens / 1000000.0::DOUBLE * 0.3::DOUBLE
  ELSE prompt_tokens / 1000000.0::DOUBLE * 1.25::DOUBLE + completion_tokens / 1000000.0::DOUBLE * 5.0::DOUBLE END, 9) AS usd FROM v_attempts""")
def _(t):
    model = F.when(F.col("tile_idx") == 8, "unheard-of").otherwise(F.col("model"))
    usd = S.usd_cost(model, F.col("prompt_tokens"), F.col("completion_tokens"))
    return t.attempts.select("session_id", "call_id", "attempt", F.round(usd, 9).alias("usd"))


@query("p18_position_hint", """
SELECT image_id, det_id, CASE WHEN confidence IS NULL THEN 'unbekannte Position' ELSE concat(
  CASE WHEN (ymin + ymax) / 2 < 333 THEN 'oben' WHEN (ymin + ymax) / 2 > 666 THEN 'unten' ELSE 'mittig' END, ' ',
  CASE WHEN (xmin + xmax) / 2 < 333 THEN 'links' WHEN (xmin + xmax) / 2 > 666 THEN 'rechts' ELSE 'Mitte' END) END AS position FROM v_detections""")
def _(t):
    ymax = F.when(F.col("confidence").isNotNull(), F.col("ymax"))
    return t.detections.select(
        "image_id", "det_id", S.position_hint(F.col("ymin"), F.col("xmin"), ymax, F.col("xmax")).alias("position")
    )


@query("p19_display_labels", f"""
SELECT case_id, pos, {_case('label', V.LABEL_TEXT, "concat(upper(substr(replace(label, '_', ' '), 1, 1)), substr(replace(label, '_', ' '), 2))")} AS label_text,
  {_case('lower(severity)', V.SEVERITY_TEXT, 'severity')} AS severity_text,
  concat(upper(substr(trim(replace(panel, '_', ' ')), 1, 1)), substr(trim(replace(panel, '_', ' ')), 2)) AS panel_text
FROM (SELECT case_id, pos, CASE WHEN type IS NULL THEN 'paint_chip' ELSE {X.CLASS_CASE} END AS label,
  CASE pos % 4 WHEN 0 THEN 'Light' WHEN 1 THEN 'medium' WHEN 2 THEN 'severe' ELSE severity END AS severity, concat('_driver_', lower(side)) AS panel FROM v_damages) s""")
def _(t):
    label = F.when(F.col("type").isNull(), "paint_chip").otherwise(S.damage_class(F.col("type")))
    turn = F.col("pos") % 4
    severity = F.when(turn == 0, "Light").when(turn == 1, "medium").when(turn == 2, "severe").otherwise(F.col("severity"))
    panel = F.concat(F.lit("_driver_"), F.lower("side"))
    return t.damages.select(
        "case_id", "pos", S.label_text(label).alias("label_text"), S.severity_text(severity).alias("severity_text"),
        S.panel_text(panel).alias("panel_text"),
    )


@query("p20_config_badge", """
SELECT session_id, call_id, attempt, concat(CASE model WHEN 'pro' THEN 'Pro' WHEN 'flash' THEN 'Flash' END, ' · ', CASE WHEN max_side = 4000 THEN 'Res?' ELSE CAST(max_side AS VARCHAR) END, ' · ', CASE WHEN tile_mode THEN 'Tile' ELSE 'Single' END) AS badge FROM v_attempts""")
def _(t):
    model = F.when(F.col("model") == "pro", "gemini").otherwise(F.col("model"))
    side = F.when(F.col("max_side") == 4000, 0).otherwise(F.col("max_side"))
    return t.attempts.select("session_id", "call_id", "attempt", S.config_badge(model, side, F.col("tile_mode")).alias("badge"))


@query("p21_split_model_mode", """
SELECT seq, split_part(model, '#', 1) AS base_model, model LIKE '%#tiled' AS tiled FROM v_predictions""")
def _(t):
    return t.predictions.select("seq", S.base_model(F.col("model")).alias("base_model"), S.is_tiled(F.col("model")).alias("tiled"))


@query("p22_branch_image_id", """
SELECT seq, CASE WHEN seq % 5 <> 0 THEN concat('pull', session_id % 3) END AS pull_id, CASE WHEN seq % 5 <> 0 THEN concat('s', session_id) END AS session_id,
  CASE WHEN seq % 5 <> 0 THEN concat('VIEW_', view_idx) END AS view FROM v_photo_events""")
def _(t):
    file = F.format_string("%02d_VIEW_%d.jpg", "view_idx", "view_idx")
    whole = F.concat_ws("::", F.lit("branch"), F.concat(F.lit("pull"), (F.col("session_id") % 3).cast("string")),
                        F.concat(F.lit("s"), F.col("session_id").cast("string")), file)
    text = F.when(F.col("seq") % 10 == 0, F.concat_ws("::", F.lit("branch"), file)).when(
        F.col("seq") % 5 == 0, F.replace(whole, F.lit("branch"), F.lit("other"))).otherwise(whole)
    p = S.scan_image_id(text)
    return t.photo_events.select("seq", p["pull_id"].alias("pull_id"), p["session_id"].alias("session_id"), p["view"].alias("view"))


@query("p23_whitelist_label", """
SELECT seq, CASE WHEN label IN ('scratch', 'stone_chip', 'dent', 'crack', 'missing', 'major', 'other') THEN label ELSE 'other' END AS label FROM v_annotation_log""")
def _(t):
    return t.annotation_log.select("seq", S.known_label(F.col("label")).alias("label"))


@query("p24_aspect_and_rounding", """
SELECT image_id, round_even(width / height * 1000, 0) / 1000 AS aspect_ratio, round_even(sharpness / 4 * 10, 0) / 10 AS quarter, round_even(overexp_pct / 8 * 100, 0) / 100 AS eighth FROM v_images""")
def _(t):
    return t.images.select(
        "image_id", S.round_even(F.col("width") / F.col("height"), 3).alias("aspect_ratio"),
        S.round_even(F.col("sharpness") / 4, 1).alias("quarter"), S.round_even(F.col("overexp_pct") / 8, 2).alias("eighth"),
    )


@query("p25_retryable", """
SELECT session_id, call_id, attempt, http_status = 0 OR http_status = 429 OR http_status >= 500 OR (session_id % 3 = 0) AS retryable FROM v_attempts""")
def _(t):
    text = F.when(F.col("session_id") % 3 == 0, "Connection reset by peer").when(F.col("session_id") % 3 == 1, "bad request")
    return t.attempts.select("session_id", "call_id", "attempt", S.is_retryable(F.col("http_status"), text).alias("retryable"))


@query("p26_truncate_text", "SELECT doc_id, substr(text, 1, 200) AS head FROM documents")
def _(t):
    return t.documents.select("doc_id", S.truncated(F.col("text")).alias("head"))
