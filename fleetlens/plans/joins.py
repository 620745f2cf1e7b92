"""Joins."""

from pyspark.sql import functions as F

from fleetlens.functions import scalars as S
from fleetlens.operators import cars as C
from fleetlens.operators import damages as D
from fleetlens.operators import dedup, selection, store
from fleetlens.operators import detections as DET
from fleetlens.plans import common as X
from fleetlens.plans.registry import query, relation
from fleetlens.plans.sources import register_docs, session_logs
from fleetlens.sources import readers


@query("j01_images_cars", """
SELECT image_id, view, plate_safe, car_score FROM v_images JOIN v_store_cars ON plate = plate_safe""")
def _(t):
    images = t.images.select("image_id", "view", F.col("plate").alias("plate_safe"))
    return images.join(t.store_cars.select("plate_safe", "car_score"), "plate_safe")


@query("j02_annotations_images", """
SELECT id, v_images.image_id, label, view FROM v_annotations JOIN v_images ON v_annotations.image_id = v_images.image_id WHERE source = 'human'""")
def _(t):
    human = t.annotations.where(F.col("source") == "human").select("id", "image_id", "label")
    return human.join(t.images.select("image_id", "view"), "image_id")


COUNTS = """
SELECT plate_safe, plate_original, car_score, n_unique_views, n_damages, coalesce(is_test, 0) AS is_test,
  (SELECT count(*) FROM v_images i WHERE i.plate = c.plate_safe) AS n_images,
  (SELECT count(*) FROM v_annotations a JOIN v_images i ON a.image_id = i.image_id WHERE i.plate = c.plate_safe AND a.source = 'human') AS n_human_annos
FROM v_store_cars c"""


def _store_images(t):
    return t.images.select("image_id", F.col("plate").alias("plate_safe"), "view")


@query("j03_car_counts", COUNTS)
def _(t):
    return C.with_counts(t.store_cars, _store_images(t), t.annotations)


@query("j04_cars_register", """
SELECT r_car_base.plate_safe, coalesce(plate_original, r_car_base.plate_safe) AS plate_original, coalesce(n_damages, 0) AS n_damages,
  coalesce(n_damage_cases, 0) AS n_damage_cases FROM r_car_base LEFT JOIN r_register ON r_car_base.plate_safe = r_register.plate_safe""")
def _(t):
    plates = t.images.select(F.col("plate").alias("plate_safe")).distinct()
    return C.attach_register(plates, C.register_counts(t.damages))


@query("j05_type_map", f"SELECT damage_class, count(*) AS n FROM (SELECT {X.CLASS_CASE} AS damage_class FROM v_damages) s GROUP BY damage_class")
def _(t):
    return t.damages.groupBy(S.damage_class(F.col("type")).alias("damage_class")).agg(F.count("*").alias("n"))


@query("j06_has_predictions", """
SELECT image_id, m.model, EXISTS (SELECT 1 FROM v_predictions p WHERE p.image_id = v_images.image_id AND p.model = m.model) AS has_prediction
FROM v_images, (VALUES ('pro'), ('flash'), ('pro#tiled'), ('flash#tiled')) m(model)""")
def _(t):
    return store.prediction_flags(t.images, t.predictions, ["pro", "flash"])


@query("j07_images_of_selected", """
SELECT image_id, plate, view FROM v_images WHERE plate IN (SELECT plate_safe FROM v_store_cars
  WHERE car_score >= (SELECT min(car_score) FROM (SELECT car_score FROM v_store_cars ORDER BY car_score DESC LIMIT 500) s))""")
def _(t):
    chosen = C.top_n(t.store_cars, 500).where("selected")
    return selection.images_of(t.images.select("image_id", "plate", "view"), chosen)


@query("j08_remaining_work", """
SELECT image_id, plate FROM v_images WHERE image_id NOT IN (SELECT image_id FROM v_predictions WHERE NOT failed)""")
def _(t):
    return store.remaining(t.images.select("image_id", "plate"), t.predictions.where(~F.col("failed")), ["image_id"])


@query("j09_damages_before_photo", "SELECT plate_original, case_id, pos, is_late FROM r_flagged")
def _(t):
    return D.flag_late_cases(t.damages, t.plate_photo_time).select("plate_original", "case_id", "pos", "is_late")


relation("r_case_photos", """
SELECT plate_original, CAST(case_id AS VARCHAR) AS case_id, concat(damage_id, '.', i) AS photo_id,
  CASE WHEN case_id % 2 = 0 THEN 'DETAIL' ELSE 'UNKNOWN' END AS photo_type,
  CASE WHEN case_id % 5 <> 0 THEN concat('https://img.invalid/d/', pos, CASE WHEN case_id % 3 = 0 THEN '' ELSE
    concat('?X-Amz-Date=2024', lpad(CAST(1 + case_id % 12 AS VARCHAR), 2, '0'), lpad(CAST(1 + pos % 28 AS VARCHAR), 2, '0'), 'T101500Z') END) END AS url
FROM v_damages, range(1, 3) r(i) WHERE i <= n_coords""")


@query("j10_case_photos", """
SELECT plate_original, case_id, photo_id, photo_type FROM r_case_photos
WHERE (plate_original, case_id) IN (SELECT plate_original, CAST(case_id AS VARCHAR) FROM r_visible)""")
def _(t):
    photos = readers.flatten_register_photos(register_docs(t).withColumn("source_pos", F.lit(0))).drop("url")
    cases = X.visible(t).withColumn("case_id", F.col("case_id").cast("string"))
    return D.case_photos(cases, photos)


IOU_SQL = """
CASE WHEN least(a.ymax, b.ymax) > greatest(a.ymin, b.ymin) AND least(a.xmax, b.xmax) > greatest(a.xmin, b.xmin) THEN
  (least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin)) * (least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin))
  / ((a.ymax - a.ymin) * (a.xmax - a.xmin) + (b.ymax - b.ymin) * (b.xmax - b.xmin)
     - (least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin)) * (least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin)))
ELSE 0 END"""


@query("j11_overlap_pairs", f"""
SELECT image_id, det_id, other_det_id, round(iou, 9) AS iou FROM (
  SELECT a.image_id, a.det_id, b.det_id AS other_det_id, {IOU_SQL} AS iou
  FROM v_detections a JOIN v_detections b ON a.image_id = b.image_id AND a.det_id < b.det_id) s WHERE iou >= 0.4""")
def _(t):
    rows = t.detections.select("image_id", "det_id", "ymin", "xmin", "ymax", "xmax")
    pairs = DET.overlap_pairs(rows, rows, ["image_id"], 0.4, F.col("det_id") < F.col("other_det_id"))
    return pairs.select("image_id", "det_id", "other_det_id", F.round("iou", 9).alias("iou"))


relation("r_hashes", "SELECT min(image_id) AS id, w0, w1, w2, w3 FROM v_images GROUP BY w0, w1, w2, w3")
relation("r_hash_pairs", """
SELECT a.id AS a, b.id AS b, bit_count(xor(a.w0, b.w0))::INT + bit_count(xor(a.w1, b.w1))::INT + bit_count(xor(a.w2, b.w2))::INT + bit_count(xor(a.w3, b.w3))::INT AS distance
FROM r_hashes a, r_hashes b WHERE a.id < b.id
  AND bit_count(xor(a.w0, b.w0))::INT + bit_count(xor(a.w1, b.w1))::INT + bit_count(xor(a.w2, b.w2))::INT + bit_count(xor(a.w3, b.w3))::INT <= 6""")


@query("j12_near_duplicate_pairs", """
SELECT a, b, CAST(distance AS INT) AS distance FROM r_hash_pairs
UNION ALL
SELECT id, image_id, 0 FROM r_hashes h JOIN v_images i ON h.w0 = i.w0 AND h.w1 = i.w1 AND h.w2 = i.w2 AND h.w3 = i.w3 WHERE id <> image_id""")
def _(t):
    return dedup.near_duplicate_pairs(X.images(t).select("image_id", "phash"))


@query("j13_sessions_photos", """
SELECT session_id, concat('VIEW_', view_idx) AS view, CASE WHEN k % 3 <> 0 THEN 'finalized' ELSE 'unknown' END AS status,
  CASE WHEN k % 3 <> 0 THEN n_errors ELSE 0 END AS n_errors
FROM r_sessions JOIN (SELECT CAST(floor((call_id + attempt - 1) / 12) AS BIGINT) AS k, view_idx FROM v_attempts) e USING (k)""")
def _(t):
    rows = readers.sessions_from_logs(*session_logs(t))
    return rows.select(
        "session_id", F.explode("photos").alias("p"), F.coalesce("status", F.lit("unknown")).alias("status"),
        F.coalesce("n_errors", F.lit(0)).alias("n_errors"),
    ).select("session_id", "p.view", "status", "n_errors")


@query("j14_insert_scan_car", """
WITH page AS (SELECT plate_safe, car_score, n_damages, coalesce(is_test, 0) AS is_test FROM v_store_cars
  WHERE n_damages > 0 OR coalesce(is_test, 0) = 1 ORDER BY 4 DESC, car_score DESC, plate_safe LIMIT 100),
listed AS (SELECT *, CAST(row_number() OVER (ORDER BY is_test DESC, car_score DESC, plate_safe) AS DOUBLE) AS order_key FROM page)
SELECT * FROM listed
UNION ALL
SELECT 'BRANCH_PICTURE', 100, (SELECT count(*) FROM events), 1, coalesce((SELECT order_key FROM listed WHERE plate_safe = 'M_50'), 1) + 0.5""")
def _(t):
    page = C.page(t.store_cars.select("plate_safe", "car_score", "n_damages", "is_test"))
    extra = t.events.agg(F.count("*").alias("n_damages")).select(
        F.lit("BRANCH_PICTURE").alias("plate_safe"), F.lit(100.0).alias("car_score"), "n_damages", F.lit(1).alias("is_test")
    )
    return C.insert_after(page, extra, "M_50")
