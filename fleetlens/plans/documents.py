"""Evaluation of detections and annotators, and sampling plans."""

from pyspark.sql import functions as F

from fleetlens.functions import scalars as S
from fleetlens.operators import damages as D
from fleetlens.operators import evaluation as E
from fleetlens.operators import images as I
from fleetlens.plans import common as X
from fleetlens.plans.joins import IOU_SQL
from fleetlens.plans.registry import query, relation
from fleetlens.plans.sources import register_docs
from fleetlens.sources import readers


def predicted(t):
    return t.detections.where(F.col("source") == "model")


def gold(t):
    return t.detections.where(F.col("source") == "human")


def matches(t):
    return E.match_detections(predicted(t), gold(t))


# Greedy matching, one recursion step per prediction of an image, label and model.
relation("r_pred", """
SELECT *, row_number() OVER (PARTITION BY image_id, model, label ORDER BY coalesce(confidence, 0) DESC, det_id) AS rk FROM v_detections WHERE source = 'model'""")
relation("r_match_pairs", f"""
SELECT image_id, model, label, rk, det_id, list({{'gold_id': gold_id, 'iou': iou}} ORDER BY iou DESC, gold_id) FILTER (WHERE iou >= 0.5) AS options FROM (
  SELECT a.image_id, a.model, a.label, a.rk, a.det_id, b.det_id AS gold_id, {IOU_SQL} AS iou
  FROM r_pred a LEFT JOIN (SELECT * FROM v_detections WHERE source = 'human') b ON a.image_id = b.image_id AND a.label = b.label) s
GROUP BY ALL""")
FREE = "list_filter(coalesce(p.options, []), lambda o: NOT list_contains(m.used, o.gold_id))"
relation("r_match_fold", f"""
SELECT image_id, model, label, rk, det_id, p.options[1] AS pick, CASE WHEN p.options IS NULL THEN [] ELSE [p.options[1].gold_id] END AS used FROM r_match_pairs p WHERE rk = 1
UNION ALL
SELECT p.image_id, p.model, p.label, p.rk, p.det_id, {FREE}[1], CASE WHEN len({FREE}) > 0 THEN list_append(m.used, {FREE}[1].gold_id) ELSE m.used END
FROM r_match_fold m JOIN r_match_pairs p ON m.image_id = p.image_id AND m.model = p.model AND m.label = p.label AND p.rk = m.rk + 1""")
relation("r_matches", """
SELECT image_id, model, label, det_id, pick.gold_id AS gold_id, pick.iou AS iou FROM r_match_fold WHERE pick IS NOT NULL""")


@query("d01_match_detections", "SELECT image_id, model, label, det_id, gold_id, round(iou, 9) AS iou FROM r_matches")
def _(t):
    return matches(t).withColumn("iou", F.round("iou", 9))


@query("d02_precision_recall", """
WITH n AS (SELECT model, label, count(*) AS n_pred FROM r_pred GROUP BY ALL), g AS (SELECT label, count(*) AS n_gold FROM v_detections WHERE source = 'human' GROUP BY ALL),
m AS (SELECT model, label, count(*) AS tp FROM r_matches GROUP BY ALL)
SELECT a.model, a.label, coalesce(tp, 0) AS tp, coalesce(n_pred, 0) - coalesce(tp, 0) AS fp, coalesce(n_gold, 0) - coalesce(tp, 0) AS fn,
  round(coalesce(tp, 0) / nullif(coalesce(n_pred, 0), 0), 9) AS precision, round(coalesce(tp, 0) / n_gold, 9) AS recall
FROM (SELECT x.model, g.label FROM (SELECT DISTINCT model FROM n) x, g UNION SELECT model, label FROM n) a
LEFT JOIN n USING (model, label) LEFT JOIN m USING (model, label) LEFT JOIN g USING (label)""")
def _(t):
    return E.precision_recall(matches(t), predicted(t), gold(t))


relation("r_ap", """
SELECT x.model, g.gl AS label, round(coalesce(sum(tp / n_gold * p_max), 0), 9) AS ap50
FROM (SELECT DISTINCT model FROM r_pred) x CROSS JOIN (SELECT label AS gl, count(*) AS n_gold FROM v_detections WHERE source = 'human' GROUP BY ALL) g
LEFT JOIN (
  SELECT *, max(p) OVER (PARTITION BY model, label ORDER BY confidence ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p_max FROM (
    SELECT *, sum(tp) OVER w / sum(n) OVER w AS p FROM (
      SELECT r.model, r.label, coalesce(r.confidence, 0) AS confidence, count(m.det_id) AS tp, count(*) AS n
      FROM r_pred r LEFT JOIN r_matches m ON r.image_id = m.image_id AND r.model = m.model AND r.det_id = m.det_id GROUP BY ALL) s
    WINDOW w AS (PARTITION BY model, label ORDER BY confidence DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) q) z
ON label = gl AND z.model = x.model GROUP BY x.model, g.gl""")


@query("d03_average_precision", "SELECT * FROM r_ap")
def _(t):
    return E.average_precision(matches(t), predicted(t), gold(t))


@query("d03_map50", "SELECT model, round(avg(ap50), 8) AS map50, count(*) AS n_classes FROM r_ap GROUP BY model")
def _(t):
    return E.mean_average_precision(E.average_precision(matches(t), predicted(t), gold(t)))


@query("d04_mean_iou", "SELECT model, count(*) AS n_matches, round(avg(iou), 9) AS mean_iou, avg(iou) >= 0.75 AS on_target FROM r_matches GROUP BY model")
def _(t):
    return E.mean_iou(matches(t))


@query("d05_cohen_kappa", """
SELECT n AS n_items, round(same / n, 9) AS observed, round(chance / (n * n), 9) AS expected, round((same / n - chance / (n * n)) / (1 - chance / (n * n)), 9) AS kappa FROM (
  SELECT count(*) AS n, count_if(rater_a = rater_b) AS same,
    count_if(rater_a = 1) * count_if(rater_b = 1) + count_if(rater_a = 0) * count_if(rater_b = 0) AS chance FROM v_raters) s""")
def _(t):
    return E.cohen_kappa(t.raters)


@query("d06_model_agreement", f"""
SELECT n.model, o.model AS other_model, coalesce(n_met, 0) AS n_met, n_boxes, round(coalesce(n_met, 0) / n_boxes, 9) AS rate
FROM (SELECT model, count(*) AS n_boxes FROM v_detections GROUP BY ALL) n JOIN (SELECT DISTINCT model FROM v_detections) o ON n.model <> o.model LEFT JOIN (
  SELECT model, other_model, count(*) AS n_met FROM (
    SELECT DISTINCT a.image_id, a.det_id, a.model, b.model AS other_model
    FROM v_detections a JOIN v_detections b ON a.image_id = b.image_id AND a.model <> b.model WHERE {IOU_SQL} >= 0.5) s GROUP BY ALL) m
ON m.model = n.model AND m.other_model = o.model""")
def _(t):
    return E.model_agreement(t.detections)


@query("d08_confidence_route", """
SELECT model, CASE WHEN confidence > 0.85 THEN 'high' WHEN confidence < 0.5 THEN 'low' ELSE 'medium' END AS route, count(*) AS n FROM v_detections GROUP BY ALL""")
def _(t):
    return t.detections.groupBy("model", S.confidence_route(F.col("confidence")).alias("route")).agg(F.count("*").alias("n"))


def classed_images(t):
    """Images with the class of their car's first damage, or clean."""
    first = X.images(t).select("image_id", "plate", "view", "plate_original")
    classes = D.damage_classes(t.damages).select("plate_original", F.get("damage_classes", F.lit(0)).alias("c"))
    return first.join(classes, "plate_original", "left").select(
        "image_id", "plate", "view", F.coalesce("c", F.lit("clean")).alias("damage_class")
    )


@query("d09_stratified_images", """
WITH c AS (SELECT image_id, plate, view, coalesce(damage_classes[1], 'clean') AS damage_class, md5(concat('plan:', image_id)) AS d
  FROM v_images LEFT JOIN r_classes ON v_images.plate_original = r_classes.plate_original),
p AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY plate ORDER BY d, image_id) <= 5)
SELECT image_id, plate, view, damage_class, row_number() OVER (PARTITION BY view, damage_class ORDER BY d, image_id) AS place FROM p QUALIFY place <= 20""")
def _(t):
    return E.stratified_images(classed_images(t), quota=20, per_car=5)


def _share(x):
    return f"'{int(x * 2**32):08x}'"


@query("d10_split_gold_train", f"""
SELECT image_id, plate, CASE WHEN substr(md5(concat('split:', plate)), 1, 8) < {_share(0.1)} THEN 'gold'
  WHEN substr(md5(concat('split:', plate)), 1, 8) < {_share(0.2)} THEN 'val' ELSE 'train' END AS split FROM v_images""")
def _(t):
    return E.split_by_car(t.images.select("image_id", "plate"))


@query("d11_double_annotate_sample", f"""
SELECT image_id, substr(md5(concat('qa:', image_id)), 1, 8) < {_share(0.10)} AS second_annotator, substr(md5(concat('qa-spot:', image_id)), 1, 8) < {_share(0.05)} AS spot_check FROM v_images""")
def _(t):
    return E.double_annotate(t.images.select("image_id"))


@query("d12_format_mismatch", """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'webp' WHEN 2 THEN 'png' ELSE 'unknown' END AS found, 'jpeg' AS claimed, doc_id % 4 <> 0 AS mismatch FROM documents""")
def _(t):
    lead = F.when(F.col("doc_id") % 4 == 0, "FFD8FFE0").when(F.col("doc_id") % 4 == 1, "524946460000000057454250").when(
        F.col("doc_id") % 4 == 2, "89504E470D0A1A0A").otherwise("3C")
    files = t.documents.select(
        F.concat(F.lit("file:/damage/"), F.col("doc_id").cast("string"), F.lit(".jpeg")).alias("path"),
        F.concat(F.unhex(lead), F.encode("text", "UTF-8")).alias("content"),
    )
    return I.content_format(files).select(F.regexp_extract("path", r"(\d+)\.jpeg", 1).cast("long").alias("doc_id"), "found", "claimed", "mismatch")


@query("d13_projection_filter", """
SELECT plate_original, CAST(case_id AS VARCHAR) AS case_id, damage_id, concat('P', i) AS projection, view FROM v_damages, range(1, 3) r(i),
  (VALUES ('P1', 'EXTERIOR_FRONT_STRAIGHT'), ('P1', 'DIAGONAL_FRONT_LEFT'), ('P2', 'EXTERIOR_REAR_STRAIGHT')) m(projection, view)
WHERE i <= n_coords AND m.projection = concat('P', i)""")
def _(t):
    flat = readers.flatten_register(register_docs(t).withColumn("source_pos", F.lit(0)))
    mapping = t.spark.createDataFrame(
        [("P1", "EXTERIOR_FRONT_STRAIGHT"), ("P1", "DIAGONAL_FRONT_LEFT"), ("P2", "EXTERIOR_REAR_STRAIGHT")], "projection string, view string"
    )
    marked = D.damages_per_coordinate(flat).select("plate_original", "case_id", "damage_id", "projection")
    return D.projection_filter(marked, mapping)


@query("d14_view_false_positive_rate", """
SELECT view, count(*) AS n_pred, count_if(m.det_id IS NULL) AS n_fp, round(count_if(m.det_id IS NULL) / count(*), 9) AS fp_rate, round(count_if(tile_idx >= 0) / count(*), 9) AS tile_rate
FROM r_pred r JOIN v_images i ON r.image_id = i.image_id LEFT JOIN r_matches m ON r.image_id = m.image_id AND r.model = m.model AND r.det_id = m.det_id GROUP BY view""")
def _(t):
    return E.view_false_positives(matches(t), predicted(t), t.images)


@query("d15_new_damage_since", f"""
SELECT image_id, det_id, label FROM v_detections a WHERE source = 'model' AND NOT EXISTS (
  SELECT 1 FROM v_detections b WHERE b.source = 'human' AND b.image_id = a.image_id AND {IOU_SQL} >= 0.3)""")
def _(t):
    return E.new_damage_since(gold(t), predicted(t), ["image_id"]).select("image_id", "det_id", "label")
