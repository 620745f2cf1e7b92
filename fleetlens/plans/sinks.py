"""Sinks and export formats."""

from functools import reduce

from pyspark.sql import functions as F

from fleetlens.operators import store
from fleetlens.plans import common as X
from fleetlens.plans.registry import query
from fleetlens.plans.sources import export_photos, register_docs
from fleetlens.session import scratch_path
from fleetlens.sources import readers, sinks


@query("k01_write_manifest", "SELECT image_id, plate, view, width, height, sharpness FROM v_images WHERE image_id % 17 <> 0")
def _(t):
    path = scratch_path(t.spark, "manifest")
    error = F.when(F.col("image_id") % 17 == 0, "image_read_failed")
    sinks.write_manifest(X.images(t).withColumn("error", error), path, partition_by=("view",))
    return readers.read_manifest(t.spark, path).select("image_id", "plate", "view", "width", "height", "sharpness")


def coco(t):
    name = F.concat(F.col("image_id").cast("string"), F.lit(".jpg"))
    images = t.images.select("image_id", name.alias("file_name"), "width", "height")
    return store.coco_export(t.annotations, images)


@query("k02_coco_categories", """
SELECT CAST(v.id AS INT) AS id, name, count(a.id) AS n_annotations
FROM (VALUES (1, 'scratch'), (2, 'stone_chip'), (3, 'dent'), (4, 'crack'), (5, 'missing'), (6, 'major'), (7, 'other')) v(id, name)
LEFT JOIN (SELECT a.id, CASE WHEN label IN ('scratch', 'stone_chip', 'dent', 'crack', 'missing', 'major') THEN label ELSE 'other' END AS label
  FROM v_annotations a JOIN v_images i ON a.image_id = i.image_id WHERE source = 'human') a ON a.label = name GROUP BY ALL""")
def _(t):
    """The categories, each with the annotations that the export holds of it."""
    categories, _, annotations = coco(t)
    used = annotations.groupBy(F.col("category_id").alias("id")).agg(F.count("*").alias("n_annotations"))
    return categories.join(used, "id", "left").fillna(0, ["n_annotations"])


COCO_IMAGES = """
SELECT row_number() OVER (ORDER BY first_id, image_id) AS id, image_id AS source_id, concat(image_id, '.jpg') AS file_name, width, height FROM (
  SELECT a.image_id, min(a.id) AS first_id, any_value(width) AS width, any_value(height) AS height
  FROM v_annotations a JOIN v_images i ON a.image_id = i.image_id WHERE a.source = 'human' GROUP BY a.image_id) s"""


@query("k02_coco_images", f"SELECT id, file_name, width, height FROM ({COCO_IMAGES}) c")
def _(t):
    return coco(t)[1]


@query("k02_coco_annotations", f"""
SELECT a.id, c.id AS image_id, CASE label WHEN 'scratch' THEN 1 WHEN 'stone_chip' THEN 2 WHEN 'dent' THEN 3 WHEN 'crack' THEN 4 WHEN 'missing' THEN 5 WHEN 'major' THEN 6 ELSE 7 END AS category_id,
  round(x * width, 6) AS bbox_x, round(h * height, 6) AS bbox_h, round(w * width * (h * height), 6) AS area, 0 AS iscrowd, severity, coalesce(paint_damaged <> 0, false) AS paint_damaged
FROM v_annotations a JOIN ({COCO_IMAGES}) c ON a.image_id = c.source_id WHERE source = 'human'""")
def _(t):
    return coco(t)[2].select(
        "id", "image_id", "category_id", F.round(F.get("bbox", F.lit(0)), 6).alias("bbox_x"),
        F.round(F.get("bbox", F.lit(3)), 6).alias("bbox_h"), F.round("area", 6).alias("area"), "iscrowd", "attributes.*",
    )


@query("k03_label_studio_result", """
SELECT image_id, tile_idx, det_id, CASE WHEN det_id % 5 IN (0, 1, 3) THEN 1 ELSE 0 END AS n_damages, CASE WHEN det_id % 5 = 0 THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS task_score,
  CASE WHEN det_id % 5 IN (0, 1, 3) THEN floor(xmin) / 10 END AS x, CASE WHEN det_id % 5 IN (0, 1, 3) THEN (floor(ymax) - floor(ymin)) / 10 END AS height,
  CASE WHEN det_id % 5 IN (0, 1, 3) THEN label END AS label, CASE WHEN det_id % 5 IN (0, 1, 3) THEN 0.5::DOUBLE END AS score FROM v_detections""")
def _(t):
    rows = sinks.label_studio_result(readers.parse_responses(t.responses))
    r = F.get("result", F.lit(0))
    return rows.select(
        "image_id", "tile_idx", "det_id", "n_damages", F.col("score").alias("task_score"), r["value"]["x"].alias("x"),
        r["value"]["height"].alias("height"), F.get(r["value"]["rectanglelabels"], F.lit(0)).alias("label"), r["score"].alias("score"),
    )


@query("k04_label_studio_tasks", """
SELECT image_id, concat('/data/local-files/?d=exterior_photos/', CASE WHEN image_id % 5 = 0 THEN '' ELSE concat(plate, '/') END, image_id, '.jpg') AS image FROM v_images""")
def _(t):
    number = F.col("image_id").cast("string")
    path = F.when(F.col("image_id") % 5 == 0, F.concat(number, F.lit(".jpg"))).otherwise(
        F.concat(F.lit("/srv/exterior_photos/"), "plate", F.lit("/"), number, F.lit(".jpg"))
    )
    return t.images.select("image_id", sinks.label_studio_task(path).alias("image"))


@query("k05_build_tables", """
WITH chosen AS (SELECT * FROM r_cars WHERE car_score >= 40)
SELECT 'cars' AS relation, plate_safe, plate_original, car_score, n_unique_views, n_damages, array_to_string(damage_classes, ',') AS damage_classes FROM chosen
UNION ALL BY NAME
SELECT 'images' AS relation, image_id, plate AS plate_safe, view, width, height, quality_score, CAST(len(reasons) > 0 AS INT) AS is_hard_fail FROM r_scored WHERE plate IN (SELECT plate_safe FROM chosen)
UNION ALL BY NAME
SELECT 'db_damages' AS relation, CONCAT('M_', substr(plate_original, 3)) AS plate_safe, damage_id, type, master_class, part, side, severity, projection, segment FROM (
  SELECT plate_original, damage_id, type, """ + X.CLASS_CASE + """ AS master_class, coalesce(nullif(part_local, ''), part) AS part, side,
    coalesce(nullif(severity_local, ''), severity) AS severity, CASE WHEN n_coords > 0 THEN concat('P', i) END AS projection, CASE WHEN n_coords > 0 THEN 'S' END AS segment
  FROM v_damages, range(1, 3) r(i) WHERE i <= greatest(n_coords, 1)) s
WHERE plate_original IN (SELECT plate_original FROM chosen)""")
def _(t):
    """The three tables of a first load, as they were written, one below the other."""
    root = scratch_path(t.spark, "store")
    chosen = X.cars(t).where(F.col("car_score") >= 40)
    flat = readers.flatten_register(register_docs(t).withColumn("source_pos", F.lit(0)))
    written = sinks.build_tables(t.spark, sinks.store_tables(chosen, X.scored(t), flat), root)
    parts = [t.spark.read.parquet(f"{root}/{name}").withColumn("relation", F.lit(name)) for name in written]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


@query("k06_checkpoint_append", "SELECT image_id, view FROM v_images")
def _(t):
    """A run that stopped after one view and was started again."""
    path = scratch_path(t.spark, "run")
    work = t.images.select("image_id", "view")
    sinks.append_checkpoint(work.where(F.col("view") == "EXTERIOR_FRONT_STRAIGHT"), path)
    sinks.append_checkpoint(sinks.remaining_after(t.spark, work, path, ["image_id"]), path)
    return t.spark.read.parquet(path)


@query("k07_exterior_downloads", """
SELECT url, concat('exterior_photos/', replace(plate_original, ' ', '_'), '/', task_id, CASE WHEN photo_type = 'exterior' THEN '' ELSE concat('_', photo_type) END, '_', idx, '.jpg') AS destination
FROM r_export_photos WHERE photo_type <> 'INTERIOR'""")
def _(t):
    return sinks.exterior_downloads(export_photos(t))


@query("k07_damage_downloads", """
SELECT url, concat('damage_photos/', replace(plate_original, ' ', '_'), '/', case_id, '/', photo_type, '__', photo_id, '.jpeg') AS destination FROM r_case_photos WHERE url IS NOT NULL""")
def _(t):
    return sinks.damage_downloads(readers.flatten_register_photos(register_docs(t).withColumn("source_pos", F.lit(0)))).drop("signed")
