"""Rankings, top-k and de-duplication by key."""

from pyspark.sql import functions as F

from fleetlens.functions import stats
from fleetlens.operators import cars as C
from fleetlens.operators import damages as D
from fleetlens.operators import quality, store
from fleetlens.operators import telemetry as T
from fleetlens.plans import common as X
from fleetlens.plans.aggregations import photos
from fleetlens.plans.algorithms import curated
from fleetlens.plans.registry import query, relation
from fleetlens.plans.sources import register_docs
from fleetlens.sources import readers, sinks


@query("w01_top_n_cars", """
SELECT plate_safe, car_score FROM v_store_cars WHERE car_score >= (SELECT min(car_score) FROM (SELECT car_score FROM v_store_cars ORDER BY car_score DESC LIMIT 500) s)""")
def _(t):
    return C.top_n(t.store_cars, 500).where("selected").select("plate_safe", "car_score")


@query("w02_border_cars", """
SELECT plate_safe, car_score, rk - 1 AS place FROM (SELECT plate_safe, car_score, row_number() OVER (ORDER BY car_score DESC, plate_safe) AS rk FROM v_store_cars) s
WHERE rk BETWEEN 498 AND 502""")
def _(t):
    return C.border(t.store_cars, 500).select("plate_safe", "car_score", "place")


relation("r_one_result", """
SELECT image_id, model, n_damages, created_at, seq FROM v_predictions WHERE NOT failed
QUALIFY row_number() OVER (PARTITION BY image_id, model ORDER BY created_at DESC, seq DESC) = 1""")


def stored(t):
    nothing = t.predictions.drop("failed").limit(0)
    return store.upsert_predictions(nothing, t.predictions, force=True)


@query("w05_latest_prediction", """
SELECT image_id, split_part(model, '#', 1) AS base_model, model LIKE '%#tiled' AS tiled, created_at, seq, n_damages FROM v_predictions WHERE NOT failed
QUALIFY row_number() OVER (PARTITION BY image_id, split_part(model, '#', 1) ORDER BY created_at DESC, seq DESC) = 1""")
def _(t):
    return store.latest_prediction(t.predictions.where(~F.col("failed")))


@query("w06_cached_predictions", """
SELECT image_id, string_agg(model, ',' ORDER BY model) AS models, sum(n_damages)::BIGINT AS n_damages FROM r_one_result GROUP BY image_id""")
def _(t):
    rows = store.cached_predictions(stored(t))
    total = F.aggregate(F.map_values("by_model"), F.lit(0).cast("long"), lambda a, e: a + e["n_damages"])
    return rows.select("image_id", X.joined(F.array_sort(F.map_keys("by_model"))).alias("models"), total.alias("n_damages"))


@query("w07_latest_photo_per_view", """
SELECT session_id, view_idx, captured_at, seq, n_damages FROM (
  SELECT * FROM v_photo_events QUALIFY row_number() OVER (PARTITION BY session_id, view_idx ORDER BY captured_at DESC, seq DESC) = 1) s WHERE NOT removed""")
def _(t):
    return T.latest_photo_per_view(t.photo_events)


@query("w08_dedup_damage_in_case", """
SELECT case_id, pos, damage_id, type FROM v_damages QUALIFY row_number() OVER (PARTITION BY plate_original, case_id, coalesce(damage_id, '') ORDER BY pos) = 1""")
def _(t):
    return D.first_in_case(t.damages).select("case_id", "pos", "damage_id", "type")


@query("w09_paged_cars", """
SELECT plate_safe, car_score, n_damages, coalesce(is_test, 0) AS is_test FROM v_store_cars WHERE n_damages > 0 OR coalesce(is_test, 0) = 1
ORDER BY 4 DESC, car_score DESC, plate_safe LIMIT 100 OFFSET 200""")
def _(t):
    return C.page(t.store_cars.select("plate_safe", "car_score", "n_damages", "is_test"), limit=100, offset=200)


@query("w10_sample_rows", """
WITH c AS (SELECT image_id, quality_score, keep_pre_dedup AND is_cluster_best AS keep FROM r_curated)
SELECT 'best' AS sample, image_id, quality_score FROM (FROM c ORDER BY quality_score DESC, image_id LIMIT 12) a
UNION ALL SELECT 'worst', image_id, quality_score FROM (FROM c ORDER BY quality_score, image_id LIMIT 12) b
UNION ALL SELECT 'best_rejected', image_id, quality_score FROM (FROM c WHERE NOT keep ORDER BY quality_score DESC, image_id LIMIT 12) d
UNION ALL SELECT 'worst_kept', image_id, quality_score FROM (FROM c WHERE keep ORDER BY quality_score, image_id LIMIT 12) e""")
def _(t):
    return quality.sample_rows(curated(t).select("image_id", "quality_score", "keep_final"))


@query("w10_class_samples", """
SELECT damage_class, plate_safe, car_score, row_number() OVER (PARTITION BY damage_class ORDER BY car_score DESC, plate_safe) AS place
FROM (SELECT unnest(damage_classes) AS damage_class, plate_safe, car_score FROM r_cars) s QUALIFY place <= 3""")
def _(t):
    return C.class_samples(X.cars(t))


@query("w11_latest_sessions", """
SELECT session_id, count(*) AS n_photos FROM r_photos GROUP BY session_id ORDER BY session_id DESC LIMIT 8""")
def _(t):
    return T.latest_sessions(T.case_summary(photos(t))).select("session_id", "n_photos")


@query("w12_oldest_signature_first", """
SELECT url, destination, row_number() OVER (ORDER BY signed, url, destination) - 1 AS place FROM (
  SELECT url, concat('damage_photos/', replace(plate_original, ' ', '_'), '/', case_id, '/', photo_type, '__', photo_id, '.jpeg') AS destination,
    coalesce(nullif(regexp_extract(url, 'X-Amz-Date=([0-9]{8}T[0-9]{6}Z)', 1), ''), '99999999T999999Z') AS signed
  FROM r_case_photos WHERE url IS NOT NULL) s""")
def _(t):
    photos_ = readers.flatten_register_photos(register_docs(t).withColumn("source_pos", F.lit(0)))
    jobs = sinks.damage_downloads(photos_)
    placed = stats.with_global_position(jobs, [F.col("signed"), F.col("url"), F.col("destination")], "place")
    return placed.drop("signed")


@query("w13_images_by_view", """
SELECT plate, view, image_id, row_number() OVER (PARTITION BY plate ORDER BY view, image_id) AS place FROM v_images""")
def _(t):
    return C.images_by_view(t.images.select("plate", "view", "image_id"))


@query("w14_incremental_plates", """
SELECT DISTINCT plate_original FROM v_images WHERE plate_original NOT IN (SELECT plate_original FROM v_damages WHERE case_ts < TIMESTAMP '1995-06-01') ORDER BY 1""")
def _(t):
    done = t.damages.where(F.col("case_ts") < F.lit("1995-06-01").cast("timestamp"))
    return store.remaining(t.images.select("plate_original").distinct(), done, ["plate_original"]).orderBy("plate_original")
