"""Multi-step algorithms: duplicates, suppression, clusters, selection."""

from pyspark.sql import functions as F

from fleetlens.functions import vocab as V
from fleetlens.operators import cars as C
from fleetlens.operators import dedup, selection
from fleetlens.operators import detections as DET
from fleetlens.plans import common as X
from fleetlens.plans.joins import IOU_SQL
from fleetlens.plans.registry import query, relation
from fleetlens.plans.scalars import TILES

relation("r_tiles", TILES)
relation("r_placed", """
SELECT d.image_id, model, det_id, label, confidence, (ymin / 1000.0::DOUBLE * tile_h + tile_y) / height * 1000.0::DOUBLE AS ymin,
  (xmin / 1000.0::DOUBLE * tile_w + tile_x) / width * 1000.0::DOUBLE AS xmin, (ymax / 1000.0::DOUBLE * tile_h + tile_y) / height * 1000.0::DOUBLE AS ymax,
  (xmax / 1000.0::DOUBLE * tile_w + tile_x) / width * 1000.0::DOUBLE AS xmax, concat('tile_', d.tile_idx) AS found_in
FROM v_detections d JOIN r_tiles ON d.image_id = r_tiles.image_id AND d.tile_idx = r_tiles.tile_idx""")

# Connected components of the near-duplicate pairs: smallest id reachable from each representative.
relation("r_links", "SELECT a AS u, b AS v FROM r_hash_pairs UNION ALL SELECT b, a FROM r_hash_pairs")
relation("r_reach", """
SELECT id AS node, id AS root FROM r_hashes
UNION
SELECT l.v, r.root FROM r_reach r JOIN r_links l ON l.u = r.node""")
relation("r_clusters", """
SELECT i.image_id, c.cluster_id FROM v_images i JOIN r_hashes h ON h.w0 = i.w0 AND h.w1 = i.w1 AND h.w2 = i.w2 AND h.w3 = i.w3
JOIN (SELECT node, min(root) AS cluster_id FROM r_reach GROUP BY node) c ON c.node = h.id""")
relation("r_curated", """
SELECT r_filtered.*, cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY quality_score DESC, r_filtered.image_id) = 1 AS is_cluster_best
FROM r_filtered JOIN r_clusters ON r_filtered.image_id = r_clusters.image_id""")


@query("m01_near_duplicates", "SELECT image_id, cluster_id FROM r_clusters")
def _(t):
    return dedup.near_duplicates(X.images(t).select("image_id", "phash"))


@query("m01_window_mode", """
WITH RECURSIVE s AS (SELECT image_id, w0, w1, w2, w3, row_number() OVER (ORDER BY w0, w1, w2, w3, image_id) AS p FROM v_images),
e AS (SELECT a.image_id AS u, b.image_id AS v FROM s a JOIN s b ON b.p BETWEEN a.p + 1 AND a.p + 50
  WHERE bit_count(xor(a.w0, b.w0))::INT + bit_count(xor(a.w1, b.w1))::INT + bit_count(xor(a.w2, b.w2))::INT + bit_count(xor(a.w3, b.w3))::INT <= 6),
g AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
reach AS (SELECT image_id AS node, image_id AS root FROM v_images UNION SELECT g.v, reach.root FROM reach JOIN g ON g.u = reach.node)
SELECT node AS image_id, min(root) AS cluster_id FROM reach GROUP BY node""")
def _(t):
    return dedup.near_duplicates(X.images(t).select("image_id", "phash"), mode="window")


@query("m01b_connected_components", "SELECT node, min(root) AS component FROM r_reach WHERE node IN (SELECT u FROM r_links) GROUP BY node")
def _(t):
    reps = dedup.representatives(X.images(t))
    return dedup.connected_components(dedup.close_pairs(reps))


@query("w04_cluster_best", "SELECT image_id, cluster_id, is_cluster_best FROM r_curated")
def _(t):
    images = X.images(t)
    return dedup.cluster_best(X.scored(t), dedup.near_duplicates(images)).select("image_id", "cluster_id", "is_cluster_best")


@query("m07_curate", """
SELECT image_id, quality_score, array_to_string(filter_reasons, ',') AS filter_reasons, cluster_id, is_cluster_best, keep_pre_dedup AND is_cluster_best AS keep_final FROM r_curated""")
def _(t):
    return curated(t).select(
        "image_id", "quality_score", X.joined("filter_reasons").alias("filter_reasons"), "cluster_id", "is_cluster_best", "keep_final"
    )


def curated(t):
    return dedup.curate(X.images(t))


def _same(keys, a, b):
    return " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys)


def suppress_steps(name: str, source: str, keys: list[str]) -> None:
    """Greedy suppression, one recursion step per rank."""
    k = ", ".join(keys)
    relation(f"{name}_rank", f"""
SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY coalesce(confidence, 0) DESC, det_id) AS rk FROM {source}""")
    hit = f"""len(list_filter(n.kept, lambda b: {IOU_SQL.replace('b.', "b.").replace('a.', 'r.')} > 0.4)) > 0"""
    box = "{'ymin': r.ymin, 'xmin': r.xmin, 'ymax': r.ymax, 'xmax': r.xmax}"
    relation(f"{name}_fold", f"""
SELECT {k}, rk, det_id, true AS keep, [{box}] AS kept FROM {name}_rank r WHERE rk = 1
UNION ALL
SELECT {', '.join('r.' + c for c in keys)}, r.rk, r.det_id, NOT ({hit}), CASE WHEN {hit} THEN n.kept ELSE list_append(n.kept, {box}) END
FROM {name}_fold n JOIN {name}_rank r ON {_same(keys, 'n', 'r')} AND r.rk = n.rk + 1""")
    relation(name, f"SELECT s.* FROM {source} s JOIN {name}_fold f ON {_same([*keys, 'det_id'], 's', 'f')} WHERE f.keep")


def cluster_steps(name: str, source: str, keys: list[str]) -> None:
    """First-fit clusters per label, then the collapse of the large ones."""
    group = [*keys, "label"]
    g = ", ".join(group)
    dist = "sqrt(((q.xmin + q.xmax) / 2 - (r.xmin + r.xmax) / 2) * ((q.xmin + q.xmax) / 2 - (r.xmin + r.xmax) / 2) + ((q.ymin + q.ymax) / 2 - (r.ymin + r.ymax) / 2) * ((q.ymin + q.ymax) / 2 - (r.ymin + r.ymax) / 2)) < 120"
    box = "{'det_id': r.det_id, 'ymin': r.ymin, 'xmin': r.xmin, 'ymax': r.ymax, 'xmax': r.xmax}"
    near = f"list_filter(n.seeds, lambda q: {dist})"
    relation(f"{name}_rank", f"""
SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY coalesce(confidence, 0) DESC, det_id) AS rk FROM {source}""")
    relation(f"{name}_fold", f"""
SELECT {g}, rk, det_id, det_id AS leader_id, [{box}] AS seeds FROM {name}_rank r WHERE rk = 1
UNION ALL
SELECT {', '.join('r.' + c for c in group)}, r.rk, r.det_id, CASE WHEN len({near}) > 0 THEN {near}[1].det_id ELSE r.det_id END,
  CASE WHEN len({near}) > 0 THEN n.seeds ELSE list_append(n.seeds, {box}) END
FROM {name}_fold n JOIN {name}_rank r ON {_same(group, 'n', 'r')} AND r.rk = n.rk + 1""")
    relation(f"{name}_member", f"""
SELECT s.*, f.leader_id, count(*) OVER (PARTITION BY {', '.join('s.' + c for c in group)}, f.leader_id) AS size
FROM {source} s JOIN {name}_fold f ON {_same([*group, 'det_id'], 's', 'f')}""")
    relation(name, f"""
SELECT {g}, det_id, ymin, xmin, ymax, xmax, confidence, false AS is_cluster, 0 AS cluster_size FROM {name}_member WHERE size <= 5
UNION ALL
SELECT {g}, leader_id, min(ymin), min(xmin), max(ymax), max(xmax), least(0.4::DOUBLE, sum(coalesce(confidence, 0)) / count(*) * 0.5::DOUBLE), true, count(*)
FROM {name}_member WHERE size > 5 GROUP BY {g}, leader_id""")


suppress_steps("r_nms", "v_detections", ["image_id"])
cluster_steps("r_collapsed", "v_detections", ["image_id"])
suppress_steps("r_tile_nms", "r_placed", ["image_id", "model"])
cluster_steps("r_merged", "r_tile_nms", ["image_id", "model"])


@query("m02_nms", "SELECT image_id, det_id FROM r_nms")
def _(t):
    return DET.suppress(t.detections).select("image_id", "det_id")


def _boxes(rows, *keys):
    r = lambda c: F.round(c, 12).alias(c)
    return rows.select(*keys, "label", "det_id", "ymin", "xmin", "ymax", "xmax", r("confidence"), "is_cluster", "cluster_size")


@query("m03_collapse_clusters", "SELECT * REPLACE (round(confidence, 12) AS confidence) FROM r_collapsed")
def _(t):
    return _boxes(DET.collapse_clusters(t.detections), "image_id")


ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in ("ymin", "xmin", "ymax", "xmax"))


@query("m04_merge_tiles", f"SELECT * REPLACE (round(confidence, 12) AS confidence, {ROUNDED}) FROM r_merged")
def _(t):
    rows = _boxes(DET.merge_tiles(t.detections, t.images), "image_id", "model")
    return rows.withColumns({c: F.round(c, 6) for c in ("ymin", "xmin", "ymax", "xmax")})


@query("a21_tile_merge_stats", """
SELECT p.image_id, p.model, n_pre_nms, n_post_nms, n_after_cluster, 0 AS from_overview, n_after_cluster - n_clusters AS from_tiles, n_clusters FROM
  (SELECT image_id, model, count(*) AS n_pre_nms FROM r_placed GROUP BY ALL) p
  JOIN (SELECT image_id, model, count(*) AS n_post_nms FROM r_tile_nms GROUP BY ALL) n ON p.image_id = n.image_id AND p.model = n.model
  JOIN (SELECT image_id, model, count(*) AS n_after_cluster, count_if(is_cluster) AS n_clusters FROM r_merged GROUP BY ALL) m ON p.image_id = m.image_id AND p.model = m.model""")
def _(t):
    return DET.merge_stats(t.detections, t.images)


@query("d07_cluster_trigger_rate", """
SELECT model, count(*) AS n_images, sum(fired)::BIGINT AS n_triggered, round(sum(fired) / count(*), 9) AS trigger_rate FROM
  (SELECT model, image_id, max(CASE WHEN is_cluster THEN 1 ELSE 0 END) AS fired FROM r_merged GROUP BY ALL) s GROUP BY model""")
def _(t):
    rows = DET.cluster_trigger_rate(DET.merge_tiles(t.detections, t.images))
    return rows.withColumn("trigger_rate", F.round("trigger_rate", 9))


def pick_steps(name: str, source: str, targets: list[tuple[str, int]], coverage: bool, total: int | None) -> None:
    """Class-by-class picks as a chain of relations."""
    done = None
    for i, (cls, n) in enumerate(targets):
        free = f"plate_safe NOT IN (SELECT plate_safe FROM {done})" if done else "true"
        have = f"(SELECT count(*) FROM {done} WHERE list_contains(damage_classes, '{cls}'))" if done and coverage else "0"
        step = f"{name}_{i}"
        base = f"SELECT * FROM {done} UNION ALL " if done else ""
        relation(step, f"""{base}
SELECT plate_safe, car_score, damage_classes, picked_for, step FROM (SELECT plate_safe, car_score, damage_classes, '{cls}' AS picked_for, {i} AS step,
  row_number() OVER (ORDER BY car_score DESC, plate_safe) AS rk FROM {source} WHERE list_contains(damage_classes, '{cls}') AND {free}) s WHERE rk <= {n} - {have}""")
        done = step
    if total is None:
        relation(name, f"SELECT plate_safe, car_score, picked_for, step FROM {done} ORDER BY step, car_score DESC, plate_safe LIMIT 10")
    else:
        relation(name, f"""SELECT plate_safe, car_score, picked_for FROM {done} UNION ALL
SELECT plate_safe, car_score, picked_for FROM (SELECT plate_safe, car_score, 'fill' AS picked_for, row_number() OVER (ORDER BY car_score DESC, plate_safe) AS rk
  FROM {source} WHERE plate_safe NOT IN (SELECT plate_safe FROM {done})) s WHERE rk <= {total} - (SELECT count(*) FROM {done})""")


IN_ORDER = sorted(V.STRATA_TARGETS.items(), key=lambda kv: kv[1])
relation("r_top_share", """
SELECT * EXCLUDE (rk) FROM (SELECT *, row_number() OVER (ORDER BY car_score DESC, plate_safe) AS rk FROM r_cars) s
WHERE rk <= floor((SELECT count(*) FROM r_cars) * 60 / 100)""")
pick_steps("r_pick", "r_cars", IN_ORDER, True, 500)
pick_steps("r_showcase", "r_cars", V.SHOWCASE_TARGETS, False, None)
pick_steps("r_selected", "r_top_share", IN_ORDER, True, 500)


@query("m05_stratified_pick", "SELECT * FROM r_pick")
def _(t):
    return selection.stratified_pick(X.cars(t)).drop("damage_classes")


@query("m06_pick_showcase", "SELECT * FROM r_showcase")
def _(t):
    return selection.pick_showcase(X.cars(t)).drop("damage_classes")


@query("m08_select_cars", "SELECT * FROM r_selected")
def _(t):
    return selection.select_cars(X.images(t), t.damages).drop("damage_classes")


@query("w03_top_percent", "SELECT plate_safe, car_score FROM r_top_share")
def _(t):
    return C.top_percent(X.cars(t)).select("plate_safe", "car_score")
