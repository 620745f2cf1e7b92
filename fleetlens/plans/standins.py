"""Stand-in relations over the benchmark tables, in SQL that Spark and DuckDB both run.

Vehicles, damages, detections and telemetry are derived row by row from the given tables, so every
query's work grows with them. Products are kept below 2^63 by reducing keys first.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
        "embeddings", "pages", "benchmark", "labels", "conversations"]

VIEWS = {}

VIEWS["v_images"] = """
SELECT o_orderkey AS image_id, concat('M ', CAST(o_custkey AS STRING)) AS plate_original,
  concat('M_', CAST(o_custkey AS STRING)) AS plate,
  CASE o_orderkey % 12 WHEN 0 THEN 'EXTERIOR_FRONT_STRAIGHT' WHEN 1 THEN 'EXTERIOR_REAR_STRAIGHT' WHEN 2 THEN 'DIAGONAL_FRONT_LEFT'
    WHEN 3 THEN 'DIAGONAL_FRONT_RIGHT' WHEN 4 THEN 'DIAGONAL_REAR_LEFT' WHEN 5 THEN 'DIAGONAL_REAR_RIGHT' WHEN 6 THEN 'TYRE_RIM_FRONT_LEFT'
    WHEN 7 THEN 'TYRE_RIM_FRONT_RIGHT' WHEN 8 THEN 'TYRE_RIM_REAR_LEFT' WHEN 9 THEN 'TYRE_RIM_REAR_RIGHT' WHEN 10 THEN 'exterior_legacy'
    ELSE 'UNKNOWN' END AS view,
  CAST(700 + o_orderkey * 37 % 1300 AS INT) AS width, CAST(700 + o_orderkey * 53 % 1300 AS INT) AS height,
  CAST(o_orderkey * 7919 % 10000 AS DOUBLE) / CAST(10 AS DOUBLE) AS sharpness,
  CAST(o_orderkey * 104729 % 2500 AS DOUBLE) / CAST(10 AS DOUBLE) AS brightness,
  CAST(o_orderkey * 1299709 % 1000 AS DOUBLE) / CAST(10 AS DOUBLE) AS contrast,
  CAST(o_orderkey * 15485863 % 1500 AS DOUBLE) / CAST(10 AS DOUBLE) AS saturation,
  CAST(o_orderkey * 3571 % 1200 AS DOUBLE) / CAST(100 AS DOUBLE) AS overexp_pct,
  CAST(o_orderkey * 2741 % 3300 AS DOUBLE) / CAST(100 AS DOUBLE) AS underexp_pct,
  h0 + (p - 1) - 2 * (h0 % p) AS w0, h1 AS w1, h2 AS w2, h3 AS w3
FROM (SELECT o_orderkey, o_custkey,
    (b * 2654435761 + 97) % 2147483647 * 2147483648 + (b * 1103515245 + 12345) % 2147483647 AS h0,
    (b * 2246822519 + 11) % 2147483647 * 2147483648 + (b * 3266489917 + 23) % 2147483647 AS h1,
    (b * 668265263 + 31) % 2147483647 * 2147483648 + (b * 374761393 + 41) % 2147483647 AS h2,
    (b * 1597334677 + 53) % 2147483647 * 2147483648 + (b * 3812015801 + 61) % 2147483647 AS h3,
    CAST(power(2, (o_orderkey % 3) * (b % 5)) AS BIGINT) AS p
  FROM (SELECT o_orderkey, o_custkey, (o_orderkey - o_orderkey % 3) % 2147483647 AS b FROM orders) s) t
"""

VIEWS["v_plate_photo_time"] = """
SELECT concat('M ', CAST(o_custkey AS STRING)) AS plate_original, max(CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END) AS photo_ts
FROM orders GROUP BY o_custkey
"""

VIEWS["v_damages"] = """
SELECT concat('M ', CAST(o_custkey AS STRING)) AS plate_original, l_orderkey AS case_id,
  ((l_linenumber * 10000000000 + l_partkey) * 1000 + l_suppkey % 1000) * 64 + CAST(l_quantity AS BIGINT) AS pos,
  concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS damage_id,
  CASE l_partkey % 14 WHEN 0 THEN 'TYPE_SCRATCH' WHEN 1 THEN 'TYPE_STONE_CHIP' WHEN 2 THEN 'TYPE_STONE_CHIP_WITH_CRACK' WHEN 3 THEN 'TYPE_DENT'
    WHEN 4 THEN 'TYPE_DENTED' WHEN 5 THEN 'TYPE_CRACK' WHEN 6 THEN 'TYPE_HOLE' WHEN 7 THEN 'TYPE_BROKEN' WHEN 8 THEN 'TYPE_MISSING'
    WHEN 9 THEN 'TYPE_LOOSE' WHEN 10 THEN 'TYPE_CRASH' WHEN 11 THEN 'TYPE_HAIL_DAMAGE' WHEN 12 THEN 'TYPE_UNSEEN' END AS type,
  CASE l_suppkey % 5 WHEN 0 THEN 'WINDOWS' WHEN 1 THEN 'TYRES' WHEN 2 THEN 'BODY' WHEN 3 THEN 'BUMPER' END AS grp,
  CASE l_returnflag WHEN 'A' THEN 'DRIVER_SIDE' WHEN 'R' THEN 'PASSENGER_SIDE' ELSE 'CENTER' END AS side,
  CASE WHEN l_suppkey % 7 = 0 THEN '' ELSE concat('part', CAST(l_partkey % 20 AS STRING)) END AS part,
  CASE l_linenumber % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'Door, front' END AS part_local,
  CASE l_linestatus WHEN 'F' THEN 'SEVERITY_UP_TO_3_CM' ELSE 'SEVERITY_OVER_10_CM' END AS severity,
  CASE WHEN l_partkey % 11 = 0 THEN 'SEVERITY_LOCAL' END AS severity_local,
  l_linenumber % 3 AS n_coords,
  CASE WHEN l_orderkey % 29 = 0 THEN NULL WHEN l_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 200 DAY ELSE o_orderdate END AS case_ts,
  0 AS source_pos, CAST(l_linenumber AS INT) AS damage_pos, CAST(NULL AS BOOLEAN) AS payload_empty
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""

VIEWS["v_detections"] = """
SELECT image_id, ((k * 8 + l_linenumber) * 1000 + l_suppkey % 1000) * 64 + CAST(l_quantity AS BIGINT) AS det_id,
  CASE l_returnflag WHEN 'A' THEN 'pro' WHEN 'N' THEN 'flash' ELSE 'third' END AS model,
  CASE l_linestatus WHEN 'F' THEN 'human' ELSE 'model' END AS source, CAST(k % 9 AS INT) AS tile_idx,
  CASE l_linenumber WHEN 1 THEN 'scratch' WHEN 2 THEN 'stone_chip' WHEN 3 THEN 'dent' WHEN 4 THEN 'crack' WHEN 5 THEN 'missing' WHEN 6 THEN 'major' ELSE 'other' END AS label,
  CASE WHEN k % 50 = 0 THEN NULL ELSE CAST((k * 13 + l_linenumber * 17) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) END AS confidence,
  CAST(y0 AS DOUBLE) AS ymin, CAST(x0 AS DOUBLE) AS xmin, CAST(y0 + bh AS DOUBLE) AS ymax, CAST(x0 + bw AS DOUBLE) AS xmax
FROM (SELECT l_partkey AS image_id, l_orderkey AS k, l_linenumber, l_suppkey, l_quantity, l_returnflag, l_linestatus,
    CASE WHEN l_partkey % 3 = 0 THEN 400 + l_orderkey * 7 % 80 ELSE (l_orderkey * 53 + l_linenumber * 101) % 800 END AS y0,
    CASE WHEN l_partkey % 3 = 0 THEN 400 + l_orderkey % 80 ELSE (l_orderkey * 37 + l_suppkey * 11) % 800 END AS x0,
    CASE WHEN l_partkey % 3 = 0 THEN 5 + l_orderkey % 10 ELSE 60 + l_orderkey * 7 % 140 END AS bh,
    CASE WHEN l_partkey % 3 = 0 THEN 5 + l_orderkey % 10 ELSE 60 + l_orderkey * 11 % 140 END AS bw
  FROM lineitem) t
"""

VIEWS["v_responses"] = """
SELECT image_id, tile_idx, det_id, CASE det_id % 5
  WHEN 0 THEN concat('```json', chr(10), '{"damages":[{"bbox_2d":[', b, '],"label":"', label, '","confidence":0.5}]}', chr(10), '```')
  WHEN 1 THEN concat('Result: {"visible_damages":[{"bbox_2d":[', b, '],"label":"', label, '"}]} done')
  WHEN 2 THEN '{"panels_scanned":["hood"],"damages":[]}'
  WHEN 3 THEN concat('{"damages":[{"bbox_2d":[1,2,3],"label":"', label, '"},{"bbox_2d":[', b, '],"label":"', label, '"}]}')
  ELSE CASE det_id % 4 WHEN 0 THEN 'no json here' WHEN 1 THEN '{"damages": [' WHEN 2 THEN '{note: x} and {"damages": 1' ELSE ' ' END END AS raw,
  b AS box_text, label
FROM (SELECT image_id, tile_idx, det_id, label, concat(CAST(CAST(ymin AS BIGINT) AS STRING), ',', CAST(CAST(xmin AS BIGINT) AS STRING), ',', CAST(CAST(ymax AS BIGINT) AS STRING), ',', CAST(CAST(xmax AS BIGINT) AS STRING)) AS b
  FROM v_detections) t
"""

VIEWS["v_attempts"] = """
SELECT user_id AS session_id, CAST(event_id % 12 AS INT) AS view_idx, CAST(event_id % 9 AS INT) AS tile_idx, event_id - event_id % 2 AS call_id, CAST(1 + event_id % 2 AS INT) AS attempt,
  CASE event_type WHEN 'error' THEN CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 429 ELSE 500 END ELSE 200 END AS http_status,
  CASE WHEN event_type = 'error' THEN 'timeout' END AS error,
  CAST(floor(value * 10) AS BIGINT) AS latency_ms, 1000 + event_id * 31 % 5000 AS bytes_sent, 100 + event_id * 17 % 900 AS bytes_received,
  event_id * 7 % 3000 AS prompt_tokens, event_id * 3 % 400 AS completion_tokens,
  CASE user_id % 2 WHEN 0 THEN 'pro' ELSE 'flash' END AS model, event_id % 4 = 0 AS tile_mode,
  CASE event_id % 3 WHEN 0 THEN 1280 WHEN 1 THEN 2048 ELSE 4000 END AS max_side, ts AS captured_at
FROM events
"""

VIEWS["v_predictions"] = """
SELECT user_id * 12 + event_id % 12 AS image_id, concat(CASE event_type WHEN 'click' THEN 'pro' ELSE 'flash' END, CASE WHEN event_id % 4 = 0 THEN '#tiled' ELSE '' END) AS model,
  ts AS created_at, event_id AS seq, CAST(floor(value) AS BIGINT) % 10 AS n_damages, event_type = 'error' AS failed
FROM events
"""

VIEWS["v_photo_events"] = """
SELECT user_id AS session_id, CAST(event_id % 12 AS INT) AS view_idx, ts AS captured_at, event_id AS seq,
  event_type = 'error' AS removed, CAST(floor(value) AS BIGINT) % 10 AS n_damages
FROM events
"""

VIEWS["v_annotation_log"] = """
SELECT CAST(floor((event_id - event_id % 5) / 5) AS BIGINT) AS anno_id, event_id AS seq, ts,
  CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' ELSE 'patch' END AS op,
  user_id AS image_id, CASE WHEN event_id % 3 = 0 THEN 'model' ELSE 'human' END AS source,
  CASE WHEN event_type IN ('signup', 'view') THEN CAST(event_id % 90 AS DOUBLE) / CAST(100 AS DOUBLE) END AS x,
  CASE WHEN event_type IN ('signup', 'view') THEN CAST(event_id % 80 AS DOUBLE) / CAST(100 AS DOUBLE) END AS y,
  CASE WHEN event_type = 'signup' THEN CAST(0.1 AS DOUBLE) END AS w,
  CASE WHEN event_type = 'signup' THEN CAST(0.2 AS DOUBLE) END AS h,
  CASE WHEN event_type IN ('signup', 'click') THEN CASE event_id % 6 WHEN 0 THEN 'scratch' WHEN 1 THEN 'dent' WHEN 2 THEN 'crack' WHEN 3 THEN 'major' WHEN 4 THEN 'other' ELSE 'rust' END END AS label,
  CASE WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN 'light' END AS severity
FROM events
"""

VIEWS["v_store_cars"] = """
SELECT concat('M_', CAST(c_custkey AS STRING)) AS plate_safe, concat('M ', CAST(c_custkey AS STRING)) AS plate_original,
  CAST(floor(c_acctbal / 10) AS DOUBLE) / CAST(10 AS DOUBLE) AS car_score, c_nationkey % 11 AS n_unique_views, c_custkey % 5 AS n_damages,
  CASE WHEN c_custkey % 50 = 0 THEN 1 END AS is_test
FROM customer
"""

EARLIER_KEY = "concat('TEST_Brand_', CAST(1 + {0} % 6 AS STRING), CAST(1 + {0} % 5 AS STRING))"  # some of these are loaded again, some not

VIEWS["v_held_cars"] = f"""
SELECT CASE WHEN c_custkey % 4 = 0 THEN {EARLIER_KEY.format("c_custkey")} ELSE concat('M_', CAST(c_custkey AS STRING)) END AS plate_safe,
  concat('M ', CAST(c_custkey AS STRING)) AS plate_original, CAST(floor(c_acctbal / 10) AS DOUBLE) / CAST(10 AS DOUBLE) AS car_score,
  c_nationkey % 11 AS n_unique_views, c_custkey % 5 AS n_damages, 'dent' AS damage_classes FROM customer
"""

VIEWS["v_held_images"] = f"""
SELECT CASE WHEN image_id % 4 = 0 THEN {EARLIER_KEY.format("image_id")} ELSE plate END AS plate_safe, view, width, height,
  sharpness AS quality_score, 0 AS is_hard_fail FROM v_images
"""

VIEWS["v_held_damages"] = f"""
SELECT CASE WHEN case_id % 4 = 0 THEN {EARLIER_KEY.format("case_id")} ELSE concat('M_', substr(plate_original, 3)) END AS plate_safe, damage_id, type FROM v_damages
"""

VIEWS["v_scan_events"] = """
SELECT user_id AS session_id, CAST(event_id % 14 AS INT) - 1 AS view_idx, ts AS captured_at, event_id AS seq,
  CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'finalize' WHEN 'error' THEN 'remove' ELSE 'photo' END AS kind,
  CAST(floor(value) AS BIGINT) % 10 AS n_damages
FROM events
"""

VIEWS["v_annotations"] = """
SELECT det_id AS id, image_id, source, label, xmin / CAST(1000 AS DOUBLE) AS x, ymin / CAST(1000 AS DOUBLE) AS y,
  (xmax - xmin) / CAST(1000 AS DOUBLE) AS w, (ymax - ymin) / CAST(1000 AS DOUBLE) AS h,
  CASE tile_idx % 3 WHEN 0 THEN 'light' WHEN 1 THEN 'severe' END AS severity, CASE tile_idx % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS paint_damaged
FROM v_detections
"""

VIEWS["v_raters"] = """
SELECT doc_id AS item_id, quality AS rater_a, toxic AS rater_b FROM labels
"""


def names_in(text: str, known) -> list[str]:
    """Known relation names that a SQL text reads from."""
    found = re.findall(r"\b(?:FROM|JOIN)\s+([A-Za-z_][A-Za-z0-9_]*)", text)
    return [n for n in dict.fromkeys(found) if n in known]


class Tables:
    """The base tables and stand-ins of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._read: dict[str, DataFrame] = {}

    def base(self, name: str) -> DataFrame:
        """A base table."""
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._read[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.base(name)
        if "v_" + name in VIEWS:
            return self.view("v_" + name)
        raise AttributeError(name)

    def view(self, name: str) -> DataFrame:
        return self.sql(VIEWS[name])

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        """Run SQL whose FROM/JOIN names are base tables, stand-ins or the given frames."""
        used = {}
        for name in names_in(text, {*BASE, *VIEWS, *frames}):
            used[name] = frames[name] if name in frames else self.base(name) if name in BASE else self.view(name)
            text = re.sub(rf"\b(FROM|JOIN)(\s+){name}\b", rf"\1\2{{{name}}}", text)
        # braces of JSON literals would be read as placeholders
        marks = {f"{{{n}}}": f"\0{n}\0" for n in used}
        for mark, hold in marks.items():
            text = text.replace(mark, hold)
        text = text.replace("{", "{{").replace("}", "}}")
        for mark, hold in marks.items():
            text = text.replace(hold, mark)
        return self.spark.sql(text, **used)
