"""Tile merging in one pass, where all groups are small, against the same steps with written tables."""

import random

from fleetlens.operators import detections as DET
from fleetlens.session import cut_lineage

SCHEMA = "image_id long, det_id long, model string, tile_idx int, label string, confidence double, ymin double, xmin double, ymax double, xmax double"


def rows_of(df):
    key = lambda r: tuple((v is not None, str(round(v, 9) if isinstance(v, float) else v)) for v in r)
    return sorted(key(r) for r in df.select(*sorted(df.columns)).collect())


def test_merge_without_written_tables(spark, monkeypatch):
    rnd, rows = random.Random(2), []
    for d in range(400):
        y, x = rnd.choice([(300, 300), (rnd.randrange(900), rnd.randrange(900))])
        y, x = y + rnd.randrange(30), x + rnd.randrange(30)
        rows.append((rnd.randrange(6), d, rnd.choice(["a", None]), rnd.choice([-1, 0, 4, 8, 9, None]), rnd.choice(["dent", "scratch", None]),
                     rnd.choice([None, rnd.random()]), float(y) if d % 31 else None, float(x), y + rnd.randrange(3, 9) * 1.0, x + rnd.randrange(3, 9) * 1.0))
    boxes = spark.createDataFrame(rows, SCHEMA)
    images = spark.createDataFrame([(0, 1000, 700), (1, 333, 222), (2, 4000, 3000), (3, 800, 801), (4, 1, 1), (4, 640, 480)], "image_id long, width int, height int")
    keys = ["image_id", "model"]
    placed = cut_lineage(DET.place_tiles(boxes, images))
    kept = cut_lineage(DET.suppress(placed, keys))
    want = rows_of(DET.collapse_clusters(kept, keys))

    def refused(df):
        raise AssertionError("written, though all groups are small")

    monkeypatch.setattr(DET, "cut_lineage", refused)
    merged = DET.merge_tiles(boxes, images)
    assert rows_of(merged) == want and any(r.is_cluster for r in merged.collect())
    stats = {(r.image_id, r.model): r for r in DET.merge_stats(boxes, images).collect()}
    for name, df in (("n_pre_nms", placed), ("n_post_nms", kept), ("n_after_cluster", merged)):
        counts = {(r.image_id, r.model): r["count"] for r in df.groupBy(*keys).count().collect()}
        assert counts == {k: r[name] for k, r in stats.items() if r[name]}
