"""Large-group paths against brute force on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import dedup
from fleetlens.operators import detections as DET
from fleetlens.operators import evaluation as E

BOX = "image_id long, det_id long, label string, confidence double, ymin double, xmin double, ymax double, xmax double"


def random_boxes(n, images, seed, hot=0.5):
    r = random.Random(seed)
    out = []
    for i in range(n):
        image = 0 if r.random() < hot else r.randrange(1, images)
        y, x, h, w = r.randrange(800), r.randrange(800), r.randrange(5, 200), r.randrange(5, 200)
        conf = None if r.random() < 0.05 else r.randrange(100) / 100
        out.append((image, i, r.choice(["dent", "crack"]), conf, float(y), float(x), float(y + h), float(x + w)))
    return out


def iou(a, b):
    h = min(a[6], b[6]) - max(a[4], b[4])
    w = min(a[7], b[7]) - max(a[5], b[5])
    if h <= 0 or w <= 0:
        return 0.0
    area = lambda q: (q[6] - q[4]) * (q[7] - q[5])
    return h * w / (area(a) + area(b) - h * w)


def near(a, b):
    cy, cx = (a[4] + a[6]) / 2 - (b[4] + b[6]) / 2, (a[5] + a[7]) / 2 - (b[5] + b[7]) / 2
    return (cx * cx + cy * cy) ** 0.5 < 120


def brute(rows, key, covers):
    leaders, of = {}, {}
    for row in sorted(rows, key=lambda q: (-(q[3] or 0), q[1])):
        group = leaders.setdefault(key(row), [])
        hit = next((k for k in group if covers(k, row)), None)
        if hit is None:
            group.append(row)
        of[row[1]] = (hit or row)[1]
    return of


@pytest.mark.parametrize("max_group", [5000, 60])
def test_suppression(spark, max_group):
    rows = random_boxes(400, 6, 1)
    want = {i for i, leader in brute(rows, lambda q: q[0], lambda k, x: iou(k, x) > 0.4).items() if i == leader}
    frame = spark.createDataFrame(rows, BOX)
    kept = DET.suppress(frame, max_group=max_group)
    assert {r.det_id for r in kept.collect()} == want
    assert DET.suppress(kept, max_group=max_group).count() == len(want)  # idempotent


@pytest.mark.parametrize("max_group", [5000, 60])
def test_clusters(spark, max_group):
    rows = random_boxes(400, 6, 2)
    want = brute(rows, lambda q: (q[0], q[2]), near)
    got = DET.assign_clusters(spark.createDataFrame(rows, BOX), max_group=max_group)
    assert {r.det_id: r.leader_id for r in got.collect()} == want


def test_pairs_equal_brute_force(spark):
    rows = random_boxes(200, 3, 3)
    frame = spark.createDataFrame(rows, BOX)
    got = DET.overlap_pairs(frame, frame, ["image_id"], 0.2, F.col("det_id") < F.col("other_det_id")).collect()
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and iou(a, b) >= 0.2}
    assert {(r.det_id, r.other_det_id) for r in got} == want and len(got) == len(want)


def test_matching_equals_one_by_one(spark):
    rows = random_boxes(600, 4, 4)
    gold, pred = rows[:300], rows[300:]
    used, want = set(), {}
    for p in sorted(pred, key=lambda q: (-(q[3] or 0), q[1])):
        options = [g for g in gold if g[0] == p[0] and g[2] == p[2] and g[1] not in used and iou(p, g) >= 0.3]
        if options:
            best = min(options, key=lambda g: (-iou(p, g), g[1]))
            used.add(best[1])
            want[p[1]] = best[1]
    predicted = spark.createDataFrame(pred, BOX).withColumn("model", F.lit("m"))
    got = E.match_detections(predicted, spark.createDataFrame(gold, BOX), 0.3)
    assert {r.det_id: r.gold_id for r in got.collect()} == want


def flip(h, bits):
    for b in bits:
        h ^= 1 << b
    return h


def hashes(seed):
    """Copies, chains, a dense ball around one hash, and many hashes sharing one band."""
    r = random.Random(seed)
    out = []
    for _ in range(40):
        h = r.getrandbits(256)
        out += [h, h, flip(h, r.sample(range(256), 5)), flip(flip(h, [3, 4, 5, 6, 7]), [9, 10, 11, 12, 13])]
    centre = r.getrandbits(256)
    for _ in range(150):
        out.append(flip(centre, r.sample(range(256), r.randrange(1, 10))))
    shared = r.getrandbits(40) << 216
    out += [shared | r.getrandbits(216) for _ in range(80)]
    return [(i, f"{h:064x}") for i, h in enumerate(out)]


def brute_clusters(rows, t):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = [int(h, 16) for _, h in rows]
    for i in range(len(rows)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= t:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in range(len(rows))}


@pytest.mark.parametrize("cap", [2000, 30])
def test_duplicate_clusters(spark, cap):
    rows = hashes(5)
    images = spark.createDataFrame(rows, "image_id long, phash string")
    got = dedup.near_duplicates(images, bucket_cap=cap)
    assert {r.image_id: r.cluster_id for r in got.collect()} == brute_clusters(rows, 6)


def test_split_buckets_still_give_every_pair(spark):
    rows = hashes(6)
    reps = dedup.representatives(spark.createDataFrame(rows, "image_id long, phash string"))
    first = {}
    for i, h in rows:
        first.setdefault(int(h, 16), i)
    want = {tuple(sorted((a, b))) for x, a in first.items() for y, b in first.items() if a < b and (x ^ y).bit_count() <= 6}
    for cap in (2000, 30):
        got = dedup.close_pairs(reps, bucket_cap=cap).collect()
        assert {(r.a, r.b) for r in got} == want and len(got) == len(want)


def test_window_mode_finds_a_subset(spark):
    images = spark.createDataFrame(hashes(7), "image_id long, phash string")
    windowed = {(r.a, r.b) for r in dedup.window_pairs(images).collect()}
    rows = [(i, int(h, 16)) for i, h in hashes(7)]
    every = {(a, b) for a, x in rows for b, y in rows if a < b and (x ^ y).bit_count() <= 6}
    assert windowed and windowed <= every


def test_long_chain_is_one_component(spark):
    edges = spark.range(300).selectExpr("id as a", "id + 1 as b")
    got = dedup.connected_components(edges).collect()
    assert len(got) == 301 and {r.component for r in got} == {0}


@pytest.mark.parametrize("complete", [True, False])
def test_far_hashes_in_one_crowded_bucket(spark, complete):
    """Hashes that share two bands but are far apart otherwise, among them two close pairs."""
    rnd = random.Random(9)
    shared = rnd.getrandbits(76)
    hashes = [(shared << 180) | rnd.getrandbits(180) for _ in range(120)]
    hashes += [hashes[0] ^ 0b1011, hashes[5] ^ (1 << 90)]
    images = spark.createDataFrame([(i, f"{h:064x}") for i, h in enumerate(hashes)], "image_id long, phash string")
    got = dedup.close_pairs(dedup.representatives(images), bucket_cap=10, complete=complete)
    assert {(r.a, r.b) for r in got.collect()} == {(0, 120), (5, 121)}
