"""One giant key: crowded hash buckets, hubs of a link graph, long chains of choices."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.operators import dedup
from fleetlens.operators import evaluation as E


def components_of(edges, nodes):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def rows_of(spark, points):
    """Hashes as sets of flipped bits around zero, in one bucket."""
    words = []
    for i, bits in points:
        w = [0, 0, 0, 0]
        for b in bits:
            w[b // 64] |= 1 << (63 - b % 64)
        words.append(("x", i, *[x - (1 << 64) if x >> 63 else x for x in w]))
    return spark.createDataFrame(words, "bucket string, id long, w0 long, w1 long, w2 long, w3 long")


def edges_of(df):
    return [(r.a, r.b) for r in df.select("a", "b").collect()]


@pytest.mark.parametrize("t", [2, 6])
def test_star_rounds_in_small_blocks(spark, monkeypatch, t):
    monkeypatch.setattr(dedup, "BLOCK_ROWS", 20)
    rnd = random.Random(t)
    points = {frozenset(rnd.sample(range(24), rnd.randint(0, 9))) for _ in range(500)}
    points = list(enumerate(sorted(points, key=sorted)))
    near = [(a, b) for a, x in points for b, y in points if a < b and len(x ^ y) <= t]
    want = components_of(near, range(len(points)))
    got = edges_of(dedup._star_rounds(rows_of(spark, points), t))
    assert components_of(got, range(len(points))) == want
    assert {(min(e), max(e)) for e in got} <= set(near)
    few = edges_of(dedup._star_rounds(rows_of(spark, points), t, rounds=0))
    assert few == [] or components_of(few, range(len(points))) == want


def test_forests_connect_what_pairs_do(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK_ROWS", 30)
    rnd = random.Random(5)
    points = list(enumerate(sorted({frozenset(rnd.sample(range(30), rnd.randint(0, 4))) for _ in range(400)}, key=sorted)))
    rows = rows_of(spark, points).withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(4)).cast("int"))
    near = [(a, b) for a, x in points for b, y in points if a < b and len(x ^ y) <= 2]
    assert components_of(edges_of(dedup._forests(rows, 2, 4)), range(len(points))) == components_of(near, range(len(points)))


def test_one_crowded_bucket(spark):
    """10^5 rows: 20,000 within t of the leader, the others between t and 2t, each within t of an inner row."""
    inner, n = 20_000, 100_000
    bit = lambda c: F.expr(f"shiftleft(1L, CAST({c} AS INT))")
    rows = spark.range(n).selectExpr("id", f"id % {inner} AS j", f"CAST(id / {inner} AS BIGINT) AS ring").select(
        F.lit("x").alias("bucket"), "id", (F.col("ring") > 0).cast("int").alias("side"), F.pmod(F.xxhash64("id"), F.lit(64)).cast("int").alias("_salt"),
        bit("j % 64").alias("w0"), bit("(j / 64) % 64").alias("w1"), bit("j / 4096").alias("w2"),
        F.when(F.col("ring") > 0, F.expr("shiftleft(15L, CAST(4 * ring AS INT))")).otherwise(F.lit(0).cast("long")).alias("w3"),
    )
    placed = dedup._in_blocks(rows, 64)
    sizes = placed.groupBy("side", "block").count().collect()
    assert max(r["count"] for r in sizes) < 1.3 * dedup.BLOCK_ROWS and sum(r["count"] for r in sizes) == n
    assert {r.side: r.n for r in placed.groupBy("side").agg(F.countDistinct("block").alias("n")).collect()} == {0: 10, 1: 40}
    edges = dedup._bridges(rows, 6, 64)
    got = edges.agg(F.count("*"), F.countDistinct("b"), F.max("a"), F.min("b")).first()
    assert got[:2] == (n - inner, n - inner) and got[2] < inner <= got[3]


@pytest.mark.parametrize("hub_edges", [5, 100_000])
def test_components_with_hubs(spark, hub_edges):
    rnd = random.Random(1)
    edges = [(0, i) for i in range(1, 200)] + [(5000, i) for i in range(300, 500)] + [(i, i + 1) for i in range(600, 640)]
    edges += [(rnd.randrange(700, 800), rnd.randrange(700, 800)) for _ in range(60)] + [(199, 300)]
    edges = [(a, b) for a, b in edges if a != b]
    nodes = {n for e in edges for n in e}
    got = dedup.connected_components(spark.createDataFrame(edges, "a long, b long"), hub_edges)
    assert {r.node: r.component for r in got.collect()} == components_of(edges, nodes)


def test_a_star_is_dealt_evenly(spark):
    """10^6 leaves on one node: no part of it is larger than five times the median part."""
    leaves = spark.range(1, 1_000_001).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v"))
    edges = leaves.unionByName(leaves.select(F.col("v").alias("u"), F.col("u").alias("v")))
    dealt = dedup.with_least(edges, 2_000_000, 20_000)
    parts = np.array([r["count"] for r in dealt.where("u = 0").groupBy("part").count().collect()])
    assert len(parts) == 50 and parts.sum() == 1_000_000 and parts.max() < 1.2 * np.median(parts)
    assert dealt.where("u <> 0 AND m <> 0 OR u = 0 AND m <> 1").isEmpty()
    assert dealt.count() == 2_000_000


BOX = "ymin double, xmin double, ymax double, xmax double"


def one_by_one(predicted, gold, iou=0.5):
    def overlap(a, b):
        h, w = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        if h <= 0 or w <= 0:
            return 0
        area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
        return h * w / (area(a) + area(b) - h * w)

    free, out = dict(gold), {}
    for det, (confidence, box) in sorted(predicted.items(), key=lambda x: (-x[1][0], x[0])):
        at = int(box[1] // 10)  # the others are too far away
        best = max(((overlap(box, free[g]), -g) for g in range(at - 3, at + 4) if g in free), default=(0, 0))
        if best[0] >= iou:
            out[det] = -best[1]
            del free[-best[1]]
    return out


@pytest.mark.parametrize("n,group_pairs", [(10_000, 1_000_000), (400, 10)])
def test_a_chain_of_choices(spark, n, group_pairs):
    """Each prediction overlaps two gold boxes and prefers the one that the prediction before it takes."""
    gold = {i: (0.0, 10.0 * i, 10.0, 10.0 * i + 12) for i in range(n)}
    predicted = {100_000 + i: (1 - i / 20_000, (0.0, 10.0 * i + (4.0 if i % 3 else 1.0), 10.0, 10.0 * i + 15)) for i in range(n)}
    left = spark.createDataFrame([(1, d, "m", "dent", c, *b) for d, (c, b) in predicted.items()], f"image_id long, det_id long, model string, label string, confidence double, {BOX}")
    right = spark.createDataFrame([(1, g, "dent", *b) for g, b in gold.items()], f"image_id long, det_id long, label string, {BOX}")
    got = {r.det_id: r.gold_id for r in E.match_detections(left, right, 0.3, group_pairs, rounds=3).collect()}
    assert got == one_by_one(predicted, gold, 0.3) and len(got) > n // 2
