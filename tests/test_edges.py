"""Hand-made edge rows."""

from datetime import datetime

from pyspark.sql import functions as F

from fleetlens.functions import boxes as B
from fleetlens.functions import scalars as S
from fleetlens.functions import stats
from fleetlens.operators import cars as C
from fleetlens.operators import damages as D
from fleetlens.operators import dedup, quality, selection, store
from fleetlens.operators import detections as DET
from fleetlens.operators import evaluation as E
from fleetlens.operators import telemetry as T
from fleetlens.sources import sinks

IMAGE = "image_id long, width int, height int, sharpness double, brightness double, contrast double, saturation double, overexp_pct double, underexp_pct double"
BOX = "image_id long, det_id long, label string, confidence double, ymin double, xmin double, ymax double, xmax double"


def value(spark, expr):
    return spark.range(1).select(expr).first()[0]


def test_limits_are_strict(spark):
    rows = spark.createDataFrame([
        (1, 800, 900, 30.0, 40.0, 1.0, 10.0, 10.0, 30.0), (2, 900, 800, 30.0, 220.0, 1.0, 10.0, 10.0, 30.0),
        (3, 799, 900, 29.9, 39.9, 1.0, 9.9, 10.1, 30.1), (4, 900, 900, 50.0, 220.1, 1.0, 50.0, 0.0, 0.0),
    ], IMAGE)
    got = {r.image_id: r.hard_fail_reasons for r in quality.hard_fail(rows).collect()}
    assert got[1] == [] and got[2] == []
    assert got[3] == ["low_resolution", "very_blurry", "too_dark", "burnt_out", "black_out", "monochrome"]
    assert got[4] == ["too_bright"]


def test_score_cut_without_usable_images(spark):
    rows = spark.createDataFrame([(1, 50.0, True, ["x"])], "image_id int, quality_score double, is_hard_fail boolean, hard_fail_reasons array<string>")
    got = quality.score_cut(rows).first()
    assert got.score_cut == 100.0 and not got.score_pass and got.filter_reasons == ["x"]


def test_ties_at_the_cut_are_all_kept(spark):
    cars = spark.createDataFrame([(f"p{i}", s) for i, s in enumerate([9.0, 8.0, 7.0, 7.0, 7.0, 1.0])], "plate_safe string, car_score double")
    assert C.top_n(cars, 3).where("selected").count() == 5
    assert C.top_n(cars, 99).where("selected").count() == 6
    assert [r.place for r in C.border(cars, 3).orderBy("place").collect()] == [0, 1, 2, 3, 4]
    assert C.top_percent(cars, 60).count() == 3


def test_first_registered_plate_wins(spark):
    register = spark.createDataFrame(
        [("M  1", 1, "c1", 0, None), ("M 1", 0, "c2", 0, None), ("M 1", 0, "c2", 1, None), ("M 2", 2, None, None, True)],
        "plate_original string, source_pos int, case_id string, damage_pos int, payload_empty boolean",
    )
    cars = spark.createDataFrame([("M_1",), ("M_2",), ("M_3",)], "plate_safe string")
    got = {r.plate_safe: (r.plate_original, r.n_damages, r.n_damage_cases) for r in C.attach_register(cars, C.register_counts(register)).collect()}
    assert got == {"M_1": ("M 1", 2, 1), "M_2": ("M_2", 0, 0), "M_3": ("M_3", 0, 0)}


def boxes(spark, rows):
    return spark.createDataFrame(rows, BOX)


def row_of(n, label="dent", step=0.0, image=1):
    return [(image, i, label, 0.5, 10.0 + step * i, 10.0, 20.0 + step * i, 20.0) for i in range(n)]


def test_five_stay_six_collapse(spark):
    assert DET.collapse_clusters(boxes(spark, row_of(5))).count() == 5
    got = DET.collapse_clusters(boxes(spark, row_of(6))).collect()
    assert len(got) == 1 and got[0].is_cluster and got[0].cluster_size == 6 and got[0].severity == "uncertain"
    assert got[0].confidence == 0.25


def test_distance_equal_to_the_radius_is_outside(spark):
    at = lambda i, y: (1, i, "dent", 0.9 - i / 10, y, 0.0, y, 0.0)
    got = DET.assign_clusters(boxes(spark, [at(0, 0.0), at(1, 120.0), at(2, 119.0)])).collect()
    assert {r.det_id: r.leader_id for r in got} == {0: 0, 1: 1, 2: 0}


def test_overlap_equal_to_the_threshold_is_kept(spark):
    # 10 x 10 boxes: a shift of 30/7 gives IoU 0.4
    pair = lambda shift: [(1, 1, "dent", 0.9, 0.0, 0.0, 7.0, 10.0), (1, 2, "dent", 0.8, shift, 0.0, 7.0 + shift, 10.0)]
    assert DET.suppress(boxes(spark, pair(3.0))).count() == 2  # 4 / 10
    assert DET.suppress(boxes(spark, pair(2.9))).count() == 1
    touching = [(1, 1, "dent", 0.9, 0.0, 0.0, 5.0, 5.0), (1, 2, "dent", 0.8, 5.0, 0.0, 9.0, 5.0)]
    assert DET.suppress(boxes(spark, touching)).count() == 2
    assert DET.overlap_pairs(boxes(spark, touching), boxes(spark, touching), ["image_id"], 0.0, F.col("det_id") < F.col("other_det_id")).count() == 0


def test_missing_confidence(spark):
    rows = [(1, 1, "dent", None, 0.0, 0.0, 9.0, 9.0), (1, 2, "dent", 0.1, 0.0, 0.0, 9.0, 9.0)]
    assert [r.det_id for r in DET.suppress(boxes(spark, rows)).collect()] == [2]
    d = spark.sql("select array(named_struct('bbox_2d', array(10D, 20D, 30D, 40D), 'label', cast(null as string), 'confidence', cast(null as double), 'reasoning', repeat('x', 300))) as detections")
    got = sinks.label_studio_result(d).first()
    assert got.score == 0.0 and got.result[0].score == 0.5 and got.result[0].value.rectanglelabels == ["other"]
    assert len(got.result[0].meta.text[0]) == 200 and got.result[0].value.x == 2.0


def damages(spark, rows):
    return spark.createDataFrame(
        [(p, c, pos, i, "TYPE_DENT", g, ts, None, None, "left", None, None) for p, c, pos, i, g, ts in rows],
        "plate_original string, case_id string, pos int, damage_id string, type string, grp string, case_ts timestamp, "
        "part string, part_local string, side string, severity string, severity_local string",
    )


def test_time_and_group_rules(spark):
    t0, t1 = datetime(2024, 1, 1), datetime(2024, 1, 2)
    times = spark.createDataFrame([("A", t1)], "plate_original string, photo_ts timestamp")
    d = damages(spark, [
        ("A", "same", 0, "x", None, t1), ("A", "same", 1, "x", None, t1),  # photo time itself: dropped, both count
        ("A", "old", 0, "x", None, t0), ("A", "old", 1, "x", None, t0), ("A", "old", 2, "y", "TYRES", t0),
        ("A", "old", 3, None, None, t0), ("A", "old", 4, None, None, t0),
        ("A", "unknown", 0, "x", None, None), ("B", "b", 0, "x", "WINDOWS", t1),
    ])
    got = D.visible_damages(d, times).collect()
    assert sorted((r.case_id, r.damage_id) for r in got if r.damage_id) == [("old", "x"), ("unknown", "x")]
    assert len(got) == 3 and {r.part for r in got} == {"?"} and {r.severity for r in got} == {""}
    stats_ = {r.plate_original: (r.by_time, r.by_group, r.kept) for r in D.filter_stats(d, times).collect()}
    assert stats_ == {"A": (2, 1, 3), "B": (0, 1, 0)}


def test_damage_without_coordinates_gives_one_row(spark):
    rows = spark.sql("""select 'A' plate_original, 'c' case_id, 'd' damage_id, cast(null as string) type, '' part_local, 'door' part, 'left' side,
      cast(null as string) severity_local, 's' severity, cast(array() as array<struct<projection:string,segment:string>>) coordinates""")
    got = D.damages_per_coordinate(rows).collect()
    assert len(got) == 1 and got[0].projection is None and got[0].part == "door" and got[0].master_class == "other"


def test_a_hard_failed_winner_loses_the_cluster(spark):
    scored = spark.createDataFrame([(1, 90.0, False), (2, 60.0, True), (3, 50.0, True)], "image_id long, quality_score double, keep_pre_dedup boolean")
    clusters = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "image_id long, cluster_id long")
    got = dedup.cluster_best(scored, clusters).where("keep_pre_dedup and is_cluster_best").collect()
    assert [r.image_id for r in got] == [3]


def test_p95_has_no_interpolation(spark):
    rows = [(1, 7)] + [(2, i) for i in range(1, 13)] + [(3, i) for i in range(1, 21)]
    photos = spark.createDataFrame(rows, "session_id int, latency_ms long")
    got = {r.session_id: r.p95_latency_s for r in T.latency_p95(photos).collect()}
    assert got == {1: 0.007, 2: 0.012, 3: 0.020}


def test_small_class_is_exhausted_and_filled_up(spark):
    cars = spark.createDataFrame(
        [("a", 9.0, ["major"]), ("b", 8.0, ["dent"]), ("c", 7.0, ["dent", "major"]), ("d", 6.0, []), ("e", 5.0, [])],
        "plate_safe string, car_score double, damage_classes array<string>",
    )
    got = {r.plate_safe: r.picked_for for r in selection.stratified_pick(cars, {"major": 3, "dent": 1}).collect()}
    # dent has the lower target and goes first; major has only two cars left for its three places
    assert got == {"b": "dent", "a": "major", "c": "major", "d": "fill"}


def test_tiles_of_a_photo(spark):
    got = B.add_tiles(spark.sql("select 1000 width, 700 height")).orderBy("tile_idx").collect()
    assert [(r.tile_x, r.tile_y, r.tile_w, r.tile_h) for r in got] == [
        (0, 0, 433, 303), (283, 0, 433, 303), (616, 0, 384, 303),
        (0, 198, 433, 303), (283, 198, 433, 303), (616, 198, 384, 303),
        (0, 431, 433, 269), (283, 431, 433, 269), (616, 431, 384, 269),
    ]


def test_overview_boxes_keep_their_place(spark):
    images = spark.sql("select 1L image_id, 1000 width, 700 height")
    rows = spark.sql("select 1L image_id, -1 tile_idx, 1L det_id, 100D ymin, 200D xmin, 300D ymax, 400D xmax union all select 1L, 4, 2L, 0D, 0D, 1000D, null")
    got = {r.det_id: r for r in DET.place_tiles(rows, images).collect()}
    assert got[1].found_in == "overview" and abs(got[1].xmin - 200) < 1e-9
    assert got[2].found_in is None and got[2].ymin == 0.0 and got[2].xmax is None


def test_scalar_edges(spark):
    assert value(spark, S.round_even(F.lit(0.25), 1)) == 0.2
    assert value(spark, S.slug(F.lit("  M-AB 12! "))) == "M-AB_12"
    assert value(spark, S.session_slug(F.lit(" #"))) == "no-plate"
    assert value(spark, S.safe_timestamp(F.lit("2024-02-30T00:00:00"))) is None
    assert value(spark, S.safe_timestamp(F.lit("2024-02-03T04:05:06Z"))) is None
    assert value(spark, S.position_hint(F.lit(333.0), F.lit(666.0), F.lit(333.0), F.lit(667.0))) == "mittig rechts"
    assert value(spark, S.view_of(F.lit("0a-f_3.jpg"))) == "exterior_legacy"
    assert value(spark, S.is_retryable(F.lit(None).cast("int"), F.lit(None).cast("string"))) is False
    assert value(spark, S.usd_cost(F.lit("else"), F.lit(5), F.lit(5))) == 0.0


def test_annotation_log(spark):
    rows = [
        (1, 0, "create", "dent", None), (1, 1, "patch", None, "light"), (1, 2, "patch", "crack", None),
        (2, 0, "create", "rust", None), (2, 1, "patch", "dent", None), (3, 0, "create", "dent", None), (3, 1, "delete", None, None),
    ]
    log = spark.createDataFrame(rows, "anno_id int, seq int, op string, label string, severity string").selectExpr(
        "*", "timestamp_seconds(seq) ts", "1 image_id", "'human' source", "cast(null as double) x", "cast(null as double) y",
        "cast(null as double) w", "cast(null as double) h",
    )
    got = store.annotation_state(log).collect()
    assert [(r.anno_id, r.label, r.severity) for r in got] == [(1, "crack", "light")]
    assert got[0].updated_at.second == 2


def test_upsert_keeps_cache_hits_and_skips_failures(spark):
    stored = spark.createDataFrame([(1, "pro", 1, 1, 5)], "image_id int, model string, created_at int, seq int, n_damages int")
    new = spark.createDataFrame([(1, "pro", 2, 2, 6, False), (1, "flash", 3, 3, 7, True), (2, "pro", 4, 4, 8, False)],
                                "image_id int, model string, created_at int, seq int, n_damages int, failed boolean")
    key = lambda df: {(r.image_id, r.model): r.n_damages for r in df.collect()}
    assert key(store.upsert_predictions(stored, new)) == {(1, "pro"): 5, (2, "pro"): 8}
    assert key(store.upsert_predictions(stored, new, force=True)) == {(1, "pro"): 6, (2, "pro"): 8}


def test_running_totals_span_partitions(spark):
    rows = spark.range(1000).selectExpr("id", "case when id % 3 = 0 then 'a' else 'b' end g")
    ran = stats.with_running(rows, ["g"], [F.col("id")], {"n": ("sum", "id"), "m": ("max", "id")})
    want = {}
    total = {"a": 0, "b": 0}
    for i in range(1000):
        g = "a" if i % 3 == 0 else "b"
        total[g] += i
        want[i] = (total[g], i)
    assert {r.id: (r.n, r.m) for r in ran.collect()} == want
    placed = stats.with_global_position(rows, [F.col("id").desc()])
    assert all(r.position == 999 - r.id for r in placed.collect())


def test_kappa(spark):
    same = spark.createDataFrame([(1, 1), (0, 0)], "rater_a int, rater_b int")
    assert E.cohen_kappa(same).first().kappa == 1.0
    apart = spark.createDataFrame([(1, 0), (0, 1)], "rater_a int, rater_b int")
    assert E.cohen_kappa(apart).first().kappa == -1.0
