"""File sources, pixel jobs and the stateful stream."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.operators import images as I
from fleetlens.operators import store
from fleetlens.sources import readers, sinks
from fleetlens.streaming import scans


def png(pixels: np.ndarray) -> bytes:
    """8-bit RGB PNG."""
    h, w, _ = pixels.shape
    raw = b"".join(b"\0" + pixels[r].astype(np.uint8).tobytes() for r in range(h))
    chunk = lambda tag, body: struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))
    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def picture(seed, h=40, w=50):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 3))


def scene():
    """A 64 x 96 picture whose low frequencies are spread out, so that few of them lie at the median."""
    return picture(9, 64, 96)


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("photos")
    rgb = {"A_1/1_DIAGONAL_FRONT_LEFT_0.jpg": picture(1), "A_1/2_x_0.JPG": scene(), "B/ab-3_0.jpeg": scene()}
    for name, pixels in rgb.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_bytes(png(pixels))
    shifted = scene()
    shifted[10, 10] = np.minimum(shifted[10, 10] + 8, 255)  # one pixel, slightly
    (root / "B" / "near.jpg").write_bytes(png(shifted))
    (root / "B" / "broken.jpg").write_bytes(b"not an image")
    (root / "B" / "notes.txt").write_text("x")
    return root, rgb


def test_scan_images(spark, tree):
    got = {(r.plate, r.filename, r.view) for r in readers.scan_images(spark, str(tree[0])).collect()}
    assert got == {
        ("A_1", "1_DIAGONAL_FRONT_LEFT_0.jpg", "DIAGONAL_FRONT_LEFT"), ("A_1", "2_x_0.JPG", "UNKNOWN"), ("B", "ab-3_0.jpeg", "UNKNOWN"),
        ("B", "near.jpg", "UNKNOWN"), ("B", "broken.jpg", "UNKNOWN"),
    }


def brute_metrics(rgb):
    h, w, _ = rgb.shape
    gray = [[(9798 * int(p[0]) + 19235 * int(p[1]) + 3735 * int(p[2]) + 16384) // 32768 for p in row] for row in rgb]
    at = lambda y, x: gray[-y if y < 0 else 2 * (h - 1) - y if y >= h else y][-x if x < 0 else 2 * (w - 1) - x if x >= w else x]
    lap = [at(y - 1, x) + at(y + 1, x) + at(y, x - 1) + at(y, x + 1) - 4 * gray[y][x] for y in range(h) for x in range(w)]
    flat = [v for row in gray for v in row]
    sat = [round(255 * (int(max(p)) - int(min(p))) / int(max(p))) if max(p) > 0 else 0 for row in rgb for p in row]
    return {"sharpness": np.var(lap), "brightness": np.mean(flat), "contrast": np.std(flat), "saturation": np.mean(sat),
            "overexp_pct": 100 * np.mean([v > 240 for v in flat]), "underexp_pct": 100 * np.mean([v < 15 for v in flat])}


def test_image_metrics(spark, tree):
    root, rgb = tree
    rows = I.with_names(I.image_metrics(readers.read_images(spark, str(root)))).collect()
    by_name = {r.filename: r for r in rows}
    assert len(rows) == 5 and by_name["broken.jpg"].error == "image_read_failed"
    for name, pixels in rgb.items():
        r = by_name[name.split("/")[1]]
        assert (r.height, r.width) == pixels.shape[:2] and r.error is None
        for metric, want in brute_metrics(pixels).items():
            assert abs(r[metric] - want) <= 0.051 + 1e-6 * want, (name, metric)
    bits = lambda a, b: (int(by_name[a].phash, 16) ^ int(by_name[b].phash, 16)).bit_count()
    assert len(by_name["near.jpg"].phash) == 64
    assert bits("2_x_0.JPG", "ab-3_0.jpeg") == 0 and bits("2_x_0.JPG", "near.jpg") <= 6
    assert bits("2_x_0.JPG", "1_DIAGONAL_FRONT_LEFT_0.jpg") > 40
    sizes = {r.path.rsplit("/", 1)[1]: (r.width, r.height) for r in I.dimensions(readers.read_images(spark, str(root))).collect()}
    assert sizes["broken.jpg"] == (0, 0) and sizes["near.jpg"] == (96, 64)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(root))
    assert I.content_format(files).where(F.col("path").endswith("near.jpg")).first().found == "png"
    cars, images = store.cars_from_test_photos(readers.load_test_cars(spark, str(root)))
    assert {r.plate_safe: r.n_unique_views for r in cars.collect()} == {"TEST_A_1": 1, "TEST_B": 2}
    assert images.where("view = 'TEST_near'").first().width == 96


def test_nested_json_documents(spark, tmp_path):
    export = tmp_path / "export.json"
    export.write_text(json.dumps([
        {"license_plate": "A 1", "tasks": [{"task_id": "t", "completed_at": "2024-01-02T03:04:05", "photos": [
            {"type": "exterior", "urls": ["u0", "u1"]}, {"type": "INTERIOR", "urls": []}]}]},
        {"license_plate": "B 2", "tasks": []}, {"license_plate": "C 3"},
    ], indent=2))
    rows = readers.read_photo_export(spark, str(export))
    assert rows.count() == 3
    assert [(r.plate_original, r.idx, r.url) for r in readers.flatten_photos(rows).collect()] == [("A 1", 0, "u0"), ("A 1", 1, "u1")]
    register = tmp_path / "register.json"
    register.write_text(json.dumps({
        "A 1": {"damage_cases": [{"damage_case_id": "c", "damage_created_at": {"seconds": "86400"}, "damages": [
            {"damage_id": "d", "type": "TYPE_DENT", "group": "BODY", "localized_values": None, "coordinates": [
                {"projection": "LEFT", "photos": [{"photo_id": "p", "url": "u"}]}]}, {"type": "TYPE_HOLE"}]},
            {"damage_case_id": "empty"}]},
        "B 2": {}, "C 3": {"damage_cases": []},
    }, indent=2))
    docs = readers.read_damage_register(spark, str(register))
    flat = {(r.plate_original, r.case_id, r.damage_pos): r for r in readers.flatten_register(docs).collect()}
    assert set(flat) == {("A 1", "c", 0), ("A 1", "c", 1), ("A 1", "empty", None), ("B 2", None, None), ("C 3", None, None)}
    assert flat["A 1", "c", 0].case_ts.day == 2 and flat["A 1", "empty", None].case_ts is None
    assert flat["B 2", None, None].payload_empty and not flat["C 3", None, None].payload_empty
    assert [(r.photo_id, r.photo_type) for r in readers.flatten_register_photos(docs).collect()] == [("p", "UNKNOWN")]


def test_session_logs(spark, tmp_path):
    attempt = {"attempt": 1, "http_status": 200, "bytes_sent": 1, "bytes_received": 2, "latency_ms": 3}
    photo = lambda i: {"view": f"V{i}", "idx": i, "captured_at": "2024-01-01T00:00:00.000Z", "calls": [{"attempts": [attempt]}],
                       "analysis": {"damages": [{"label": "rust", "panel": ""}]}}
    for name, text in {"s1": json.dumps([photo(2), photo(1)]), "s2": "{broken", "s3": json.dumps([photo(1)])}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "photos.json").write_text(text)
    (tmp_path / "s1" / "session.json").write_text(json.dumps({"status": "finalized", "aggregates": {"n_errors": 4}}))
    rows = readers.read_sessions(spark, str(tmp_path))
    got = {r.session_id: ([p.view for p in r.photos], r.status, r.n_errors) for r in rows.collect()}
    assert got == {"s1": (["V1", "V2"], "finalized", 4), "s3": (["V1"], None, None)}
    assert readers.flatten_attempts(rows).count() == 3
    d = readers.scan_damages(rows).where("session_id = 's3'").first()
    assert (d.damage_id, d.type, d.master_class, d.part) == ("s3:V1:0", "rust", "other", "V1")


def test_model_answers(spark):
    fence = "```json\n{\"damages\": [], \"visible_damages\": [{\"bbox_2d\": [1, 2, 3, 4], \"label\": \"dent\"}]}\n```"
    texts = [fence, "so: {\"damages\": [{\"bbox_2d\": [1, 2, 3]}]} end", "{\"damages\": [", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, raw string")
    got = {r.i: (r.parsed_ok, len(r.detections)) for r in readers.parse_responses(rows).collect()}
    assert got == {0: (True, 1), 1: (True, 0), 2: (False, 0), 3: (False, 0), 4: (False, 0)}
    broken = ["{note: x}", "{broken} then {", "{\"damages\": [{\"bbox_2d\": [1, 2, null, 4]}]}", "[1]", " "]
    rows = readers.parse_responses(spark.createDataFrame(list(enumerate(broken)), "i int, raw string"))
    got = {r.i: (r.parsed_ok, r.error, len(r.detections)) for r in rows.collect()}
    wrong = (False, "parse_error", 0)
    assert got == {0: wrong, 1: wrong, 2: (True, None, 0), 3: wrong, 4: (False, "empty_response", 0)}


def test_an_answer_is_cleaned_and_parsed_once(spark):
    """Inside from_json nothing is shared between uses, so the cleaning must be over before it."""
    rows = readers.parse_responses(spark.createDataFrame([("{}",)], "raw string").selectExpr("raw || ' ' AS raw"))
    plan = sinks.label_studio_result(rows)._jdf.queryExecution().optimizedPlan().toString()
    read = [step for step in plan.splitlines() if "from_json(" in step]
    assert len(read) == 1 and read[0].count("from_json(") == 1
    assert "regexp" not in read[0] and "parseJson" not in read[0]
    assert plan.count("regexp_") == 1


def test_where_an_answer_holds_its_object(spark):
    box = '"damages": [{"bbox_2d": [1, 2, 3, 4], "label": "\u00df"}]'
    wrong, right = (False, "parse_error", []), (True, None, ["\u00df"])
    texts = {
        "\U0001f600 {" + box + "} \U0001f600": right, "```{" + box + "}```": right, "a\n```json\n{" + box + "}\n```\n": right,
        "}} {" + box + "}": right, "{" + box + ', "x": {"y": {}}} end': right, "} {": wrong, "{" + box + "} and }": right,
        "so {" + box + "} and {note}": right, "{" + box + ", " + box + "}": wrong, "{" + box: wrong, "[{" + box + "}]": right, "``` ```": wrong, "": (False, "empty_response", []),
    }
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, raw string").unionByName(
        spark.sql("SELECT -1 AS i, CAST(concat(unhex('C3'), CAST('{' AS BINARY), unhex('FF'), CAST('}' AS BINARY)) AS STRING) AS raw")
    )
    got = {r.i: (r.parsed_ok, r.error, [d.label for d in r.detections]) for r in readers.parse_responses(rows).collect()}
    assert got.pop(-1) == wrong and got == dict(enumerate(texts.values()))


def test_session_gaps(spark, tmp_path):
    """A gap closes a session, however its photos are cut into batches."""
    schema = "session_id bigint, view_idx int, captured_at timestamp, seq bigint, removed boolean, n_damages bigint"
    times = [0, 60, 20000, 20010, 90000]
    rows = [(1, i % 2, s, i, False, 1) for i, s in enumerate(times)]
    for cuts in ([5], [2, 3], [1, 1, 1, 1, 1]):
        source, at = tmp_path / f"in{len(cuts)}", 0
        for i, n in enumerate(cuts):
            part = spark.createDataFrame(rows[at:at + n], "session_id bigint, view_idx int, sec int, seq bigint, removed boolean, n_damages bigint")
            part.select("session_id", "view_idx", F.timestamp_seconds(F.col("sec") + 100000).alias("captured_at"), "seq", "removed", "n_damages").coalesce(1).write.parquet(str(source / str(i)))
            at += n
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(source))
        out = tmp_path / f"out{len(cuts)}"
        scans.run_append(scans.session_photos(stream), str(out), str(tmp_path / f"log{len(cuts)}"))
        assert sorted(r.n_photos for r in spark.read.parquet(str(out)).collect()) == [2, 2]


def test_stateful_sessions(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    schema = "session_id bigint, view_idx int, captured_at timestamp, seq bigint, removed boolean, n_damages bigint"
    batches = [
        [(1, 0, 0, 1, False, 2), (1, 1, 60, 2, False, 3), (1, 0, 120, 3, False, 5)],  # view 0 is taken again
        [(1, 1, 180, 4, True, 0), (2, 0, 7200, 5, False, 1)],  # view 1 is removed; session 2 moves the clock
        [(2, 1, 20000, 6, False, 1)],
    ]
    for i, rows in enumerate(batches):
        data = [(s, v, i, q, r, n) for s, v, i, q, r, n in rows]
        frame = spark.createDataFrame(data, "session_id bigint, view_idx int, sec int, seq bigint, removed boolean, n_damages bigint")
        frame.select("session_id", "view_idx", F.timestamp_seconds(F.col("sec") + 100000).alias("captured_at"), "seq", "removed", "n_damages").coalesce(1).write.parquet(str(source / str(i)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(source))
    scans.run_append(scans.session_photos(stream), str(out), str(tmp_path / "log"))
    got = {r.session_id: r for r in spark.read.parquet(str(out)).where("session_id = 1").collect()}
    assert (got[1].n_views, got[1].n_photos, got[1].n_retakes, got[1].n_removed, got[1].n_damages) == (1, 4, 2, 1, 5)


def test_sessions_count_photos_of_other_views(spark):
    rows = [(0, 0, False, 1), (20, None, False, 2), (25, None, True, 4), (40, 12, False, 8), (45, 13, False, 16), (50, 12, False, 32), (70, 0, False, 64), (110, -1, False, 128)]
    photos = spark.createDataFrame([(7, i, v, removed, n, m) for i, (m, v, removed, n) in enumerate(rows)],
                                   "session_id long, seq long, view_idx int, removed boolean, n_damages long, minute long")
    photos = photos.withColumn("captured_at", F.timestamp_seconds(F.col("minute") * 60))
    got = scans.session_photos(photos).orderBy("closed_at").collect()
    counts = [(r.n_photos, r.n_views, r.n_retakes, r.n_removed, r.n_damages) for r in got]
    assert counts == [(7, 3, 3, 1, 64 + 32 + 16), (1, 1, 0, 0, 128)]


def test_large_pictures_come_in_batches_of_bounded_size(spark):
    """300 pictures of 1 MB in one task reach Python in batches of at most 64 MB and one picture."""
    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], ["bytes", "n"])

    pictures = spark.range(0, 300, 1, 1).select(F.struct(
        F.col("id").cast("string").alias("origin"), F.lit(1024).alias("height"), F.lit(1024).alias("width"), F.lit(1).alias("nChannels"), F.lit(0).alias("mode"),
        F.rpad(F.unhex(F.lit("07")), 1 << 20, F.unhex(F.lit("07"))).alias("data"),
    ).alias("image"))
    got = pictures.select("image.data").mapInArrow(sizes, "bytes long, n long").collect()
    assert sum(r.n for r in got) == 300 and max(r.bytes for r in got) <= (64 << 20) + (1 << 20) + 4096
    dealt = I.spread(pictures, F.xxhash64("image.origin"))
    assert dealt.select(F.spark_partition_id().alias("p")).distinct().count() >= 8  # more tasks than the one it came in
    assert I.spread(dealt, F.xxhash64("image.origin")) is dealt
    metrics = I.image_metrics(pictures.limit(20)).select("brightness", "contrast", "saturation", "error").distinct().collect()
    assert [tuple(r) for r in metrics] == [(7.0, 0.0, 0.0, None)]


def test_decode_errors_agree_with_the_metrics(spark):
    image = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
    rows = [("a", 2, 3, 1, 0, bytes(6)), ("b", 2, 3, 3, 16, bytes(18)), ("c", 2, 3, 3, 16, bytes(17)), ("d", -1, -1, -1, -1, b""), ("e", 0, 4, 1, 0, b""),
            ("f", 2, 2, 4, 24, bytes(16)), ("g", 2, 2, 1, 0, None), ("h", 2, 2, 2, 0, bytes(8)), (None, 1, 1, 1, 0, b"x"), ("i", None, 3, 1, 0, bytes(3))]
    images = spark.createDataFrame([(r,) for r in rows], f"image {image}")
    whole = lambda df: {r.path for r in df.collect() if r.error is None}
    assert whole(I.decode_errors(images)) == whole(I.image_metrics(images)) == {"a", "b", "f", None}
    assert I.error_counts(I.decode_errors(images)).first()[:] == (10, 4, 6)
