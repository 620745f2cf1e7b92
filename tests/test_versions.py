"""Tables that change together, and predictions stored as they arrive."""

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import store
from fleetlens.sources.versions import VersionConflict, VersionedTables, replace_cars
from fleetlens.streaming import upserts

CARS = "plate_safe string, plate_original string, car_score double, n_unique_views long, n_damages long, damage_classes string"
IMAGES = "plate_safe string, view string, width int, height int, quality_score double, is_hard_fail int"
DAMAGES = "plate_safe string, damage_id string, type string"


@pytest.fixture
def tables(spark, tmp_path):
    out = VersionedTables(spark, str(tmp_path / "store"), 8)
    keys = [f"K{i}" for i in range(20)] + ["TEST_a", None]
    out.create({
        "cars": (spark.createDataFrame([(k, k, 1.0, 2, 3, "dent") for k in keys], CARS), "plate_safe"),
        "images": (spark.createDataFrame([(k, f"v{i}", 1, 1, 50.0, 0) for k in keys for i in range(2)], IMAGES), "plate_safe"),
        "db_damages": (spark.createDataFrame([(k, f"{k}-{i}", "dent") for k in keys for i in range(3)], DAMAGES), "plate_safe"),
    })
    return out


def incoming(spark):
    files = spark.createDataFrame([("a", f"{i}.jpg", "p", 10, 20) for i in range(5)] + [("b", "x.jpg", "p", -1, None)],
                                  "brand string, filename string, path string, width int, height int")
    cars, images = store.cars_from_test_photos(files)
    return cars, images.drop("path")


def counts(tables, key):
    at = tables.current()
    return [tables.read(n, at).where(F.col("plate_safe").eqNullSafe(F.lit(key))).count() for n in ("cars", "images", "db_damages")]


def test_a_car_is_replaced_in_all_tables(spark, tables):
    before = tables.current()
    after = replace_cars(tables, *incoming(spark))
    assert after.number == before.number + 1 == tables.current().number
    assert counts(tables, "TEST_a") == [1, 5, 0] and counts(tables, "TEST_b") == [1, 1, 0]
    assert counts(tables, "K3") == [1, 2, 3] and counts(tables, None) == [1, 2, 3]
    rows = {r.plate_safe: r for r in tables.read("cars").collect()}
    assert len(rows) == 23 and rows["TEST_a"].is_test == 1 and rows["K0"].is_test == 0 and rows["TEST_a"].n_unique_views == 5
    # buckets without a replaced key are the same files
    untouched = set(before.tables["cars"]["buckets"].values()) & set(after.tables["cars"]["buckets"].values())
    assert len(untouched) >= len(before.tables["cars"]["buckets"]) - 2
    # a reader that holds the older version still sees all of it
    assert tables.read("db_damages", before).where("plate_safe = 'TEST_a'").count() == 3
    replace_cars(tables, *incoming(spark))
    assert counts(tables, "TEST_a") == [1, 5, 0]


def test_a_failure_between_two_tables_changes_nothing(spark, tables):
    cars, images = incoming(spark)
    broken = images.withColumn("view", F.when(F.col("view") == "TEST_x", F.raise_error(F.lit("lost"))).otherwise(F.col("view")))
    with pytest.raises(Exception, match="lost"):
        replace_cars(tables, cars, broken)
    assert tables.current().number == 1
    assert counts(tables, "TEST_a") == [1, 2, 3] and counts(tables, "TEST_b") == [0, 0, 0]
    replace_cars(tables, cars, images)
    assert counts(tables, "TEST_a") == [1, 5, 0]


def test_a_version_file_that_broke_off_does_not_count(spark, tables, tmp_path):
    (tmp_path / "store" / "versions" / "000000000002").write_text('{"tables": {"ca')
    assert tables.current().number == 1 and counts(tables, "TEST_a") == [1, 2, 3]
    assert replace_cars(tables, *incoming(spark)).number == 3


def test_only_one_writer_publishes_a_version(spark, tables):
    before = tables._number()
    tables._number = lambda: before
    replace_cars(tables, *incoming(spark))
    with pytest.raises(VersionConflict):
        replace_cars(tables, *incoming(spark))


RESULT = "image_id long, model string, created_at timestamp, seq long, n_damages long, failed boolean"


def results(spark, rows):
    made = [(i, m, f"2024-01-01 00:00:{s:02d}", s, n, f) for i, m, s, n, f in rows]
    return spark.createDataFrame(made, RESULT.replace("timestamp", "string")).withColumn("created_at", F.to_timestamp("created_at"))


BATCHES = [
    [(1, "pro", 1, 3, False), (1, "pro", 2, 4, False), (2, "pro", 3, 5, True), (None, "pro", 4, 1, False)],
    [(1, "pro", 5, 9, False), (2, "pro", 6, 6, False), (3, "flash", 7, 0, True)],
]


@pytest.mark.parametrize("force", [False, True])
def test_batches_are_merged_once(spark, tmp_path, force):
    tables = VersionedTables(spark, str(tmp_path / "store"), 4)
    tables.create({upserts.TABLE: (results(spark, []).drop("failed"), "image_id")})
    state = results(spark, []).drop("failed")
    for i, rows in enumerate(BATCHES):
        batch = results(spark, rows)
        version = upserts.store_batch(tables, batch, "s", i, force)
        again = upserts.store_batch(tables, results(spark, [(1, "pro", 50 + i, 99, False)]), "s", i, force)  # the same batch once more
        assert again.number == version.number
        state = store.upsert_predictions(state, batch, force)
        assert sorted(map(str, tables.read(upserts.TABLE).collect())) == sorted(map(str, state.select(tables.read(upserts.TABLE).columns).collect()))
    kept = {(r.image_id, r.model): r.n_damages for r in tables.read(upserts.TABLE).collect()}
    assert kept == {(1, "pro"): 9 if force else 3, (2, "pro"): 6, (None, "pro"): 1}
    # another stream has its own numbers
    upserts.store_batch(tables, results(spark, [(7, "pro", 9, 2, False)]), "other", 0, force)
    assert tables.read(upserts.TABLE).count() == 4 and tables.current().batches == {"s": 1, "other": 0}


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    tables = VersionedTables(spark, str(tmp_path / "store"), 4)
    tables.create({upserts.TABLE: (results(spark, []).drop("failed"), "image_id")})
    landing = str(tmp_path / "landing")
    for i, rows in enumerate(BATCHES):
        results(spark, rows).coalesce(1).write.parquet(f"{landing}/{i}")
        stream = spark.readStream.schema(results(spark, []).schema).option("recursiveFileLookup", "true").parquet(landing)
        for _ in range(2):  # the second run finds nothing new
            upserts.run_upserts(stream, tables, "s", str(tmp_path / "log"))
    assert {(r.image_id, r.n_damages) for r in tables.read(upserts.TABLE).collect()} == {(1, 3), (2, 6), (None, 1)}
    assert tables.current().number == 3
