"""Tables that change: predictions, annotations, test cars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import boxes as B
from fleetlens.functions import scalars as S
from fleetlens.functions import stats, vocab


def upsert_predictions(stored: DataFrame, incoming: DataFrame, force: bool = False) -> DataFrame:
    """The prediction table, one row per (image_id, model), after a run.

    Failed results are not stored. Without ``force`` a stored result is a cache hit and stays, and of
    several new ones the first is stored; with ``force`` the newest replaces. Both sides carry created_at,
    seq and the same columns; ``incoming`` also ``failed``.
    """
    fresh = incoming.where(~F.col("failed")).drop("failed").withColumn("_new", F.lit(1))
    both = stored.withColumn("_new", F.lit(0)).unionByName(fresh)
    rest = [c for c in stored.columns if c not in ("image_id", "model")]
    order = F.struct("_new", "created_at", "seq")
    pick = F.max_by if force else F.min_by
    return both.groupBy("image_id", "model").agg(pick(F.struct(*rest), order).alias("_p")).select(
        "image_id", "model", "_p.*"
    )


def latest_prediction(predictions: DataFrame) -> DataFrame:
    """Newest entry per image and base model, tiled or not."""
    entry = F.struct(S.is_tiled(F.col("model")).alias("tiled"), "created_at", "seq", "n_damages")
    return predictions.groupBy("image_id", S.base_model(F.col("model")).alias("base_model")).agg(
        F.max_by(entry, F.struct("created_at", "seq")).alias("_p")
    ).select("image_id", "base_model", "_p.*")


def cached_predictions(predictions: DataFrame) -> DataFrame:
    """All entries of an image as a map from model key. Expects one row per (image_id, model)."""
    entry = F.struct("model", F.struct("n_damages", "created_at"))
    return predictions.groupBy("image_id").agg(F.map_from_entries(F.collect_list(entry)).alias("by_model"))


def prediction_flags(images: DataFrame, predictions: DataFrame, models: list[str]) -> DataFrame:
    """(image_id, model, has_prediction) for every model, plain and tiled."""
    wanted = F.array(*[F.lit(m) for m in [*models, *[m + "#tiled" for m in models]]])
    grid = images.select("image_id", F.explode(wanted).alias("model"))
    have = predictions.select("image_id", "model").distinct().withColumn("_has", F.lit(True))
    return grid.join(have, ["image_id", "model"], "left").select(
        "image_id", "model", F.coalesce("_has", F.lit(False)).alias("has_prediction")
    )


def remaining(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is still to do."""
    return work.join(done.select(*keys), keys, "left_anti")


def run_totals(results: DataFrame) -> DataFrame:
    """Detections, tokens and the mean per car of a run; a missing count is 0."""
    z = lambda c: F.coalesce(c, F.lit(0))
    return results.agg(
        F.count("*").alias("n_images"), F.sum(z("n_damages")).alias("n_detections"),
        F.sum(z("tokens_in")).alias("tokens_in"), F.sum(z("tokens_out")).alias("tokens_out"),
        F.round(F.sum(z("n_damages")) / F.countDistinct("plate"), 6).alias("detections_per_car"),
    )


def annotation_state(log: DataFrame) -> DataFrame:
    """Fold an append-only change log into the current annotations.

    Log: anno_id, seq, ts, op (create, patch, delete), image_id, x, y, w, h, label, severity, source. A
    create with an unknown label is refused; changes to a missing annotation are ignored; a patch sets its
    non-null fields.
    """
    fields = ["x", "y", "w", "h", "label", "severity"]
    ok = (F.col("op") == "create") & F.col("label").isin(vocab.DAMAGE_CLASSES)
    born = log.where(ok).groupBy("anno_id").agg(F.min("seq").alias("_born"))
    live = log.join(born, "anno_id").where(
        (F.col("seq") == F.col("_born")) | ((F.col("seq") > F.col("_born")) & (F.col("op") != "create"))
    )
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull() & (F.col("op") != "delete"), F.col("seq"))).alias(c)
    touched = F.lit(False)
    for c in fields:
        touched = touched | F.col(c).isNotNull()
    state = live.groupBy("anno_id").agg(
        F.min_by("image_id", "seq").alias("image_id"), F.min_by("source", "seq").alias("source"),
        *[last(c) for c in fields],
        F.min("ts").alias("created_at"),
        F.max(F.when(touched & (F.col("op") != "delete"), F.col("ts"))).alias("updated_at"),
        F.max(F.col("op") == "delete").alias("_gone"),
    )
    return state.where(~F.col("_gone")).drop("_gone")


def replace_keys(table: DataFrame, incoming: DataFrame, key: str, defaults: dict[str, Column] | None = None) -> DataFrame:
    """Drop all rows of the incoming keys and add the incoming rows; columns new to the table get a default."""
    kept = table.join(incoming.select(key).distinct(), key, "left_anti")
    out = kept.unionByName(incoming, allowMissingColumns=True)
    return out.withColumns({c: F.coalesce(F.col(c), d) for c, d in (defaults or {}).items()})


def cars_from_test_photos(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cars, images) from test photos with brand, filename, path, width, height."""
    plate = F.concat(F.lit("TEST_"), F.col("brand"))
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    size = lambda c: F.coalesce(F.greatest(F.col(c), F.lit(0)), F.lit(0))
    images = files.select(
        plate.alias("plate_safe"), F.concat(F.lit("TEST_"), stem).alias("view"), "path",
        size("width").alias("width"), size("height").alias("height"),
        F.lit(100.0).alias("quality_score"), F.lit(0).alias("is_hard_fail"),
    )
    cars = files.groupBy("brand").agg(F.count("*").alias("n_unique_views")).select(
        plate.alias("plate_safe"), F.concat(F.lit("TEST · "), "brand").alias("plate_original"),
        F.lit(100.0).alias("car_score"), "n_unique_views", F.lit(0).alias("n_damages"),
        F.lit("test_case").alias("damage_classes"), F.lit(1).alias("is_test"),
    )
    return cars, images


def store_stats(cars: DataFrame, images: DataFrame, annotations: DataFrame, predictions: DataFrame) -> DataFrame:
    """Table sizes in one row."""
    human = annotations.where(F.col("source") == "human")
    with_human = images.join(human.select("image_id").distinct(), "image_id", "left_semi")
    parts = [
        cars.agg(F.count("*").alias("cars")), images.agg(F.count("*").alias("images")),
        human.agg(F.count("*").alias("human_annotations")),
        predictions.agg(F.count("*").alias("predictions_cached")),
        with_human.agg(F.countDistinct("plate").alias("cars_with_annotations")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))  # one row each
    return out


def coco_export(annotations: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(categories, images, annotations) of the human annotations.

    Images are numbered from 1 in the order of their first annotation id. Annotations: id, image_id, x, y,
    w, h (0-1), label, severity, paint_damaged, source. Images: image_id, file_name, width, height.
    """
    spark = annotations.sparkSession
    human = annotations.where(F.col("source") == "human").join(images, "image_id")
    first = human.groupBy("image_id").agg(
        F.min("id").alias("first_id"), F.first("file_name").alias("file_name"),
        F.first("width").alias("width"), F.first("height").alias("height"),
    )
    numbered = stats.with_global_position(first, [F.col("first_id"), F.col("image_id")]).withColumn("coco_id", F.col("position") + 1)
    x, y, w, h = B.unit_to_pixels(*[F.col(c) for c in ("x", "y", "w", "h", "width", "height")])
    category = S.lookup(F.col("label"), {c: i + 1 for i, c in enumerate(vocab.DAMAGE_CLASSES)}, F.lit(7))
    annos = human.join(numbered.select("image_id", "coco_id"), "image_id").select(
        "id", F.col("coco_id").alias("image_id"), category.alias("category_id"),
        F.array(x, y, w, h).alias("bbox"), (w * h).alias("area"), F.lit(0).alias("iscrowd"),
        F.struct("severity", F.coalesce(F.col("paint_damaged") != 0, F.lit(False)).alias("paint_damaged")).alias("attributes"),
    )
    categories = spark.range(1).select(F.posexplode(F.array(*[F.lit(c) for c in vocab.DAMAGE_CLASSES]))).select(
        (F.col("pos") + 1).alias("id"), F.col("col").alias("name")
    )
    return categories, numbered.select(F.col("coco_id").alias("id"), "file_name", "width", "height"), annos
