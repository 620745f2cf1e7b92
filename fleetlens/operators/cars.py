"""Roll-up of images to cars, car scores and car rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions import scalars as S
from fleetlens.functions import stats, vocab

def _best_first():
    return [F.col("car_score").desc(), F.col("plate_safe")]


def register_counts(register: DataFrame) -> DataFrame:
    """Damages and cases per plate of the flat register; plates without any payload are flagged.

    Needs plate_original, case_id, damage_pos (NULL for none) and source_pos, the plate's place in the source.
    """
    return register.groupBy("plate_original").agg(
        F.min("source_pos").alias("source_pos"),
        F.count("damage_pos").alias("n_damages"),
        F.countDistinct("case_id").alias("n_damage_cases"),
        F.min(F.coalesce(F.col("payload_empty"), F.lit(False))).alias("payload_empty"),
    )


def attach_register(cars: DataFrame, counts: DataFrame) -> DataFrame:
    """Left join on the slug of the registered name. On a collision the first registered plate wins;
    no match, or an empty payload, gives zero counts and the car's own name."""
    hit = F.struct("source_pos", "plate_original", "n_damages", "n_damage_cases", "payload_empty")
    first = counts.groupBy(S.slug(F.col("plate_original")).alias("plate_safe")).agg(F.min(hit).alias("_hit"))
    used = F.col("_hit").isNotNull() & ~F.coalesce(F.col("_hit.payload_empty"), F.lit(False))
    return cars.join(first, "plate_safe", "left").select(
        *cars.columns,
        F.when(used, F.col("_hit.plate_original")).otherwise(F.col("plate_safe")).alias("plate_original"),
        F.when(used, F.col("_hit.n_damages")).otherwise(0).alias("n_damages"),
        F.when(used, F.col("_hit.n_damage_cases")).otherwise(0).alias("n_damage_cases"),
    )


def car_aggregate(scored: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per plate from images with quality_score and is_hard_fail.

    Scores carry one decimal and are summed as whole tenths, so no result depends on row order.
    A plate's median counts its at most 1,001 distinct scores, whatever the number of images.
    """
    clean = ~F.col("is_hard_fail")
    tenths = F.when(clean, F.rint(F.col("quality_score") * 10).cast("long"))
    known_view = F.when(~F.col("view").isin(vocab.LEGACY_VIEW, vocab.UNKNOWN_VIEW), F.col("view"))

    def stat(c):
        return F.coalesce(F.rint(c) / 10.0, F.lit(0.0))

    cars = scored.groupBy(F.col("plate").alias("plate_safe")).agg(
        F.count("*").alias("n_images"),
        F.countDistinct(known_view).alias("n_unique_views"),
        (F.countDistinct(known_view) / F.lit(len(vocab.VIEWS))).alias("completeness"),
        F.count_if("is_hard_fail").alias("n_hard_fail"),
        (F.count_if("is_hard_fail") / F.count("*")).alias("hard_fail_pct"),
        stat(F.try_divide(F.sum(tenths), F.count(tenths))).alias("mean_quality"),
        stat(F.percentile(tenths, 0.5)).alias("median_quality"),
        stat(F.min(tenths)).alias("min_quality"),
    )
    return attach_register(cars, counts)


def car_score(cars: DataFrame) -> DataFrame:
    metrics = {k: F.col(k) for k in ("mean_quality", "hard_fail_pct", "min_quality")}
    n = {k: stats.normalised(c, F.col("_marks")[k]) for k, c in metrics.items()}
    score = (
        0.40 * n["mean_quality"] + 0.30 * F.col("completeness") + 0.15 * (1 - n["hard_fail_pct"])
        + 0.15 * n["min_quality"]
    )
    marked = stats.with_percentiles(cars, metrics, [0.05, 0.95], "_marks")
    return marked.withColumn("car_score", S.round_even(score * 100, 1)).drop("_marks")


def top_n(cars: DataFrame, n: int = 500) -> DataFrame:
    """Flag the cars at or above the score of the n-th; ties at the cut all count."""
    cut = cars.orderBy(*_best_first()).limit(n).agg(F.min("car_score").alias("score_cut"))
    return cars.crossJoin(F.broadcast(cut)).withColumn(  # one row
        "selected", F.coalesce(F.col("car_score") >= F.col("score_cut"), F.lit(False))
    )


def border(cars: DataFrame, n: int = 500, around: int = 2) -> DataFrame:
    """The cars from two places before to two after position n, with their 0-based place."""
    head = cars.orderBy(*_best_first()).limit(n + around)  # at most n + 2 rows from here on
    place = F.row_number().over(Window.orderBy(*_best_first())) - 1
    return head.withColumn("place", place).where(F.col("place") >= max(0, n - 1 - around))


def top_percent(cars: DataFrame, percent: int = 60) -> DataFrame:
    """The best share of the cars, cut down to a whole number."""
    placed = stats.with_global_position(cars, _best_first())
    size = placed.agg(F.floor(F.count("*") * F.lit(percent) / 100).alias("_k"))
    return placed.crossJoin(F.broadcast(size)).where(F.col("position") < F.col("_k")).drop("_k", "position")


def with_counts(cars: DataFrame, images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Cars with their number of images and of human annotations; a missing is_test is 0."""
    n_images = images.groupBy("plate_safe").agg(F.count("*").alias("n_images"))
    human = annotations.where(F.col("source") == "human").groupBy("image_id").agg(F.count("*").alias("_n"))
    n_annos = human.join(images.select("image_id", "plate_safe"), "image_id").groupBy("plate_safe").agg(
        F.sum("_n").alias("n_human_annos")
    )
    joined = cars.join(n_images, "plate_safe", "left").join(n_annos, "plate_safe", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_images", "n_human_annos", "is_test")}
    return joined.withColumns(zero)


def page(cars: DataFrame, limit: int = 100, offset: int = 0, has_damages: bool = True, only_test: bool = False) -> DataFrame:
    """One page of cars: test cars first, then by score."""
    test = F.coalesce("is_test", F.lit(0))
    rows = cars.withColumn("is_test", test)
    if only_test:
        rows = rows.where(test == 1)
    elif has_damages:
        rows = rows.where((F.col("n_damages") > 0) | (test == 1))
    return rows.orderBy(F.col("is_test").desc(), *_best_first()).offset(offset).limit(limit)


def insert_after(cars: DataFrame, extra: DataFrame, anchor: str | None = None) -> DataFrame:
    """Give rows an ``order_key`` in list order and put ``extra`` behind the anchor car, or behind the first.

    ``cars`` is one page, as returned by :func:`page`.
    """
    order = Window.orderBy(F.col("is_test").desc(), *_best_first())
    listed = cars.withColumn("order_key", F.row_number().over(order).cast("double"))
    wanted = F.min(F.when(F.col("plate_safe") == F.lit(anchor), F.col("order_key")))
    place = listed.agg(F.coalesce(wanted, F.min("order_key"), F.lit(0.0)).alias("_at"))
    added = extra.crossJoin(F.broadcast(place)).withColumn("order_key", F.col("_at") + 0.5).drop("_at")
    return listed.unionByName(added, allowMissingColumns=True)


def class_samples(cars: DataFrame, per_class: int = 3) -> DataFrame:
    """The best cars of every damage class."""
    long = cars.select(F.explode("damage_classes").alias("damage_class"), "plate_safe", "car_score")
    rank = F.row_number().over(Window.partitionBy("damage_class").orderBy(*_best_first()))
    return long.withColumn("place", rank).where(F.col("place") <= per_class)


def images_by_view(images: DataFrame) -> DataFrame:
    """Images of every car sorted by view, then id, with their 1-based place. A car may outgrow a task."""
    rows = images.withColumn("_one", F.lit(1))
    order = [F.col("view"), F.col("image_id")]
    return stats.with_running(rows, ["plate"], order, {"place": ("sum", "_one")}).drop("_one")
