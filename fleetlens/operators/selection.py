"""Class-balanced selection of cars: plate_safe, car_score, damage_classes (array)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import vocab
from fleetlens.operators import cars as C
from fleetlens.operators import damages as D
from fleetlens.operators import quality
from fleetlens.session import cut_lineage


def _best(rows: DataFrame, n: int) -> DataFrame:
    """A distributed top-n by score, ties by plate."""
    return rows.orderBy(F.col("car_score").desc(), "plate_safe").limit(n)


def stratified_pick(eligible: DataFrame, targets: dict[str, int] | None = None) -> DataFrame:
    """Pick the best cars class by class, rarest target first, then fill up by score.

    Every pick counts for all classes of the car. Adds ``picked_for`` (class, or ``fill``). The loop runs
    once per class; only the coverage counts reach the driver, and the picks stay below the sum of targets.
    """
    targets = vocab.STRATA_TARGETS if targets is None else targets
    rows = cut_lineage(eligible.select("plate_safe", "car_score", "damage_classes"))
    picked = None
    cover = dict.fromkeys(targets, 0)
    taken = 0

    def left() -> DataFrame:
        return rows if picked is None else rows.join(picked.select("plate_safe"), "plate_safe", "left_anti")

    for cls in sorted(targets, key=targets.get):
        want = targets[cls] - cover[cls]
        if want <= 0:
            continue
        step = _best(left().where(F.array_contains("damage_classes", cls)), want).withColumn("picked_for", F.lit(cls))
        picked = cut_lineage(step if picked is None else picked.unionByName(step))
        counts = picked.agg(
            F.count("*").alias("_n"), *[F.count_if(F.array_contains("damage_classes", c)).alias(c) for c in targets]
        ).first()
        taken = counts["_n"]
        cover = {c: counts[c] for c in targets}
    missing = sum(targets.values()) - taken
    if missing > 0:
        fill = _best(left(), missing).withColumn("picked_for", F.lit("fill"))
        picked = fill if picked is None else picked.unionByName(fill)
    return picked


def pick_showcase(selected: DataFrame, targets: list[tuple[str, int]] | None = None, limit: int = 10) -> DataFrame:
    """A few top cars of each class, none twice, with their place in the list."""
    targets = vocab.SHOWCASE_TARGETS if targets is None else targets
    rows = cut_lineage(selected.select("plate_safe", "car_score", "damage_classes"))
    picked = None
    for step_no, (cls, n) in enumerate(targets):
        rest = rows if picked is None else rows.join(picked.select("plate_safe"), "plate_safe", "left_anti")
        step = _best(rest.where(F.array_contains("damage_classes", cls)), n).withColumns(
            {"picked_for": F.lit(cls), "step": F.lit(step_no)}
        )
        picked = cut_lineage(step if picked is None else picked.unionByName(step))
    return picked.orderBy("step", F.col("car_score").desc(), "plate_safe").limit(limit)


def class_coverage(picked: DataFrame, targets: dict[str, int] | None = None) -> DataFrame:
    """Selected cars per class next to the target."""
    targets = vocab.STRATA_TARGETS if targets is None else targets
    flags = [
        F.struct(F.lit(c).alias("damage_class"), F.lit(n).alias("target"),
                 F.count_if(F.array_contains("damage_classes", c)).alias("n_cars"))
        for c, n in targets.items()
    ]
    return picked.agg(F.array(*flags).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def scored_cars(images: DataFrame, register: DataFrame) -> DataFrame:
    """Car manifest with score and damage classes; expects the flat register."""
    scored = quality.hard_fail(quality.image_score(images))
    cars = C.car_score(C.car_aggregate(scored, C.register_counts(register)))
    damages = register.where(F.col("damage_pos").isNotNull())
    classes = D.damage_classes(damages)
    return cars.join(classes, "plate_original", "left").withColumn(
        "damage_classes", F.coalesce("damage_classes", F.array().cast("array<string>"))
    )


def select_cars(
    images: DataFrame, register: DataFrame, percent: int = 60, targets: dict[str, int] | None = None
) -> DataFrame:
    """Best share of the cars, then the class-balanced pick."""
    return stratified_pick(C.top_percent(scored_cars(images, register), percent), targets)


def images_of(images: DataFrame, cars: DataFrame) -> DataFrame:
    """The images of the given cars."""
    return images.join(cars.select(F.col("plate_safe").alias("plate")), "plate", "left_semi")
