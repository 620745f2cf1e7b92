"""The damage register, flat: one row per damage with plate_original, case_id, case_ts, pos, damage_id,
type, grp, side, part, part_local, severity, severity_local."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions import scalars as S


def photo_times(export_tasks: DataFrame) -> DataFrame:
    """Newest valid completion time per plate."""
    return (
        export_tasks.groupBy("plate_original")
        .agg(F.max(S.safe_timestamp(F.col("completed_at"))).alias("photo_ts"))
        .where(F.col("photo_ts") > F.timestamp_seconds(F.lit(0)))
    )


def flag_late_cases(damages: DataFrame, times: DataFrame) -> DataFrame:
    """Add ``is_late``: the case was registered at or after the newest photo. Unknown times never drop a case."""
    late = F.coalesce(F.col("case_ts") >= F.col("photo_ts"), F.lit(False))
    return damages.join(times, "plate_original", "left").withColumn("is_late", late)


def first_in_case(damages: DataFrame) -> DataFrame:
    """One row per damage id of a case, the first in list order; missing ids count as one id."""
    key = ["plate_original", "case_id", "_id"]
    rest = [c for c in damages.columns if c not in ("plate_original", "case_id", "pos")]
    return (
        damages.withColumn("_id", F.coalesce("damage_id", F.lit("")))
        .groupBy(*key)
        .agg(F.min("pos").alias("pos"), F.min_by(F.struct(*rest), "pos").alias("_d"))
        .select("plate_original", "case_id", "pos", "_d.*")
    )


def visible_damages(damages: DataFrame, times: DataFrame) -> DataFrame:
    """Damages that can be seen on the photos: case older than the photo, first of its id, body groups only."""
    kept = first_in_case(flag_late_cases(damages, times).where(~F.col("is_late"))).where(S.group_allowed(F.col("grp")))
    return kept.select(
        "plate_original", "case_id", "damage_id", "type",
        S.damage_class(F.col("type")).alias("master_class"),
        S.damage_part(F.col("part_local"), F.col("part")).alias("part"),
        "side",
        S.damage_severity(F.col("severity_local"), F.col("severity")).alias("severity"),
        "grp",
    )


def filter_stats(damages: DataFrame, times: DataFrame) -> DataFrame:
    """Per plate: damages lost by time (all rows of a late case), lost by group (after the id rule), kept."""
    flagged = flag_late_cases(damages, times)
    late = flagged.where("is_late").groupBy("plate_original").agg(
        F.count("*").alias("by_time"), F.lit(0).cast("long").alias("by_group"), F.lit(0).cast("long").alias("kept")
    )
    allowed = S.group_allowed(F.col("grp"))
    rest = first_in_case(flagged.where(~F.col("is_late"))).groupBy("plate_original").agg(
        F.lit(0).cast("long").alias("by_time"), F.count_if(~allowed).alias("by_group"), F.count_if(allowed).alias("kept")
    )
    return late.unionByName(rest).groupBy("plate_original").agg(
        *[F.sum(c).alias(c) for c in ("by_time", "by_group", "kept")]
    )


def damage_classes(damages: DataFrame) -> DataFrame:
    """Sorted set of damage classes per plate (at most seven)."""
    return damages.groupBy("plate_original").agg(
        F.sort_array(F.collect_set(S.damage_class(F.col("type")))).alias("damage_classes")
    )


def case_photos(visible: DataFrame, photos: DataFrame) -> DataFrame:
    """Photos of the cases that still hold a damage, with their 1-based place inside the case kept by sort key."""
    cases = visible.select("plate_original", "case_id").distinct()
    return photos.join(cases, ["plate_original", "case_id"], "left_semi")


def damages_per_coordinate(damages: DataFrame) -> DataFrame:
    """One row per marked coordinate, and one with empty coordinates for an unmarked damage."""
    return damages.select(
        "plate_original", "case_id", "damage_id", "type", S.damage_class(F.col("type")).alias("master_class"),
        F.coalesce(S.filled(F.col("part_local")), F.col("part")).alias("part"), "side",
        F.coalesce(S.filled(F.col("severity_local")), F.col("severity")).alias("severity"),
        F.explode_outer("coordinates").alias("_c"),
    ).select("*", "_c.projection", "_c.segment").drop("_c")


def projection_filter(coordinates: DataFrame, mapping: DataFrame) -> DataFrame:
    """Pair damages with the views their projection can be seen in. ``mapping``: projection, view."""
    return coordinates.join(mapping, "projection")


def car_sheet(damages: DataFrame, first: int = 30) -> DataFrame:
    """Per plate the first damages in register order and how many more there are.

    ``rows`` holds at most ``first`` entries; the rank is cut on the map side.
    """
    order = Window.partitionBy("plate_original").orderBy("case_id", "pos")
    text = F.concat_ws(
        " · ", S.damage_class(F.col("type")), F.coalesce(S.filled(F.col("part_local")), F.col("part")),
        "side", F.substring(F.coalesce(S.filled(F.col("severity_local")), F.col("severity")), 1, 50),
    )
    slim = damages.select("plate_original", "case_id", "pos", text.alias("line"))
    top = (
        slim.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= first)
        .groupBy("plate_original")
        .agg(F.sort_array(F.collect_list(F.struct("_rn", "line"))).alias("_top"))
    )
    total = slim.groupBy("plate_original").agg(F.count("*").alias("n_damages"))
    return total.join(top, "plate_original").select(
        "plate_original", "n_damages", F.array_join(F.transform("_top", lambda t: t["line"]), " | ").alias("rows"),
        F.greatest(F.col("n_damages") - first, F.lit(0)).alias("n_more"),
    )
