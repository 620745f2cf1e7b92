"""Post-processing of model detections, one row per box:
image_id, det_id, label, confidence, ymin, xmin, ymax, xmax (+ any other columns)."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions import boxes as B
from fleetlens.functions import scalars as S
from fleetlens.operators.greedy import first_fit, large_groups
from fleetlens.session import cut_lineage


def complete(detections: DataFrame) -> DataFrame:
    """Drop rows with an incomplete box."""
    return detections.dropna(subset=B.CORNERS)


def suppress(
    detections: DataFrame, keys=("image_id",), iou: float = 0.4, max_group: int = 5000, bounded: bool = False
) -> DataFrame:
    """Greedy non-maximum suppression over all labels; a box goes if its IoU with a kept one is above ``iou``."""
    covers = lambda k, x: B.touches(k, x) & (B.iou(k, x) > iou)
    return first_fit(complete(detections), list(keys), covers, B.CORNERS, max_group, leaders_only=True, bounded=bounded).drop("leader_id")


def assign_clusters(
    detections: DataFrame, keys=("image_id",), radius: float = 120.0, max_group: int = 5000, bounded: bool = False
) -> DataFrame:
    """``leader_id``: the first box of the same label whose centre is nearer than ``radius``."""
    covers = lambda k, x: B.centre_distance(k, x) < radius
    return first_fit(B.with_centre(detections), [*keys, "label"], covers, ["cx", "cy"], max_group, bounded=bounded).drop("cx", "cy")


def collapse_clusters(
    detections: DataFrame, keys=("image_id",), max_per_cluster: int = 5, radius: float = 120.0,
    max_group: int = 5000, bounded: bool = False,
) -> DataFrame:
    """Replace every cluster of more than ``max_per_cluster`` boxes by its hull with low confidence.

    Boxes without a label are one label. Adds severity, is_cluster and cluster_size; boxes that stay keep all
    other columns, which are empty for a hull, as is ``found_in``. ``bounded``: no group has more than ``max_group`` boxes.
    """
    keys = list(keys)
    rows = assign_clusters(detections, keys, radius, max_group, bounded)
    if not bounded:
        rows = cut_lineage(rows)  # written once: both the hulls and the single boxes are taken from it
    if "found_in" not in rows.columns:
        rows = rows.withColumn("found_in", F.lit(None).cast("string"))
    if "severity" not in rows.columns:
        rows = rows.withColumn("severity", F.lit(None).cast("string"))
    group = [*keys, "label", "leader_id"]
    if bounded:
        return _collapse_in_place(rows, group, max_per_cluster)
    mean = F.sum(F.coalesce("confidence", F.lit(0.0))) / F.count("*")
    hulls = (
        rows.groupBy(*group)
        .agg(
            F.count("*").alias("cluster_size"),
            F.min("ymin").alias("ymin"), F.min("xmin").alias("xmin"),
            F.max("ymax").alias("ymax"), F.max("xmax").alias("xmax"),
            F.least(F.lit(0.4), mean * 0.5).alias("confidence"),
        )
        .where(F.col("cluster_size") > max_per_cluster)
    )
    gone = hulls.select(*[F.col(c).alias("_" + c) for c in group])
    same = reduce(and_, [F.col(c).eqNullSafe(F.col("_" + c)) for c in group])
    single = rows.join(gone, same, "left_anti").drop("leader_id").withColumns(
        {"is_cluster": F.lit(False), "cluster_size": F.lit(0).cast("long")}
    )
    merged = hulls.select(
        *keys, "label", F.col("leader_id").alias("det_id"), *B.CORNERS, "confidence",
        F.lit("uncertain").alias("severity"), F.lit(None).cast("string").alias("found_in"),
        F.lit(True).alias("is_cluster"), "cluster_size",
    )
    return single.unionByName(merged, allowMissingColumns=True)


def _collapse_in_place(rows: DataFrame, group: list[str], max_per_cluster: int) -> DataFrame:
    """The hulls and the boxes that stay, from windows over the clusters: a cluster lies within a group of the fold, so that its
    rows are in one task already and are neither written nor sent again."""
    cluster = Window.partitionBy(*group)
    mean = F.sum(F.coalesce("confidence", F.lit(0.0))).over(cluster) / F.count("*").over(cluster)
    sized = rows.withColumns({
        "_size": F.count("*").over(cluster), "_place": F.row_number().over(cluster.orderBy("det_id")), "_mean": mean,
        **{"_" + c: (F.min if c.endswith("min") else F.max)(c).over(cluster) for c in B.CORNERS},
    })
    hull = F.col("_size") > max_per_cluster
    as_hull = {
        **{c: F.col(c) for c in group[:-1]}, **{c: F.col("_" + c) for c in B.CORNERS}, "det_id": F.col("leader_id"),
        "confidence": F.least(F.lit(0.4), F.col("_mean") * 0.5), "severity": F.lit("uncertain"),
    }
    return sized.where(~hull | (F.col("_place") == 1)).select(
        *[F.when(hull, as_hull.get(c, F.lit(None))).otherwise(F.col(c)).alias(c) for c in rows.columns if c != "leader_id"],
        hull.alias("is_cluster"), F.when(hull, F.col("_size")).otherwise(0).alias("cluster_size"),
    )


def place_tiles(detections: DataFrame, images: DataFrame, grid: int = 3, overlap: float = 0.10) -> DataFrame:
    """Bring tile-local boxes of ``tile_idx`` into the coordinates of the whole image."""
    rest = [c for c in detections.columns if c not in ("image_id", "tile_idx")]
    # a tile's place follows from its number and the image's size, so one row per image is joined, not one per tile
    sized = detections.where(F.col("tile_idx").isin(*range(-1, grid * grid))).join(images.select("image_id", "width", "height"), "image_id")
    tile = F.struct("tile_x", "tile_y", "tile_w", "tile_h")
    # a generator of one row: what follows reads the numbers, where plain columns would be worked out anew in every expression
    tiled = B.with_tile(sized, grid, overlap).select("image_id", "tile_idx", *rest, "width", "height", F.inline(F.array(tile)))
    placed = B.rebase(tiled)
    return placed.drop("width", "height", "tile_x", "tile_y", "tile_w", "tile_h")


def _suppressed(placed: DataFrame, keys: list[str], iou: float) -> tuple[DataFrame, bool]:
    """The boxes that suppression leaves, and whether all groups are small. They are as a rule: then the groups are counted once,
    and all steps run where the join with the images has put the boxes."""
    bounded = large_groups(complete(placed), keys).isEmpty()
    kept = suppress(placed, keys, iou, bounded=bounded)
    return kept if bounded else cut_lineage(kept), bounded


def merge_tiles(
    detections: DataFrame, images: DataFrame, keys=("image_id", "model"), iou: float = 0.4,
    max_per_cluster: int = 5, radius: float = 120.0, collapse: bool = True,
) -> DataFrame:
    """Tile results to one list per image: rebase, suppress, collapse."""
    kept, bounded = _suppressed(place_tiles(detections, images), list(keys), iou)
    return collapse_clusters(kept, keys, max_per_cluster, radius, bounded=bounded) if collapse else kept


def merge_stats(
    detections: DataFrame, images: DataFrame, keys=("image_id", "model"), iou: float = 0.4,
    max_per_cluster: int = 5, radius: float = 120.0,
) -> DataFrame:
    """How many boxes each merge step left, and where the survivors come from."""
    keys = list(keys)
    placed = place_tiles(detections, images)
    kept, bounded = _suppressed(placed, keys, iou)
    merged = collapse_clusters(kept, keys, max_per_cluster, radius, bounded=bounded)
    # a hull stands for the boxes it replaced, so the end result tells how many suppression left
    steps = placed.select(*keys, F.lit(1).alias("pre"), F.lit(0).cast("long").alias("kept"), F.lit("").alias("found_in"), F.lit(False).alias("is_cluster")).unionByName(
        merged.select(*keys, F.lit(0).alias("pre"), F.when(F.col("is_cluster"), F.col("cluster_size")).otherwise(1).alias("kept"), "found_in", "is_cluster")
    )
    end = F.col("pre") == 0
    return steps.groupBy(*keys).agg(
        F.count_if(~end).alias("n_pre_nms"),
        F.sum("kept").alias("n_post_nms"),
        F.count_if(end).alias("n_after_cluster"),
        F.count_if(end & (F.col("found_in") == "overview")).alias("from_overview"),
        F.count_if(end & F.col("found_in").startswith("tile")).alias("from_tiles"),
        F.count_if(end & F.col("is_cluster")).alias("n_clusters"),
    )


def overlap_pairs(
    left: DataFrame, right: DataFrame, keys: list[str], min_iou: float, same: Column | None = None,
    cell: float = 200.0,
) -> DataFrame:
    """Box pairs of one group with IoU of at least ``min_iou`` (above 0).

    Both sides carry keys, ``det_id`` and corners; the right side's come back as ``other_*``. Boxes are
    spread over grid cells and joined per cell, so one image's boxes are split over many tasks and far
    boxes never meet. A pair is taken only in the cell of its shared corner, so it appears once.
    """
    def celled(df: DataFrame, prefix: str) -> DataFrame:
        low = lambda c: F.floor(F.col(prefix + c) / cell).cast("int")
        return df.withColumn("_cy", F.explode(F.sequence(low("ymin"), low("ymax")))).withColumn(
            "_cx", F.explode(F.sequence(low("xmin"), low("xmax")))
        )

    other = right.select(*keys, *[F.col(c).alias("other_" + c) for c in right.columns if c not in keys])
    ordered = lambda df, p: df.where(
        (F.col(p + "ymax") > F.col(p + "ymin")) & (F.col(p + "xmax") > F.col(p + "xmin"))
    )
    joined = celled(ordered(left, ""), "").join(celled(ordered(other, "other_"), "other_"), [*keys, "_cy", "_cx"])
    a = F.struct(*[F.col(c) for c in B.CORNERS])
    b = F.struct(*[F.col("other_" + c).alias(c) for c in B.CORNERS])
    once = (
        (F.floor(F.greatest("ymin", "other_ymin") / cell) == F.col("_cy"))
        & (F.floor(F.greatest("xmin", "other_xmin") / cell) == F.col("_cx"))
    )
    cond = once & (B.iou(a, b) >= min_iou) & (B.overlap_area(a, b) > 0)
    if same is not None:
        cond = cond & same
    return joined.where(cond).withColumn("iou", B.iou(a, b)).drop("_cy", "_cx")


def detections_per_model(detections: DataFrame, predictions: DataFrame) -> DataFrame:
    """Boxes, and images with at least one, per model with a stored prediction or a box; 0 where it found nothing."""
    models = predictions.select("model").distinct().unionByName(detections.select("model").distinct()).distinct()
    found = detections.groupBy("model").agg(
        F.count("*").alias("n_detections"), F.countDistinct("image_id").alias("n_images_with_detections")
    )
    return models.join(found, "model", "left").fillna(0, ["n_detections", "n_images_with_detections"])


def label_summary(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """``n× label · ...`` per group, most frequent first, then by name. Labels count as they come, a missing one as ``?``."""
    counted = rows.groupBy(*keys, F.coalesce(F.col(label), F.lit("?")).alias("_label")).agg(F.count("*").alias("_n"))
    entries = F.sort_array(F.collect_list(F.struct((-F.col("_n")).alias("o"), F.col("_label").alias("l"))))
    return counted.groupBy(*keys).agg(
        F.array_join(
            F.transform(entries, lambda e: F.concat((-e["o"]).cast("string"), F.lit("× "), e["l"])), " · "
        ).alias("summary"),
        F.sum("_n").alias("n_total"),
    )


def annotation_result(detections: Column) -> Column:
    """Detection array as rectangle results in percent, with defaults for missing parts."""
    def one(d: Column) -> Column:
        x, y, w, h = B.to_percent(*[d["bbox_2d"][i] for i in range(4)])
        return F.struct(
            F.lit("rectanglelabels").alias("type"),
            F.struct(
                x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height"),
                F.array(F.coalesce(d["label"], F.lit("other"))).alias("rectanglelabels"),
            ).alias("value"),
            F.coalesce(d["confidence"], F.lit(0.5)).alias("score"),
            F.struct(F.array(S.truncated(F.coalesce(d["reasoning"], F.lit("")))).alias("text")).alias("meta"),
        )

    return F.transform(B.valid_boxes(detections), one)


def task_score(detections: Column) -> Column:
    """Highest confidence of a detection array, 0 for none."""
    return F.coalesce(F.array_max(F.transform(detections, lambda d: F.coalesce(d["confidence"], F.lit(0.0)))), F.lit(0.0))


def cluster_trigger_rate(merged: DataFrame) -> DataFrame:
    """Share of images per model in which at least one cluster was collapsed."""
    per_image = merged.groupBy("model", "image_id").agg(F.max(F.col("is_cluster").cast("int")).alias("fired"))
    return per_image.groupBy("model").agg(
        F.count("*").alias("n_images"), F.sum("fired").alias("n_triggered"),
        (F.sum("fired") / F.count("*")).alias("trigger_rate"),
    )
