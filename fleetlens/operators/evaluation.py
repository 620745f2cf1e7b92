"""Models against gold boxes, models against each other, annotators against each other, and sampling plans."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions import stats
from fleetlens.operators.detections import complete, overlap_pairs
from fleetlens.session import cut_lineage

BOX = ["ymin", "xmin", "ymax", "xmax"]


GROUP_PAIRS = 1_000_000  # pairs of an image and model that one task goes through in order
ROUNDS = 8


def _first_fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs in order of image, model and choice -> those whose two boxes are both still free. Holds one image's boxes at a time."""
    group, used, taken = None, set(), set()
    for batch in batches:
        keep = []
        image, model, det, gold = (batch.column(c).to_pylist() for c in ("image_id", "model", "det_id", "gold_id"))
        for i, key in enumerate(zip(image, model)):
            if key != group:
                group, used, taken = key, set(), set()
            if det[i] not in used and gold[i] not in taken:
                used.add(det[i])
                taken.add(gold[i])
                keep.append(i)
        yield batch.take(pa.array(keep, pa.int64()))


def _mutual_first(pairs: DataFrame) -> DataFrame:
    """Pairs that are first in the order of choice among all pairs of both their ends: one by one they would be taken too."""
    ends, gold_ends = ["image_id", "model", "det_id"], ["image_id", "model", "gold_id"]
    by_prediction = pairs.groupBy(*ends).agg(F.min(F.struct("prio", "label", "iou")).alias("f")).select(
        *ends, F.col("f.prio.g").alias("gold_id"), "f.label", "f.iou"
    )
    by_gold = pairs.groupBy(*gold_ends).agg(F.min("prio").alias("f")).select(*gold_ends, F.col("f.p").alias("det_id"))
    return by_prediction.join(by_gold, [*ends, "gold_id"])


def match_detections(predicted: DataFrame, gold: DataFrame, iou: float = 0.5, group_pairs: int = GROUP_PAIRS, rounds: int = ROUNDS) -> DataFrame:
    """One-to-one match of predictions to gold boxes of the same image and label, per model.

    Predictions choose in order of confidence (then det_id); each takes its free gold box with the highest
    IoU (then the smallest id). The pairs of an image and model are sorted in that order by Spark and gone through once in one
    task, which holds only the boxes taken. Where they are more than ``group_pairs``, at most ``rounds`` rounds, grouped
    per box, first take all pairs that nothing before them can prevent; that does not change the result.
    """
    left = complete(predicted).select("image_id", "label", "model", "det_id", "confidence", *BOX)
    right = complete(gold).select("image_id", "label", "det_id", *BOX)
    pairs = overlap_pairs(left, right, ["image_id", "label"], iou)
    group, ends, gold_ends = ["image_id", "model"], ["image_id", "model", "det_id"], ["image_id", "model", "gold_id"]
    prio = F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("c"), F.col("det_id").alias("p"),
                    (-F.col("iou")).alias("i"), F.col("other_det_id").alias("g"))
    columns = [*ends, "gold_id", "label", "iou"]
    rest = cut_lineage(pairs.select(*ends, F.col("other_det_id").alias("gold_id"), "label", "iou", prio.alias("prio")))
    large = cut_lineage(rest.groupBy(*group).agg(F.count("*").alias("n")).where(F.col("n") > group_pairs).drop("n"))
    taken = []
    if not large.isEmpty():
        open_pairs, rest = cut_lineage(rest.join(large, group)), rest.join(large, group, "left_anti")
        for _ in range(rounds):
            taken.append(cut_lineage(_mutual_first(open_pairs).select(*columns)))
            open_pairs = cut_lineage(
                open_pairs.join(taken[-1].select(*ends), ends, "left_anti").join(taken[-1].select(*gold_ends), gold_ends, "left_anti")
            )
        rest = rest.unionByName(open_pairs.select(rest.columns))
    ordered = rest.repartition(*group).sortWithinPartitions(*group, "prio").select(*columns)
    fitted = ordered.mapInArrow(_first_fit, ordered.schema)
    return reduce(DataFrame.unionByName, taken, fitted).select("image_id", "model", "label", "det_id", "gold_id", "iou")


def model_labels(predicted: DataFrame, n_gold: DataFrame) -> DataFrame:
    """Every model with every gold label: (model, label, n_gold). Models and labels are short lists."""
    models = predicted.agg(F.collect_set("model").alias("_models"))
    return n_gold.crossJoin(F.broadcast(models)).select(F.explode("_models").alias("model"), "label", "n_gold")  # one row


def precision_recall(matches: DataFrame, predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """TP, FP, FN, precision and recall per model and label; every model is held against all gold boxes, also of
    labels it never predicts (precision is null there)."""
    n_pred = complete(predicted).groupBy("model", "label").agg(F.count("*").alias("n_pred"))
    n_gold = complete(gold).groupBy("label").agg(F.count("*").alias("n_gold"))
    tp = matches.groupBy("model", "label").agg(F.count("*").alias("tp"))
    rows = model_labels(predicted, n_gold).join(n_pred, ["model", "label"], "full").join(tp, ["model", "label"], "left")
    rows = rows.fillna(0, ["tp", "n_gold", "n_pred"])
    return rows.select(
        "model", "label", "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_gold") - F.col("tp")).alias("fn"),
        F.round(F.try_divide(F.col("tp"), F.col("n_pred")), 9).alias("precision"),
        F.round(F.try_divide(F.col("tp"), F.col("n_gold")), 9).alias("recall"),
    )


def average_precision(matches: DataFrame, predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Interpolated average precision per model and gold label over the distinct confidences; 0 for a label that the
    model never predicts."""
    rows = complete(predicted).select("model", "label", "image_id", "det_id", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    hit = matches.select("image_id", "model", "det_id", F.lit(1).alias("_tp"))
    steps = rows.join(hit, ["image_id", "model", "det_id"], "left").groupBy("model", "label", "confidence").agg(
        F.count("_tp").alias("tp"), F.count("*").alias("n")
    )
    group = ["model", "label"]
    ran = stats.with_running(steps, group, [F.col("confidence").desc()], {"cum_tp": ("sum", "tp"), "cum_n": ("sum", "n")})
    ran = ran.withColumn("p", F.col("cum_tp") / F.col("cum_n"))
    best = stats.with_running(ran, group, [F.col("confidence").asc()], {"p_max": ("max", "p")})
    n_gold = complete(gold).groupBy("label").agg(F.count("*").alias("n_gold"))
    return model_labels(predicted, n_gold).join(best, group, "left").groupBy(*group).agg(
        F.round(F.coalesce(F.sum(F.col("tp") / F.col("n_gold") * F.col("p_max")), F.lit(0.0)), 9).alias("ap50")
    )


def mean_average_precision(ap: DataFrame) -> DataFrame:
    return ap.groupBy("model").agg(F.round(F.avg("ap50"), 8).alias("map50"), F.count("*").alias("n_classes"))


def mean_iou(matches: DataFrame, target: float = 0.75) -> DataFrame:
    mean = F.avg("iou")
    return matches.groupBy("model").agg(
        F.count("*").alias("n_matches"), F.round(mean, 9).alias("mean_iou"), (mean >= target).alias("on_target")
    )


def cohen_kappa(ratings: DataFrame) -> DataFrame:
    """Agreement of two raters beyond chance. Ratings: rater_a, rater_b, any number of classes."""
    cells = ratings.groupBy("rater_a", "rater_b").agg(F.count("*").alias("n"))
    marginal = lambda c, n: cells.groupBy(F.col(c).alias("k")).agg(F.sum("n").alias(n))
    chance = marginal("rater_a", "na").join(marginal("rater_b", "nb"), "k").agg(
        F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("both")
    )
    total = cells.agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("rater_a") == F.col("rater_b"), F.col("n")).otherwise(0)).alias("same")
    )
    row = total.crossJoin(chance)  # one row each
    po = F.col("same") / F.col("n")
    pe = F.col("both") / (F.col("n") * F.col("n"))
    return row.select(
        F.col("n").alias("n_items"), F.round(po, 9).alias("observed"), F.round(pe, 9).alias("expected"),
        F.round(F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(1.0), 9).alias("kappa"),
    )


def model_agreement(detections: DataFrame, iou: float = 0.5) -> DataFrame:
    """For every ordered pair of models: the share of the first one's boxes that the second one overlaps; 0 if none."""
    rows = complete(detections).select("image_id", "model", "det_id", *BOX)
    pairs = overlap_pairs(rows, rows, ["image_id"], iou, F.col("model") != F.col("other_model"))
    # a box meets few models, however many of their boxes
    others = pairs.groupBy("image_id", "model", "det_id").agg(F.collect_set("other_model").alias("others"))
    met = others.select("model", F.explode("others").alias("other_model")).groupBy("model", "other_model").agg(F.count("*").alias("n_met"))
    size = rows.groupBy("model").agg(F.count("*").alias("n_boxes"))
    others = size.agg(F.collect_set("model").alias("_others"))
    pairs_of = size.crossJoin(F.broadcast(others)).select("model", "n_boxes", F.explode("_others").alias("other_model"))  # one row
    return pairs_of.where("model <> other_model").join(met, ["model", "other_model"], "left").fillna(0, ["n_met"]).select(
        "model", "other_model", "n_met", "n_boxes", F.round(F.col("n_met") / F.col("n_boxes"), 9).alias("rate")
    )


def view_false_positives(matches: DataFrame, predicted: DataFrame, images: DataFrame) -> DataFrame:
    """Per view: false-positive share of the predictions and the share that came from tiles."""
    rows = complete(predicted).join(matches.select("image_id", "model", "det_id", F.lit(1).alias("_tp")),
                                    ["image_id", "model", "det_id"], "left")
    return rows.join(images.select("image_id", "view"), "image_id").groupBy("view").agg(
        F.count("*").alias("n_pred"), F.count_if(F.col("_tp").isNull()).alias("n_fp"),
        F.round(F.count_if(F.col("_tp").isNull()) / F.count("*"), 9).alias("fp_rate"),
        F.round(F.count_if(F.col("tile_idx") >= 0) / F.count("*"), 9).alias("tile_rate"),
    )


def new_damage_since(before: DataFrame, after: DataFrame, keys: list[str], iou: float = 0.3) -> DataFrame:
    """Boxes of the later scan that no box of the earlier one overlaps with ``iou`` or more."""
    seen = overlap_pairs(
        complete(after).select(*keys, "det_id", *BOX), complete(before).select(*keys, "det_id", *BOX), keys, iou
    ).select(*keys, "det_id").distinct()
    return complete(after).join(seen, [*keys, "det_id"], "left_anti")


# Sampling plans. The order is the md5 of seed and key, so a plan is repeatable and needs no random state.

def _draw(key: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), key.cast("string")))


def _in_share(key: Column, seed: str, share: float) -> Column:
    """True for about ``share`` of the keys."""
    return F.substring(_draw(key, seed), 1, 8) < F.lit(f"{int(share * 2**32):08x}")


def stratified_images(images: DataFrame, quota: int, per_car: int = 15, seed: str = "plan") -> DataFrame:
    """At most ``per_car`` images of a car, then at most ``quota`` per view and class. Both ranks are cut on
    the map side."""
    draw = _draw(F.col("image_id"), seed)
    rows = images.withColumn("_d", draw)
    by_car = F.row_number().over(Window.partitionBy("plate").orderBy("_d", "image_id"))
    rows = rows.withColumn("_rn", by_car).where(F.col("_rn") <= per_car).drop("_rn")
    by_cell = F.row_number().over(Window.partitionBy("view", "damage_class").orderBy("_d", "image_id"))
    return rows.withColumn("place", by_cell).where(F.col("place") <= quota).drop("_d")


def split_by_car(images: DataFrame, gold: float = 0.1, val: float = 0.1, seed: str = "split") -> DataFrame:
    """gold, val or train per image; all images of a car fall on one side."""
    plate = F.col("plate")
    return images.withColumn(
        "split",
        F.when(_in_share(plate, seed, gold), "gold").when(_in_share(plate, seed, gold + val), "val").otherwise("train"),
    )


def double_annotate(images: DataFrame, overlap: float = 0.10, spot: float = 0.05, seed: str = "qa") -> DataFrame:
    """Flags for images that two people annotate and for the expert's spot check."""
    key = F.col("image_id")
    return images.withColumns({
        "second_annotator": _in_share(key, seed, overlap), "spot_check": _in_share(key, seed + "-spot", spot),
    })
