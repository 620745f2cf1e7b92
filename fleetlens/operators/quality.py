"""Image scores and filters over the image manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import scalars as S
from fleetlens.functions import stats, vocab

MARKS = [0.05, 0.95]


def image_score(images: DataFrame) -> DataFrame:
    """Add ``quality_score`` (0-100, one decimal) from percentile-normalised metrics."""
    metrics = {
        "sharpness": F.col("sharpness"), "contrast": F.col("contrast"), "saturation": F.col("saturation"),
        "min_side": S.min_side(), "overexp_pct": F.col("overexp_pct"), "underexp_pct": F.col("underexp_pct"),
    }
    n = {k: stats.normalised(c, F.col("_marks")[k]) for k, c in metrics.items()}
    score = (
        0.35 * n["sharpness"] + 0.20 * n["contrast"] + 0.10 * n["saturation"] + 0.10 * n["min_side"]
        + 0.15 * (1 - n["overexp_pct"]) + 0.10 * (1 - n["underexp_pct"])
    )
    marked = stats.with_percentiles(images, metrics, MARKS, "_marks")
    return marked.withColumn("quality_score", S.round_even(score * 100, 1)).drop("_marks")


def hard_fail(images: DataFrame) -> DataFrame:
    """Add ``hard_fail_reasons`` and ``is_hard_fail``."""
    return images.withColumn("hard_fail_reasons", S.hard_fail_reasons()).withColumn(
        "is_hard_fail", F.size("hard_fail_reasons") > 0
    )


def score_cut(scored: DataFrame, keep_share: float = vocab.KEEP_TOP_SHARE) -> DataFrame:
    """Keep the best share of the usable images; adds score_cut, score_pass, keep_pre_dedup, filter_reasons."""
    usable = F.when(~F.col("is_hard_fail"), F.col("quality_score"))
    cut = stats.percentiles(scored, {"s": usable}, [1 - keep_share]).select(
        F.coalesce(F.col("s")[0], F.lit(100.0)).alias("score_cut")
    )
    rows = scored.crossJoin(F.broadcast(cut))  # one row
    below = ~F.col("is_hard_fail") & ~F.col("score_pass")
    return (
        rows.withColumn("score_pass", F.col("quality_score") >= F.col("score_cut"))
        .withColumn("keep_pre_dedup", ~F.col("is_hard_fail") & F.col("score_pass"))
        .withColumn(
            "filter_reasons",
            F.when(below, F.array_append("hard_fail_reasons", F.lit("below_score_threshold")))
            .otherwise(F.col("hard_fail_reasons")),
        )
    )


def filtered_images(images: DataFrame) -> DataFrame:
    return score_cut(hard_fail(image_score(images)))


def reason_histogram(filtered: DataFrame) -> DataFrame:
    """Images per filter reason, and a ``duplicates`` row when clusters were marked."""
    out = filtered.select(F.explode("filter_reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    if "is_cluster_best" in filtered.columns:
        lost = filtered.agg(
            F.count_if(F.col("keep_pre_dedup") & ~F.col("is_cluster_best")).alias("n")
        ).select(F.lit("duplicates").alias("reason"), "n")
        out = out.unionByName(lost)
    return out


def keep_by_view(filtered: DataFrame, flag: str = "keep_final") -> DataFrame:
    kept = F.count_if(F.col(flag))
    return filtered.groupBy("view").agg(
        kept.alias("kept"), F.count("*").alias("total"),
        F.round(100.0 * kept / F.count("*"), 6).alias("kept_pct"),
    )


def filter_summary(filtered: DataFrame, flag: str = "keep_final") -> DataFrame:
    kept = F.count_if(F.col(flag))
    return filtered.agg(
        F.count("*").alias("total"), kept.alias("kept"), (F.count("*") - kept).alias("discarded"),
        F.count_if("is_hard_fail").alias("n_hard_fail"),
        F.round(100.0 * kept / F.count("*"), 6).alias("kept_pct"),
    )


def metric_histogram(images: DataFrame, metrics: list[str], log: tuple[str, ...] = (), bins: int = 60) -> DataFrame:
    """Counts per equal-width bin (0-based) between a metric's extremes. Metrics in ``log`` are floored at 0.001."""
    long = images.select(F.explode(F.array(*[
        F.struct(
            F.lit(m).alias("metric"),
            (F.greatest(F.col(m).cast("double"), F.lit(0.001)) if m in log else F.col(m).cast("double")).alias("value"),
        ) for m in metrics
    ])).alias("m")).select("m.*").where(F.col("value").isNotNull())
    ends = long.groupBy("metric").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    ends = ends.select(
        "metric", F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    at = F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
    binned = long.join(F.broadcast(ends), "metric").withColumn(  # one row per metric
        "bin", F.least(at, F.lit(bins - 1)).cast("int")
    )
    return binned.groupBy("metric", "bin").agg(F.count("*").alias("n"))


def sample_rows(filtered: DataFrame, n: int = 12) -> DataFrame:
    """Rows for the eye: best, worst, best rejected, worst kept; ties by image id."""
    best = [F.col("quality_score").desc(), F.col("image_id")]
    worst = [F.col("quality_score").asc(), F.col("image_id")]
    parts = [
        ("best", filtered, best), ("worst", filtered, worst),
        ("best_rejected", filtered.where(~F.col("keep_final")), best),
        ("worst_kept", filtered.where(F.col("keep_final")), worst),
    ]
    out = None
    for name, rows, order in parts:
        top = rows.orderBy(*order).limit(n).select(F.lit(name).alias("sample"), "image_id", "quality_score")
        out = top if out is None else out.unionByName(top)
    return out
