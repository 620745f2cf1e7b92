"""Mixing sources to target weights by capped water-filling, on DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.stats import with_global_position
from fleetlens.llm.common import n_words, stored


def source_weights(sources: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``sources`` (one row per source) with weight: the cycle's values in code point order, null last."""
    placed = with_global_position(sources, [F.col("source").isNull(), F.col("source")], "_place")
    return placed.withColumn("weight", F.array(*[F.lit(w) for w in cycle])[F.pmod("_place", F.lit(len(cycle))).cast("int")].cast("long")).drop("_place")


def water_fill(sources: DataFrame, max_epochs: int = 3) -> DataFrame:
    """``sources`` (source, source_size, weight) with target.

    The sum of all sizes is shared by weight; a source above ``max_epochs`` times its size is clamped there and
    the excess is shared again, until none is above. Each round is one aggregate over the sources; only its
    one row (what is left to share, and the weights that share it) reaches the driver. A source of size 0 gets
    0. All sums are whole numbers, so reruns agree.
    """
    cap = F.col("source_size") * max_epochs
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    rest, shares = total, None
    while True:
        # a source is clamped if its share at the present level reaches its cap; the level only rises
        clamped = F.lit(False) if shares is None else (
            F.col("source_size").cast("decimal(30,0)") * F.lit(max_epochs * shares) <= F.col("weight").cast("decimal(18,0)") * F.lit(rest)
        )
        row = sources.agg(
            F.coalesce(F.sum(F.when(clamped, cap)), F.lit(0)), F.sum(F.when(~clamped, F.col("weight"))), F.sum(F.when(clamped, 1))
        ).first()
        now = (total - row[0], row[1])
        if not now[1] or now == (rest, shares):
            break
        rest, shares = now
    if shares is None:  # no source at all
        return sources.withColumn("target", F.lit(0.0))
    share = F.lit(rest).cast("double") * F.col("weight") / F.lit(shares)
    return sources.withColumn("target", F.when(clamped, cap.cast("double")).otherwise(share))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42,
    max_epochs: int = 3, weights: DataFrame | None = None, bins: int = 4096,
) -> DataFrame:
    """One row per row of ``docs``: id, size (words), source, source_size, target, taken.

    ``weights`` (source, weight) sets the targets; without it weights cycle 1, 2, 3 over the sources in code
    point order, null last (null is a source of its own); a source without a weight gets 0. A source is repeated whole as often as it goes into its
    target; of the rest, documents are taken once more in a seeded order until the target is met, the last
    one by its first words only, so a source misses its target by less than one word. No document is
    taken more than ``max_epochs`` times. Null and empty texts have size 0 and nothing is taken of them; repeated
    rows are taken like any other; empty input gives empty output; other columns are not read.

    The seeded order is cut into ``bins`` bins per source. Bins are summed first; only within a bin are rows
    ordered, so that one source holding a third of all rows is spread over thousands of groups.
    """
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")
    name = F.col(source_col).cast("string")
    key = F.coalesce(F.concat(F.lit("s"), name), F.lit("null"))  # a join key for the null source too
    rows = stored(docs.select(
        F.col(id_col).alias("id"), key.alias("key"), n_words(F.col(text_col)).alias("size"), draw.alias("u")
    ).withColumn("bin", F.expr(f"u div {(1 << 60) // bins}")), "mix-rows")
    per_bin = stored(rows.groupBy("key", "bin").agg(F.sum("size").alias("bin_size")), "mix-bins")
    sizes = per_bin.groupBy("key").agg(F.sum("bin_size").alias("source_size")).withColumn(
        "source", F.when(F.col("key") != "null", F.expr("substring(key, 2)"))
    )
    weighed = source_weights(sizes) if weights is None else sizes.join(
        weights.select(F.col("source").alias("_s"), F.col("weight").cast("long").alias("_w")), F.col("source").eqNullSafe(F.col("_s")), "left"
    ).withColumn("weight", F.coalesce("_w", F.lit(0).cast("long"))).drop("_s", "_w")
    levels = stored(water_fill(stored(weighed, "mix-weights"), max_epochs), "mix-targets")
    whole = F.floor(F.col("target") + 0.5)
    quota = levels.select(
        "key", "source", "source_size", "target",
        F.expr("floor(target + 0.5) div greatest(source_size, 1)").alias("epochs"),
        F.pmod(whole, F.greatest("source_size", F.lit(1))).alias("rest"),
    )
    before = Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(per_bin.withColumn("start", F.coalesce(F.sum("bin_size").over(before), F.lit(0))).join(
        quota, "key"
    ).drop("bin_size"), "mix-starts")
    in_bin = Window.partitionBy("key", "bin").orderBy("u", F.col("id").isNull(), "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("ahead", F.coalesce(F.sum("size").over(in_bin), F.lit(0))).join(starts, ["key", "bin"])
    extra = F.least(F.greatest(F.col("rest") - F.col("start") - F.col("ahead"), F.lit(0)), F.col("size"))
    return placed.select(
        F.col("id").alias(id_col), "size", "source", "source_size", "target", (F.col("epochs") * F.col("size") + extra).alias("taken")
    )


def repeated(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, each as often as ``mixed`` (one row per id) takes it; a document taken in part counts
    if at least half of it is taken. All columns of ``docs`` are kept as they are."""
    times = F.expr("cast(floor(taken / greatest(size, 1) + 0.5) as int)")
    wanted = mixed.where("taken > 0").groupBy(F.col(id_col).alias("_mix_id")).agg(F.max(times).alias("_mix_n")).where("_mix_n > 0")
    joined = docs.join(wanted, F.col(id_col).eqNullSafe(F.col("_mix_id")))
    return joined.withColumn("_mix_k", F.explode(F.sequence(F.lit(1), "_mix_n"))).drop("_mix_id", "_mix_n", "_mix_k")
