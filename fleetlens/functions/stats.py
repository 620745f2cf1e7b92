"""Exact percentiles, score normalisation and global row positions without one-task steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.session import cut_lineage


def percentiles(df: DataFrame, metrics: dict[str, Column], probs: list[float]) -> DataFrame:
    """One row holding, per metric, the array of its linearly interpolated percentiles.

    Rows are first counted per (metric, value) on all tasks. The metrics are stored rounded (at most
    two digits within the range of 8-bit pixels, scores of 0-100 with one digit), so the number of
    distinct values reaching the final step does not grow with the table.
    """
    long = df.select(
        F.explode(F.array(*[
            F.struct(F.lit(name).alias("metric"), c.cast("double").alias("value")) for name, c in metrics.items()
        ])).alias("m")
    ).select("m.*").where(F.col("value").isNotNull())
    counted = long.groupBy("metric", "value").agg(F.count("*").alias("n"))
    marks = F.array(*[F.lit(p) for p in probs])
    per_metric = counted.groupBy("metric").agg(F.percentile("value", marks, F.col("n")).alias("marks"))
    return per_metric.groupBy().agg(
        *[F.max(F.when(F.col("metric") == name, F.col("marks"))).alias(name) for name in metrics]
    )


def with_percentiles(df: DataFrame, metrics: dict[str, Column], probs: list[float], name: str) -> DataFrame:
    """Attach the one-row percentile table as the struct ``name``."""
    row = percentiles(df, metrics, probs).select(F.struct(*metrics).alias(name))
    return df.crossJoin(F.broadcast(row))  # one row


def normalised(value: Column, marks: Column) -> Column:
    """Position of ``value`` between two percentiles, clipped to 0-1."""
    span = F.greatest(marks[1] - marks[0], F.lit(1e-9))
    return F.greatest(F.least((value - marks[0]) / span, F.lit(1.0)), F.lit(0.0))


def with_global_position(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """0-based row number in a total order, from a range sort and per-partition offsets.

    The sorted rows are materialised, since a range partitioning may be cut differently when it is
    computed twice. The offsets table has one row per partition.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_partition = (1 << 33) - 1
    ranged = df.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    marked = cut_lineage(ranged.withColumn("_mark", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned(F.col("_mark"), 33)
    sizes = marked.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        marked.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")  # one row per partition
        .withColumn(name, F.col("_before") + F.col("_mark").bitwiseAND(F.lit(in_partition)))
        .drop("_part", "_mark", "_before")
    )


def with_running(
    df: DataFrame, group: list[str], order: list[Column], totals: dict[str, tuple[str, str]]
) -> DataFrame:
    """Inclusive running ``sum`` or ``max`` per group, ``totals`` = {name: (operation, column)}.

    A group may be larger than a task: rows are range-partitioned by group and order, each partition
    runs on its own, and the totals of the partitions before it are added from a small table.
    """
    ops = {"sum": F.sum, "max": F.max}
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(g) for g in group]
    marked = cut_lineage(
        df.repartitionByRange(partitions, *keys, *order).withColumn("_part", F.spark_partition_id())
    )
    parts = marked.groupBy("_part", *group).agg(*[ops[op](c).alias(n) for n, (op, c) in totals.items()])
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("_part", *group, *[ops[op](n).over(before).alias("_c_" + n) for n, (op, _) in totals.items()])
    here = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = marked.join(carried, ["_part", *group])
    for n, (op, c) in totals.items():
        own = ops[op](c).over(here)
        add = F.coalesce(F.col("_c_" + n), F.lit(0)) + own if op == "sum" else F.greatest(own, F.col("_c_" + n))
        out = out.withColumn(n, add)
    return out.drop("_part", *["_c_" + n for n in totals])
