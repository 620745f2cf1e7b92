"""Structured Streaming over scan telemetry and inspections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.session import scratch_path


def session_totals(attempts: DataFrame) -> DataFrame:
    """Running totals per session; the same expression serves batch and stream."""
    return attempts.groupBy("session_id").agg(
        F.count("*").alias("n_attempts"), F.count_if(F.col("attempt") > 1).alias("n_retries"),
        F.count_if(F.col("error").isNotNull()).alias("n_errors"),
        *[F.sum(c).alias(c) for c in ("bytes_sent", "bytes_received", "latency_ms", "prompt_tokens", "completion_tokens")],
    )


def run_session_totals(attempts: DataFrame, path: str, checkpoint: str) -> None:
    """Write every changed session with its batch number; see :func:`read_session_totals`."""
    def keep(batch: DataFrame, batch_id: int) -> None:
        # one folder per batch: a replayed batch replaces its own output
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    query = (
        session_totals(attempts).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(keep).start()
    )
    query.awaitTermination()


def read_session_totals(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in ("session_id", "batch_id")]
    return rows.groupBy("session_id").agg(F.max_by(F.struct(*rest), "batch_id").alias("_t")).select("session_id", "_t.*")


def coverage_windows(rows: DataFrame, ts: str, hours: int = 6, delay: str = "10 minutes") -> DataFrame:
    """Rows per window; a window is final once the watermark has passed its end."""
    return rows.withWatermark(ts, delay).groupBy(F.window(ts, f"{hours} hours").alias("w")).agg(
        F.count("*").alias("n")
    ).select(F.col("w.start").alias("chunk_start"), F.col("w.end").alias("chunk_end"), "n")


def run_append(rows: DataFrame, path: str, checkpoint: str) -> None:
    """Drain the stream into Parquet."""
    query = (
        rows.writeStream.outputMode("append").format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def drain(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """Run an append stream to its end in a fresh scratch folder and return what it wrote."""
    path = scratch_path(spark, name)
    run_append(rows, path, scratch_path(spark, name + "-log"))
    return spark.read.parquet(path)


def session_photos(photos: DataFrame, idle_minutes: int = 30, delay: str = "10 minutes", n_views: int = 12) -> DataFrame:
    """Photo events (session_id, view_idx, captured_at, seq, removed, n_damages) to one row per closed session.

    A session of one session_id ends when no photo follows for ``idle_minutes``; it comes out once the watermark has
    passed that end, and photos that arrive later still are dropped (the query's progress counts them). Of each view
    the newest photo counts; earlier ones are retakes. Views 0 ... ``n_views`` - 1 keep one photo each in the state; photos
    of any other view (null is one view) are kept until the session closes. The same expression serves batch and stream.
    """
    taken_at = F.struct("captured_at", "seq")
    newest = [
        F.max_by(F.struct("removed", "n_damages"), F.when(F.col("view_idx") == v, taken_at)).alias(f"_v{v}") for v in range(n_views)
    ]
    known = F.coalesce(F.col("view_idx").between(0, n_views - 1), F.lit(False))
    other = F.collect_list(F.when(~known, F.struct("captured_at", "seq", "removed", "n_damages", "view_idx")))
    closed = photos.withWatermark("captured_at", delay).groupBy(
        "session_id", F.session_window("captured_at", f"{idle_minutes} minutes").alias("w")
    ).agg(F.count("*").alias("n_photos"), other.alias("_other"), *newest)
    of_other = F.transform(F.array_distinct(F.transform("_other", lambda p: p["view_idx"])), lambda v: F.array_max(
        F.filter("_other", lambda p: p["view_idx"].eqNullSafe(v))
    ))
    current = F.concat(
        F.filter(F.array(*[f"_v{v}" for v in range(n_views)]), lambda p: p.isNotNull()),
        F.transform(of_other, lambda p: F.struct(p["removed"].alias("removed"), p["n_damages"].alias("n_damages"))),
    )
    live = F.filter(current, lambda p: ~p["removed"])
    return closed.select(
        "session_id", F.size(live).cast("long").alias("n_views"), "n_photos", (F.col("n_photos") - F.size(current)).alias("n_retakes"),
        (F.size(current) - F.size(live)).cast("long").alias("n_removed"),
        F.aggregate(live, F.lit(0).cast("long"), lambda total, p: total + p["n_damages"]).alias("n_damages"),
        F.col("w.end").alias("closed_at"),
    )
