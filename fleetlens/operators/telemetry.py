"""Scan telemetry: attempts -> calls -> photos -> sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import scalars as S

SETTINGS = ["model", "tile_mode", "max_side"]


def call_rollup(attempts: DataFrame) -> DataFrame:
    """One row per call: bytes and latency summed, outcome and tokens of the last attempt."""
    last = ["view_idx", "tile_idx", "http_status", "error", "prompt_tokens", "completion_tokens", *SETTINGS, "captured_at"]
    return attempts.groupBy("session_id", "call_id").agg(
        F.sum("bytes_sent").alias("bytes_sent"), F.sum("bytes_received").alias("bytes_received"),
        F.sum("latency_ms").alias("latency_ms"), F.count_if(F.col("attempt") > 1).alias("retry_count"),
        F.max_by(F.struct(*last), "attempt").alias("_last"),
    ).select("session_id", "call_id", "bytes_sent", "bytes_received", "latency_ms", "retry_count", "_last.*")


def photo_rollup(calls: DataFrame) -> DataFrame:
    """One row per photo. Calls run side by side, so the latency is the longest one."""
    photos = calls.groupBy("session_id", "view_idx").agg(
        F.count("*").alias("n_calls"), F.max("latency_ms").alias("latency_ms"),
        *[F.sum(c).alias(c) for c in ("bytes_sent", "bytes_received", "prompt_tokens", "completion_tokens", "retry_count")],
        F.max(F.col("error").isNotNull()).alias("had_error"),
        F.max("captured_at").alias("captured_at"),
        F.max_by(F.struct(*SETTINGS), "call_id").alias("_s"),
    ).select("*", "_s.*").drop("_s")
    usd = S.usd_cost(S.price_key(F.col("model")), F.col("prompt_tokens"), F.col("completion_tokens"))
    return photos.withColumn("usd", usd)


def p95_seconds() -> Column:
    """Aggregate: the element at ``min(int(n * 0.95), n - 1)`` of the sorted latencies, no interpolation. A session holds
    each view once, so it has no more latencies than there are views."""
    latencies = F.sort_array(F.collect_list("latency_ms"))
    n = F.size(latencies)
    return F.get(latencies, F.least(F.floor(n * 0.95), n - 1).cast("int")) / 1000.0


def latency_p95(photos: DataFrame) -> DataFrame:
    return photos.groupBy("session_id").agg(p95_seconds().alias("p95_latency_s"))


def session_rollup(photos: DataFrame, n_expected: int = 12) -> DataFrame:
    """Session totals, in one aggregate. Optional photo columns: n_damages, auto_retry_count."""
    zero = F.lit(0)
    extra = {c: (F.col(c) if c in photos.columns else zero) for c in ("n_damages", "auto_retry_count")}
    micros = lambda c: F.unix_micros(c.cast("timestamp"))  # logged times may come without a zone
    seconds = (micros(F.max("captured_at")) - micros(F.min("captured_at"))) / 1000000.0
    done = F.countDistinct("view_idx")
    return photos.groupBy("session_id").agg(
        F.lit(n_expected).alias("n_expected_views"), done.alias("n_completed_views"),
        F.greatest(n_expected - done, zero).alias("n_missing_views"),
        F.count("*").alias("n_photos"), F.sum(extra["n_damages"]).alias("n_damages_total"),
        F.count_if("had_error").alias("n_errors"), F.sum("retry_count").alias("n_retries"),
        F.sum(extra["auto_retry_count"]).alias("n_auto_retries"),
        F.sum("bytes_sent").alias("total_bytes_sent"), F.sum("bytes_received").alias("total_bytes_received"),
        F.sum("prompt_tokens").alias("total_prompt_tokens"), F.sum("completion_tokens").alias("total_completion_tokens"),
        F.round(F.sum("usd"), 9).alias("total_usd_estimated"),
        F.round(F.avg("latency_ms") / 1000.0, 9).alias("avg_latency_s"),
        seconds.alias("duration_s"), p95_seconds().alias("p95_latency_s"),
    )


def view_coverage(photos: DataFrame, expected: list[str]) -> DataFrame:
    """Completed views in shooting order and the expected ones that are missing.

    Needs ``view`` and ``view_idx``; a session holds each view name once, so its arrays are bounded by
    the view vocabulary.
    """
    views = photos.groupBy("session_id", "view").agg(F.min("view_idx").alias("view_idx"))
    done = F.transform(F.sort_array(F.collect_list(F.struct("view_idx", "view"))), lambda v: v["view"])
    per_session = views.groupBy("session_id").agg(done.alias("completed_views"))
    wanted = F.array(*[F.lit(v) for v in expected])
    return per_session.withColumn("missing_views", F.array_except(wanted, "completed_views"))


def session_report(sessions: DataFrame) -> DataFrame:
    return sessions.select(
        "session_id", "n_photos", "n_damages_total", F.col("total_usd_estimated").alias("usd"), "avg_latency_s"
    )


def tile_effectiveness(calls: DataFrame) -> DataFrame:
    return calls.groupBy("tile_idx").agg(
        F.count("*").alias("n_calls"), F.round(F.avg("latency_ms"), 6).alias("avg_latency_ms"),
        F.sum("completion_tokens").alias("completion_tokens"),
    )


def config_comparison(photos: DataFrame) -> DataFrame:
    """Tokens, cost and latency per capture setting."""
    return photos.groupBy(*SETTINGS).agg(
        F.count("*").alias("n_photos"), F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"), F.round(F.sum("usd"), 9).alias("usd"),
        F.round(F.avg("latency_ms") / 1000.0, 9).alias("avg_latency_s"), F.max("latency_ms").alias("max_latency_ms"),
    )


def case_summary(photos: DataFrame) -> DataFrame:
    """Scan sessions as cases; the newest one (highest session id) also stands in as a car row."""
    cases = photos.groupBy("session_id").agg(
        F.count("*").alias("n_photos"), F.sum("n_damages").alias("n_damages"), F.count_if("had_error").alias("n_errors"),
        F.max_by("model", "captured_at").alias("model"),
    )
    newest = cases.agg(F.max("session_id").alias("_newest"))
    return cases.crossJoin(F.broadcast(newest)).withColumn(  # one row
        "is_newest", F.col("session_id") == F.col("_newest")
    ).drop("_newest")


def latest_sessions(cases: DataFrame, n: int = 8) -> DataFrame:
    return cases.orderBy(F.col("session_id").desc()).limit(n)


def latest_photo_per_view(events: DataFrame) -> DataFrame:
    """Current photo per (session, view): a retake replaces, a removal drops. Needs captured_at, seq, removed."""
    rest = [c for c in events.columns if c not in ("session_id", "view_idx")]
    last = events.groupBy("session_id", "view_idx").agg(
        F.max_by(F.struct(*rest), F.struct("captured_at", "seq")).alias("_p")
    )
    return last.where(~F.col("_p.removed")).select("session_id", "view_idx", "_p.*").drop("removed")
