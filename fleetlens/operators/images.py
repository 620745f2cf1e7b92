"""Per-pixel metrics and perceptual hashes of decoded images, and file checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import scalars as S

METRICS = (
    "path string, file_size bigint, width int, height int, aspect_ratio double, sharpness double, brightness double, "
    "contrast double, saturation double, overexp_pct double, underexp_pct double, phash string, error string"
)
HASH_SIDE = 16
DCT_SIDE = 64


# Blue, green and red weights of the 8-bit gray conversion, in units of 2^-15.
GRAY_WEIGHTS = (3735, 19235, 9798)


def _gray(bgr: np.ndarray) -> np.ndarray:
    """Rounded 0.114 B + 0.587 G + 0.299 R, in whole numbers so that ties do not depend on float order."""
    weighted = bgr.astype(np.int64) @ np.array(GRAY_WEIGHTS)
    return ((weighted + (1 << 14)) >> 15).astype(float)


def _laplacian_variance(gray: np.ndarray) -> float:
    # a mirrored border needs two pixels; a one-pixel side has no neighbour to mirror
    pad = [(1, 1) if n > 1 else (0, 0) for n in gray.shape]
    p = np.pad(gray, pad, mode="reflect")
    p = np.pad(p, [(0, 0) if n > 1 else (1, 1) for n in gray.shape], mode="edge")
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * gray
    return float(lap.var())


def _saturation(bgr: np.ndarray) -> np.ndarray:
    top, low = bgr.max(axis=-1), bgr.min(axis=-1)
    return np.rint(np.divide(255.0 * (top - low), top, out=np.zeros_like(top), where=top > 0))


def _overlaps(n: int, out: int) -> np.ndarray:
    """Row-stochastic area weights that resize n samples to ``out``."""
    edges = np.linspace(0, n, out + 1)
    low = np.maximum(edges[:-1, None], np.arange(n)[None, :])
    high = np.minimum(edges[1:, None], np.arange(1, n + 1)[None, :])
    w = np.maximum(high - low, 0)
    return w / w.sum(axis=1, keepdims=True)


def _cosines(n: int) -> np.ndarray:
    k, i = np.arange(n)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * k * (2 * i + 1) / (2 * n))


def _phash(gray: np.ndarray) -> str:
    h, w = gray.shape
    small = _overlaps(h, DCT_SIDE) @ gray @ _overlaps(w, DCT_SIDE).T
    c = _cosines(DCT_SIDE)
    # rounded, so that coefficients that are equal in exact numbers stay equal whatever the order of the sums
    low = np.round((c @ small @ c.T)[:HASH_SIDE, :HASH_SIDE], 6)
    return np.packbits(low > np.median(low)).tobytes().hex()


def _one(row) -> dict:
    out = {"path": row.path, "file_size": row.file_size, "error": None}
    try:
        if row.width <= 0 or row.height <= 0:
            return {**out, "error": "image_read_failed"}
        pixels = np.frombuffer(row.data, dtype=np.uint8).reshape(row.height, row.width, row.channels)
        if row.channels == 1:  # the weights add up to one, and gray has no saturation
            gray, saturation = pixels[..., 0].astype(float), 0.0
        else:
            bgr = pixels[..., :3].astype(float)
            gray, saturation = _gray(bgr), float(_saturation(bgr).mean())
        return {
            **out, "width": row.width, "height": row.height, "aspect_ratio": round(row.width / row.height, 3),
            "sharpness": round(_laplacian_variance(gray), 1), "brightness": round(float(gray.mean()), 1),
            "contrast": round(float(gray.std()), 1), "saturation": round(saturation, 1),
            "overexp_pct": round(float((gray > 240).mean()) * 100, 2),
            "underexp_pct": round(float((gray < 15).mean()) * 100, 2), "phash": _phash(gray),
        }
    except Exception as problem:  # one bad image must not stop the job
        return {**out, "error": str(problem)[:200]}


def spread(df: DataFrame, key: Column, per_core: int = 2) -> DataFrame:
    """Rows dealt anew where there are fewer tasks than cores, so that a costly step per row does not wait for a few files."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    return df if df._jdf.rdd().getNumPartitions() >= cores else df.repartition(cores * per_core, key)


def image_metrics(images: DataFrame) -> DataFrame:
    """Quality metrics per image.

    ``images`` holds the ``image`` column of Spark's image source (decoded BGR bytes) and may hold
    ``file_size``. An unreadable image gives a row with ``error``; the others go on. A task holds the pictures of one Arrow
    batch (``spark.sql.execution.arrow.maxBytesPerBatch``, 64 MB unless set otherwise, or one picture) and, for
    the picture it works on, about 100 bytes per pixel.
    """
    size = F.col("file_size") if "file_size" in images.columns else F.lit(None).cast("bigint")
    whole = lambda c: F.coalesce(F.col("image." + c), F.lit(-1))  # noqa: E731 - with a null, pandas would make fractions of a batch's numbers
    flat = images.select(
        F.col("image.origin").alias("path"), size.alias("file_size"), whole("width").alias("width"), whole("height").alias("height"),
        whole("nChannels").alias("channels"), F.col("image.data").alias("data"),
    )
    columns = [part.strip().split()[0] for part in METRICS.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = pd.DataFrame([_one(r) for r in batch.itertuples(index=False)], columns=columns)
            text = dict.fromkeys(["path", "phash", "error"], object)
            yield rows.astype({"width": "Int32", "height": "Int32", "file_size": "Int64", **text})

    return spread(flat, F.xxhash64("path")).mapInPandas(run, METRICS)


def with_names(metrics: DataFrame) -> DataFrame:
    """Add plate (parent folder), filename and view from the path."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return metrics.withColumns({
        "plate": F.regexp_extract("path", r"([^/]+)/[^/]+$", 1), "filename": name, "view": S.view_of(name),
    })


def split_errors(metrics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable rows, rows with an error)."""
    return metrics.where(F.col("error").isNull()), metrics.where(F.col("error").isNotNull())


def decode_errors(images: DataFrame) -> DataFrame:
    """(path, error) per image: ``error`` is null where the metrics could be computed, without computing them."""
    i = F.col("image")
    side = F.greatest(i["width"], F.lit(0)).cast("long") * F.greatest(i["height"], F.lit(0))
    whole = (side > 0) & (F.octet_length(i["data"]) == side * i["nChannels"]) & ((i["nChannels"] == 1) | (i["nChannels"] >= 3))
    error = F.when(F.coalesce(side, F.lit(0)) <= 0, "image_read_failed").when(~F.coalesce(whole, F.lit(False)), "pixels_do_not_fit")
    return images.select(i["origin"].alias("path"), error.alias("error"))


def error_counts(metrics: DataFrame) -> DataFrame:
    return metrics.agg(
        F.count("*").alias("n_images"), F.count_if(F.col("error").isNull()).alias("n_ok"),
        F.count_if(F.col("error").isNotNull()).alias("n_errors"),
    )


def dimensions(images: DataFrame) -> DataFrame:
    """Width and height per path, 0 x 0 for an unreadable file."""
    side = lambda c: F.greatest(F.coalesce(F.col("image." + c), F.lit(0)), F.lit(0)).alias(c)
    return images.select(F.col("image.origin").alias("path"), side("width"), side("height"))


def content_format(files: DataFrame) -> DataFrame:
    """The format the leading bytes of ``content`` tell, next to the one the file name claims."""
    head = F.hex(F.substring("content", 1, 12))
    found = (
        F.when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("89504E470D0A1A0A"), "png")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp")
        .when(head.startswith("424D"), "bmp").when(head.startswith("47494638"), "gif").otherwise("unknown")
    )
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    claimed = F.when(suffix.isin("jpg", "jpeg"), "jpeg").otherwise(suffix)
    return files.select(
        "path", found.alias("found"), claimed.alias("claimed"), (found != claimed).alias("mismatch")
    )
