"""Writers and export formats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions import scalars as S
from fleetlens.operators import damages as D
from fleetlens.operators import detections as DET
from fleetlens.operators import images as I
from fleetlens.operators import store

ROW = 100  # entries of a document that are handed to Spark's writer together


def write_manifest(metrics: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Parquet without the rows that hold an error."""
    rows = I.split_errors(metrics)[0].drop("error") if "error" in metrics.columns else metrics
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_json_documents(entries: DataFrame, path: str, outer: str = "[]", most: int | None = None, compression: str = "none") -> None:
    """JSON arrays (or, with ``{}``, objects), one per file: a partition's entries, or at most ``most`` of them at a time.

    ``entries``: one text column, an element or ``"key": value`` per row.
    """
    size = min(ROW, most or ROW)
    rows = most // size if most else 0  # of a document; as many entries in each, but for the last of a partition

    def joined(texts: pa.Array) -> pa.Array:
        ends = np.minimum(np.arange(0, len(texts) + size, size), len(texts)).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(ends, texts), "\n,")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Array]:
        rest = None
        for batch in batches:
            texts = batch.column(0)
            if texts.null_count:
                raise TypeError("an entry is null")
            texts = pa.concat_arrays([rest, texts]) if rest else texts
            whole = len(texts) // size * size
            if whole:
                yield joined(texts[:whole])
            rest = texts[whole:]
        if rest:
            yield joined(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for texts in blocks(batches):
            at = done + np.arange(len(texts))
            first, last = (at % rows == 0, at % rows == rows - 1) if rows else (at == 0, at < 0)
            before, behind = (pa.array(np.where(x, y, z), texts.type) for x, y, z in ((first, outer[0], ","), (last, outer[1], "")))
            yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(before, texts, behind, pa.scalar("", texts.type))], ["value"])
            done += len(texts)
        if done % rows if rows else done:
            yield pa.RecordBatch.from_arrays([pa.array([outer[1]])], ["value"])

    entries.mapInArrow(run, "value string").write.option("maxRecordsPerFile", rows).text(path, compression=compression)


def replace_partitions(table: DataFrame, path: str, partition_by: str) -> None:
    """Overwrite only the partitions present in ``table``."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition_by).parquet(path)


def append_checkpoint(results: DataFrame, path: str) -> None:
    """Add a finished batch; a restart skips what :func:`remaining_after` finds here."""
    results.write.mode("append").parquet(path)


def remaining_after(spark: SparkSession, work: DataFrame, path: str, keys: list[str]) -> DataFrame:
    return store.remaining(work, spark.read.parquet(path), keys)


def label_studio_result(responses: DataFrame) -> DataFrame:
    """Annotation-tool results per response with ``detections``."""
    return responses.withColumns({
        "result": DET.annotation_result(F.col("detections")), "score": DET.task_score(F.col("detections")),
        "n_damages": F.size("detections"),
    })


def label_studio_task(path: Column, folder: str = "exterior_photos") -> Column:
    """Local-files link of an image path, relative to ``folder``."""
    place = F.locate(folder + "/", path)
    relative = F.when(place > 0, F.substr(path, place + len(folder) + 1)).otherwise(path)
    return F.concat(F.lit(f"/data/local-files/?d={folder}/"), relative)


def store_tables(cars: DataFrame, images: DataFrame, register: DataFrame) -> dict[str, DataFrame]:
    """First load of the store: cars (classes as sorted text), images, damages per coordinate.

    ``cars``: selected cars with damage_classes; ``register``: the flat register.
    """
    wanted = cars.select("plate_safe", "plate_original")
    damages = D.damages_per_coordinate(register.where(F.col("damage_pos").isNotNull()))
    return {
        "cars": cars.select(
            "plate_safe", "plate_original", "car_score", "n_unique_views", "n_damages",
            F.array_join("damage_classes", ",").alias("damage_classes"),
        ),
        "images": images.join(wanted.select(F.col("plate_safe").alias("plate")), "plate", "left_semi").select(
            "image_id", F.col("plate").alias("plate_safe"), "view", "width", "height", "quality_score",
            F.col("is_hard_fail").cast("int").alias("is_hard_fail"),
        ),
        "db_damages": damages.join(wanted, "plate_original").select(
            "plate_safe", F.coalesce("damage_id", F.lit("")).alias("damage_id"), "type", "master_class", "part", "side",
            "severity", "projection", "segment",
        ),
    }


def build_tables(spark: SparkSession, tables: dict[str, DataFrame], root: str) -> list[str]:
    """Write the tables that are not complete yet (a failed write leaves no _SUCCESS); returns the names written."""
    written = []
    for name, table in tables.items():
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/_SUCCESS")
        fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(target):
            table.write.mode("overwrite").parquet(f"{root}/{name}")
            written.append(name)
    return written


def exterior_downloads(photos: DataFrame) -> DataFrame:
    """(url, destination) for the exterior photos of an export."""
    name = S.exterior_filename(F.col("task_id"), F.col("photo_type"), F.col("idx"))
    return photos.where(S.is_exterior(F.col("photo_type"))).select(
        "url", F.concat_ws("/", F.lit("exterior_photos"), S.slug(F.col("plate_original")), name).alias("destination")
    )


def damage_downloads(photos: DataFrame) -> DataFrame:
    """(url, destination, signed) for register photos with a link and an id, oldest signature first on sort."""
    name = S.damage_filename(F.col("photo_type"), F.col("photo_id"))
    usable = (F.coalesce("url", F.lit("")) != "") & (F.coalesce("photo_id", F.lit("")) != "")
    return photos.where(usable).select(
        "url",
        F.concat_ws("/", F.lit("damage_photos"), S.slug(F.col("plate_original")), F.coalesce("case_id", F.lit("unknown")), name).alias("destination"),
        S.signature_time(F.col("url")).alias("signed"),
    )


def oldest_signature_first(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy("signed", "url", "destination")


