"""Tables that change together: several keyed tables, replaced in one step.

Data is written below ``data/<run>`` in buckets of the key and is never changed. One small file per version below ``versions``
names the folder of each bucket of each table; it is created only when all data is written, and only by one writer.
Readers take the newest complete file, so they see all tables of a version or none of them, and a change
rewrites the buckets of its keys alone.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

N_BUCKETS = 64


class VersionConflict(RuntimeError):
    """Another writer has published the version that this one was about to."""


@dataclass
class Version:
    """``tables``: name -> schema (JSON), key, defaults (SQL by column), buckets (number -> folder). ``batches``: stream -> last batch."""

    number: int = 0
    tables: dict = field(default_factory=dict)
    batches: dict = field(default_factory=dict)


class VersionedTables:
    def __init__(self, spark: SparkSession, root: str, n_buckets: int = N_BUCKETS):
        self.spark, self.root, self.n_buckets = spark, root.rstrip("/"), n_buckets
        self._paths = spark._jvm.org.apache.hadoop.fs

    def _fs(self, path: str):
        at = self._paths.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _names(self, path: str) -> list[str]:
        fs, at = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def current(self) -> Version:
        """The newest version whose file is whole; one that broke off while it was written does not count."""
        for name in sorted((n for n in self._names(f"{self.root}/versions") if n.isdigit()), reverse=True):
            text = "".join(r.value for r in self.spark.read.text(f"{self.root}/versions/{name}").collect())  # one short line
            try:
                return Version(int(name), **json.loads(text))
            except ValueError:
                continue
        return Version()

    def bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(self.n_buckets)).cast("int")

    def read(self, name: str, version: Version | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A table of a version (the newest one if not given), or only some of its buckets."""
        about = (version or self.current()).tables[name]
        schema = T.StructType.fromJson(about["schema"])
        folders = [f for b, f in about["buckets"].items() if buckets is None or int(b) in buckets]
        if not folders:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*folders)
        return rows.withColumns({c: F.coalesce(F.col(c), F.expr(sql)) for c, sql in about["defaults"].items()})

    def _written(self, rows: DataFrame, key: str, folder: str) -> dict[str, str]:
        """Write ``rows`` by bucket; the folders of the buckets that have rows."""
        # one shuffle, so that a bucket is not scattered over a file per task; AQE splits what is too large
        rows.withColumn("_bucket", self.bucket(key)).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(folder)
        return {n.split("=")[1]: f"{folder}/{n}" for n in self._names(folder) if n.startswith("_bucket=")}

    def _publish(self, version: Version) -> Version:
        fs, at = self._fs(f"{self.root}/versions/{version.number:012d}")
        if fs.exists(at):
            raise VersionConflict(str(version.number))
        try:
            out = fs.create(at, False)
        except Exception as problem:
            raise VersionConflict(str(version.number)) from problem
        out.write(bytearray(json.dumps({"tables": version.tables, "batches": version.batches}).encode()))
        out.close()
        return version

    def _number(self) -> int:
        """A file that broke off keeps its number."""
        return max([0, *(int(n) for n in self._names(f"{self.root}/versions") if n.isdigit())]) + 1

    def create(self, tables: dict[str, tuple[DataFrame, str]]) -> Version:
        """First load: name -> (rows, key column). All tables come into being together."""
        number, data, made = self._number(), f"{self.root}/data/{uuid.uuid4().hex}", {}
        for name, (rows, key) in tables.items():
            made[name] = {"schema": rows.schema.jsonValue(), "key": key, "defaults": {}, "buckets": self._written(rows, key, f"{data}/{name}")}
        return self._publish(Version(number, made, {}))

    def change(self, changes: dict[str, tuple[DataFrame, DataFrame]], merge, defaults: dict | None = None, batch: tuple[str, int] | None = None) -> Version:
        """Publish a version in which, for each name -> (keys, rows), the buckets of ``keys`` hold ``merge(old rows, keys, rows)``.

        ``keys`` has the table's key column: all keys that the change touches, those of ``rows`` too. ``defaults`` gives a
        table's new columns a value in older rows (name -> {column: SQL}). ``batch`` (stream, number) is noted in the
        version; a batch that is noted already, or an older one, changes nothing.
        """
        before, number = self.current(), self._number()
        if batch and before.batches.get(batch[0], -1) >= batch[1]:
            return before
        data, tables = f"{self.root}/data/{uuid.uuid4().hex}", dict(before.tables)
        for name, (keys, rows) in changes.items():
            about = tables[name]
            touched = [r[0] for r in keys.select(self.bucket(about["key"])).distinct().collect()]  # at most N_BUCKETS
            merged = merge(self.read(name, before, touched), keys, rows)
            old = T.StructType.fromJson(about["schema"])  # buckets that stay were written with these types
            merged = merged.select(*(F.col(c).cast(old[c].dataType) if c in old.names else F.col(c) for c in merged.columns))
            folders = self._written(merged, about["key"], f"{data}/{name}")
            kept = {b: f for b, f in about["buckets"].items() if int(b) not in touched}
            tables[name] = about | {
                "schema": merged.schema.jsonValue(), "defaults": about["defaults"] | (defaults or {}).get(name, {}), "buckets": kept | folders
            }
        return self._publish(Version(number, tables, before.batches | (dict([batch]) if batch else {})))


def replace_cars(tables: VersionedTables, cars: DataFrame, images: DataFrame, key: str = "plate_safe") -> Version:
    """Replace whole cars: rows of their keys leave the cars, images and damages in one step, the new cars and images come in.

    New cars have no damages yet. Older cars are no test cars where the table did not say so.
    """
    keys = cars.select(key).distinct()
    none = tables.spark.createDataFrame([], tables.read("db_damages").schema)
    return tables.change(
        {"cars": (keys, cars), "images": (keys, images), "db_damages": (keys, none)},
        lambda old, gone, new: old.join(gone, key, "left_anti").unionByName(new, allowMissingColumns=True), {"cars": {"is_test": "0"}},
    )
