"""Helpers shared by the corpus operators."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.session import scratch_path

#: Fixed value: the white space of all contracts, i.e. the characters of [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def by_value(module: str) -> None:
    """Ship a module's functions inside the job, so that executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


by_value(__name__)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back: later steps neither recompute it nor
    depend on the executors that made it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+``; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; 0 for null. Counts word ends, so no array is built."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D]|\z)")), F.lit(0)).cast("long")
