"""Sharding by extendible hashing: only buckets above the byte limit split on another bit of the hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import stored

MAX_BYTES = 16 << 20
DEPTH = 48  # bits of the hash that the directory may use
STEP = 12  # bits looked at per pass over what is still too large


def hash_bits(id_col: str, text_col: str) -> Column:
    """The first DEPTH bits of a document's hash; rows with equal or null ids differ by their text."""
    key = F.concat_ws("\x1f", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, DEPTH // 4), 16, 10).cast("long")


def prefix(bits: Column, depth: int) -> Column:
    return F.shiftright(bits, DEPTH - depth)


def directory(sized: DataFrame, max_bytes: int) -> DataFrame:
    """(depth, prefix, shard_bytes, shard_rows): the leaves of the directory over ``sized`` (bits, bytes).

    Passes go STEP bits deeper each time, and only over the rows of buckets still too large: a pass counts bytes
    per prefix of the new depth, and the shallower levels are summed from those counts. A bucket at the
    full depth stays as it is, for all its rows have one hash.
    """
    open_rows, leaves, top = sized, None, 0
    while True:
        low = min(top + STEP, DEPTH)
        cells = stored(open_rows.groupBy(prefix(F.col("bits"), low).alias("cell")).agg(
            F.sum("bytes").alias("bytes"), F.count("*").alias("rows")
        ), "shard-cells")
        levels = range(top if top == 0 else top + 1, low + 1)
        # every cell votes for the bucket it falls into at each level
        sums = cells.select(F.explode(F.array(*[
            F.struct(F.lit(d).alias("depth"), F.shiftright("cell", low - d).alias("prefix"), "bytes", "rows") for d in levels
        ])).alias("s")).select("s.*").groupBy("depth", "prefix").agg(
            F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows")
        )
        # a bucket is a leaf if it fits and its parent does not; sums only shrink with depth
        parent = sums.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"), F.col("shard_bytes").alias("above"))
        fits = F.col("shard_bytes") <= max_bytes
        found = stored(sums.withColumn("up", F.shiftright("prefix", 1)).join(parent, ["depth", "up"], "left").where(
            (F.col("above").isNull() | (F.col("above") > max_bytes)) & (fits | (F.col("depth") == low))
        ).select("depth", "prefix", "shard_bytes", "shard_rows"), "shard-found")
        if low == DEPTH:
            done, more = found, None
        else:
            done, more = found.where(fits), found.where(~fits)
        leaves = done if leaves is None else leaves.unionByName(done)
        if more is None or more.isEmpty():
            return stored(leaves, "shard-directory")
        open_rows = stored(open_rows.join(
            more.select(F.col("prefix").alias("cell")), prefix(F.col("bits"), low) == F.col("cell"), "left_semi"
        ), "shard-open")
        top = low


def shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes (UTF-8; null text 0), shard (the hash prefix as bits, empty if one
    shard holds all), depth, shard_bytes, oversized.

    Every shard holds at most ``max_bytes``, except where rows that no bit of the hash can part (equal id and
    text, or one text above the limit) are larger together: those are marked oversized. Empty input gives
    empty output; other columns of ``docs`` are not read.
    """
    sized = stored(docs.select(
        F.col(id_col).alias("id"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("bytes"),
        hash_bits(id_col, text_col).alias("bits"),
    ), "shard-rows")
    leaves = directory(sized, max_bytes)
    depths = sorted(r[0] for r in leaves.select("depth").distinct().collect())  # at most DEPTH + 1 numbers
    # a row belongs to the one leaf whose prefix it carries: look it up at each depth in use
    probe = sized.withColumn("at", F.explode(F.array(*[
        F.struct(F.lit(d).alias("depth"), prefix(F.col("bits"), d).alias("prefix")) for d in depths
    ]))) if depths else sized.withColumn("at", F.struct(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix")))
    leaf = leaves.select(F.struct(F.col("depth"), F.col("prefix")).alias("at"), "shard_bytes")
    found = probe.select("id", "bytes", F.col("at.depth").alias("depth"), F.col("at.prefix").alias("prefix")).join(
        leaf.select("at.depth", "at.prefix", "shard_bytes"), ["depth", "prefix"]
    )
    name = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("lpad(conv(prefix, 10, 2), depth, '0')"))
    return found.select(
        F.col("id").alias(id_col), F.col("bytes").alias("n_bytes"), name.alias("shard"), "depth", "shard_bytes",
        (F.col("shard_bytes") > max_bytes).alias("oversized"),
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write ``docs`` as one folder per shard; ``placed`` comes from :func:`shards`, ids must be unique."""
    where = placed.select(F.col(id_col).alias("_shard_id"), "shard")
    rows = docs.drop("shard").join(where, F.col(id_col).eqNullSafe(F.col("_shard_id"))).drop("_shard_id")
    rows.repartition("shard").write.partitionBy("shard").parquet(path)
