"""Exact duplicates by two-pass Bloom filtering, on DataFrame functions only.

Pass 1 counts how often each cell of a blocked Bloom filter is hit (two cells of one 64-bit word per row)
and keeps, per word, the bits hit at least twice. Pass 2 probes every row: only where both bits were hit
again may the hash be repeated. Only those rows are shuffled by their digest; the rest pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import SPACES, stored


def again_filter(hashed: DataFrame, n_words: int) -> DataFrame:
    """(word, bits): the cells of the filter that at least two rows hit. ``hashed`` holds the column h."""
    cells = hashed.select(
        F.pmod(F.shiftrightunsigned("h", 12), F.lit(n_words)).alias("word"),
        F.explode(F.expr("array_distinct(array(cast(h & 63 as int), cast(shiftrightunsigned(h, 6) & 63 as int)))")).alias("bit"),
    )
    hit = cells.groupBy("word", "bit").agg(F.count("*").alias("n")).where("n > 1")
    return hit.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after all characters of ``[\\x20\\x09-\\x0D]`` are deleted; a null
    text counts as empty. Of equal texts the one with the most code points stays, then the smallest id (null
    ids last); of rows equal in all of this exactly one stays. Empty input gives empty output. Other columns of
    ``docs`` are not read, so their names cannot clash. The filter grows with the rows (``bits_per_row``) and
    is never sent to the driver; whether Spark broadcasts it is left to its size threshold.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    squeezed = F.translate(text, SPACES, "")
    rows = stored(docs.select(
        F.col(id_col).alias("id"), F.length(text).alias("n_points"), F.sha2(squeezed, 256).alias("sha"),
        F.xxhash64(squeezed).alias("h"), F.monotonically_increasing_id().alias("row"),
    ), "exact-rows")
    n_words = max(1, rows.count() * bits_per_row // 64)
    twice = stored(again_filter(rows, n_words), "exact-filter")

    one, two = F.expr("shiftleft(1L, cast(h & 63 as int))"), F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 6) & 63 as int))")
    mask = one.bitwiseOR(two)
    probed = stored(
        rows.withColumn("word", F.pmod(F.shiftrightunsigned("h", 12), F.lit(n_words))).join(twice, "word", "left")
        .select("id", "n_points", "sha", "row", F.coalesce(F.col("bits").bitwiseAND(mask) == mask, F.lit(False)).alias("again")),
        "exact-probed",
    )
    suspects = probed.where("again")
    groups = stored(suspects.groupBy("sha").agg(
        F.count("*").alias("group_size"),
        F.min(F.struct((-F.col("n_points")).alias("p"), F.col("id").isNull().alias("z"), "id", "row")).alias("best"),
    ), "exact-groups")
    shuffled = suspects.join(groups, "sha").select(
        "id", F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "sha"
    )
    passed = probed.where("NOT again").select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha"
    )
    return passed.unionByName(shuffled).withColumnsRenamed({"id": id_col, "sha": "text_sha256"})
