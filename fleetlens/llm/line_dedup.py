"""Line dedup: documents probe a sharded minimal perfect hash over all distinct lines.

Lines meet as 16-byte hashes only. Each shard of the hash space is one row of an index table: a minimal perfect hash
(levels of bit arrays; a key lives in the first level where no other key takes its bit) that maps the shard's
keys onto 0..n-1, with three compact arrays behind it: fingerprint, number of documents, first document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import SPACES, ascii_lower, by_value, stored

by_value(__name__)

SHARD_KEYS = 32768  # keys a shard is planned for
HOT_PARTS = 4096  # a line with more than this share of all probes is looked up apart
NO_ID = -(1 << 63)
INDEX = "shard long, sizes binary, bits binary, fingerprints binary, counts binary, firsts binary, hot array<struct<h1:long,h2:long,first:long>>"


def slots(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    x = h1 ^ ((h2 << np.uint64(32)) | (h2 >> np.uint64(32)))
    x = x + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


def perfect_hash(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, bits) of the levels for distinct keys (h1, h2)."""
    sizes, levels, left = [], [], np.arange(len(h1))
    while len(left):
        size = max(64, (len(left) * 3 // 2 + 7) // 8 * 8)
        at = slots(h1[left], h2[left], len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        levels.append(alone)
        left = left[~alone[at]]
    return np.array(sizes, dtype=np.int64), np.concatenate(levels) if levels else np.zeros(0, bool)


def places(h1: np.ndarray, h2: np.ndarray, sizes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The place of each key in the arrays; -1 for a key that no level holds."""
    out, open_ = np.full(len(h1), -1, dtype=np.int64), np.arange(len(h1))
    rank, start = np.cumsum(bits) - 1, 0
    for level, size in enumerate(sizes.tolist()):
        at = start + slots(h1[open_], h2[open_], level, size)
        hit = bits[at]
        out[open_[hit]] = rank[at[hit]]
        open_, start = open_[~hit], start + size
    return out


def columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for n in names]


def build_shard(hot_above: int):
    def build(table: pa.Table) -> pa.Table:
        h1, h2, count, first = columns(table, "h1", "h2", "n_docs", "first_id")
        sizes, bits = perfect_hash(h1, h2)
        place = places(h1, h2, sizes, bits)
        fingerprints, counts, firsts = np.zeros(len(h1), np.uint32), np.zeros(len(h1), np.uint32), np.zeros(len(h1), np.int64)
        fingerprints[place] = h2.astype(np.uint32)
        counts[place] = np.minimum(count, np.uint64(0xFFFFFFFF)).astype(np.uint32)
        firsts[place] = first.view(np.int64)
        hot = [
            {"h1": int(a), "h2": int(b), "first": int(f)}
            for a, b, f in zip(*(x[count > hot_above].view(np.int64) for x in (h1, h2, first)))
        ]
        return pa.table({
            "shard": pa.array([table.column("shard")[0].as_py()], pa.int64()), "sizes": [sizes.tobytes()],
            "bits": [np.packbits(bits).tobytes()], "fingerprints": [fingerprints.tobytes()], "counts": [counts.tobytes()],
            "firsts": [firsts.tobytes()],
            "hot": pa.array([hot], pa.list_(pa.struct([("h1", pa.int64()), ("h2", pa.int64()), ("first", pa.int64())]))),
        })

    return build


def probe_shard(probes: pa.Table, index: pa.Table) -> pa.Table:
    """The probes (id, h1, h2) whose line must go."""
    none = pa.table({"id": pa.array([], pa.int64()), "h1": pa.array([], pa.int64())})
    if not probes.num_rows or not index.num_rows:
        return none
    row = index.to_pylist()[0]
    sizes = np.frombuffer(row["sizes"], np.int64)
    bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=int(sizes.sum())).astype(bool)
    h1, h2 = columns(probes, "h1", "h2")
    place = places(h1, h2, sizes, bits)
    known = place >= 0
    known[known] = np.frombuffer(row["fingerprints"], np.uint32)[place[known]] == h2[known].astype(np.uint32)
    count, first = np.frombuffer(row["counts"], np.uint32), np.frombuffer(row["firsts"], np.int64)
    ids = probes.column("id").combine_chunks()
    own = ids.fill_null(NO_ID).to_numpy(zero_copy_only=False)
    at = np.where(known, place, 0)
    gone = known & (count[at] >= 2) & (first[at] != own) & (first[at] != NO_ID)
    return pa.table({"id": ids.filter(pa.array(gone)), "h1": pa.array(h1[gone].view(np.int64))})


def strip_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, text, gone (hashes of lines to drop) -> id, n_lines, n_dropped, text."""
    import xxhash

    spaces = b" \t\n\x0b\x0c\r"
    for batch in batches:
        n_lines, n_dropped, texts = [], [], []
        for text, gone in zip(batch.column(1), batch.column(2)):
            raw, total, dropped = text.as_py() or "", 0, 0
            total = raw.count("\n") + 1
            if gone.is_valid:
                drop = set(gone.as_py())
                kept = []
                for line in raw.encode().split(b"\n"):
                    h = xxhash.xxh64_intdigest(line.strip(spaces).lower(), 42)
                    if (h - (1 << 64) if h >> 63 else h) in drop:
                        dropped += 1
                    else:
                        kept.append(line)
                raw = b"\n".join(kept).decode()
            n_lines.append(total)
            n_dropped.append(dropped)
            texts.append(raw)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(texts, pa.string())],
            ["id", "n_lines", "n_dropped", "text"],
        )


def line_hashes(docs: DataFrame, id_col: str, text_col: str, min_points: int) -> DataFrame:
    """(id, h1, h2) per distinct key of a document; the two hashes are 128 bits together."""
    keys = F.transform(
        F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1), lambda line: ascii_lower(F.btrim(line, F.lit(SPACES)))
    )
    hashed = F.transform(
        F.filter(keys, lambda k: F.length(k) >= min_points),
        lambda k: F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2")),
    )
    return docs.select(F.col(id_col).cast("long").alias("id"), F.explode(F.array_distinct(hashed)).alias("k")).select("id", "k.*")


def line_index(lines: DataFrame, shard_keys: int = SHARD_KEYS, hot_parts: int = HOT_PARTS) -> tuple[DataFrame, int]:
    """The index table over ``lines`` (id, h1, h2), and the number of its shards, a power of two."""
    total = lines.count()
    n_shards = 1 << max(6, (total // shard_keys).bit_length())
    keys = lines.groupBy("h1", "h2").agg(
        F.count("*").alias("n_docs"), F.coalesce(F.min("id"), F.lit(NO_ID)).alias("first_id")
    ).withColumn("shard", F.pmod("h1", F.lit(n_shards)))
    return stored(keys.groupBy("shard").applyInArrow(build_shard(max(1, total // hot_parts)), INDEX), "line-index"), n_shards


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_points: int = 10) -> DataFrame:
    """One row per row of ``docs``: id, n_lines, n_dropped, text (without the lines that other documents keep).

    Text is split at \\n; null and empty text is one empty line. A line's key is the line stripped of
    ``[\\x20\\x09-\\x0D]`` and lower-cased in A-Z. A key of at least ``min_points`` code points that two or more documents
    hold loses all its lines except in the smallest integer id that holds it (rows that repeat an id are one
    document; a null id counts as the largest). All other lines stay, joined by \\n. Empty input gives empty output;
    other columns of ``docs`` are not read.

    Every key is in the index, and every key of every document probes it: hashes travel to their shard, lines
    and texts do not. A line that holds more than 1/``HOT_PARTS`` of all probes, of which there are fewer than
    ``HOT_PARTS``, would make one shard hot; its entry is sent to all tasks instead.
    """
    lines = stored(line_hashes(docs, id_col, text_col, min_points), "line-hashes")
    index, n_shards = line_index(lines)
    hot = index.select(F.explode("hot").alias("k")).select("k.*")
    looked_up = lines.join(F.broadcast(hot), ["h1", "h2"], "left")  # fewer than HOT_PARTS rows
    told = looked_up.where(F.col("first").isNotNull() & (F.col("first") != NO_ID) & ~F.col("first").eqNullSafe(F.col("id"))).select("id", "h1")
    probes = looked_up.where(F.col("first").isNull()).select("id", "h1", "h2", F.pmod("h1", F.lit(n_shards)).alias("shard"))
    gone = probes.groupBy("shard").cogroup(index.drop("hot").groupBy("shard")).applyInArrow(probe_shard, "id long, h1 long")
    per_doc = gone.unionByName(told).groupBy("id").agg(F.collect_set("h1").alias("gone")).withColumnRenamed("id", "gone_id")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.join(per_doc, F.col("id").eqNullSafe(F.col("gone_id")), "left").select("id", "text", "gone").mapInArrow(
        strip_lines, "id long, n_lines long, n_dropped long, text string"
    ).withColumnRenamed("id", id_col)
