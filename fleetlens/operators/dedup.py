"""Near-duplicate images by perceptual hash, and the best image of every group."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import stats, vocab
from fleetlens.operators import quality
from fleetlens.session import cut_lineage

BITS = 256
WORD = 64
WORDS = ["w0", "w1", "w2", "w3"]


def with_words(df: DataFrame, hash_col: str = "phash") -> DataFrame:
    """The hash as four 64-bit integers, for bit counting."""
    return df.withColumns({
        w: F.conv(F.substring(hash_col, 1 + 16 * i, 16), 16, -10).cast("long") for i, w in enumerate(WORDS)
    })


def hamming(left: str = "", right: str = "b_") -> Column:
    total = None
    for w in WORDS:
        bits = F.bit_count(F.col(left + w).bitwiseXOR(F.col(right + w)))
        total = bits if total is None else total + bits
    return total


Range = tuple[int, int]


def _cuts(ranges: list[Range], parts: int) -> list[list[Range]]:
    """Cut the bits of ``ranges`` (first bit, end) into ``parts`` near-equal runs."""
    bits = [b for lo, hi in ranges for b in range(lo, hi)]
    runs = []
    for k in range(parts):
        run: list[Range] = []
        for bit in bits[len(bits) * k // parts: len(bits) * (k + 1) // parts]:
            if run and run[-1][1] == bit and bit % WORD:
                run[-1] = (run[-1][0], bit + 1)
            else:
                run.append((bit, bit + 1))
        runs.append(run)
    return runs


def _value(run: list[Range]) -> Column:
    """The bits of a run (at most 63, each range inside one word) as one integer."""
    total = F.lit(0).cast("long")
    for lo, hi in run:
        piece = F.shiftrightunsigned(F.col(WORDS[lo // WORD]), WORD - 1 - (hi - 1) % WORD)
        mask = F.lit((1 << (hi - lo)) - 1).cast("long")
        total = F.shiftleft(total, hi - lo).bitwiseOR(piece.bitwiseAND(mask))
    return total


def _pairs_in(rows: DataFrame, keys: list[str], t: int) -> DataFrame:
    """Pairs of one bucket within distance ``t``. Needs id and the words.

    Sort-merge, so that a bucket never has to fit in memory and the skew split applies. Both sides are
    the same relation and share one shuffle.
    """
    same = F.lit(True)
    for k in keys:
        same = same & (F.col("l." + k) == F.col("r." + k))
    close = (F.col("l.id") < F.col("r.id")) & (hamming("l.", "r.") <= t)
    return rows.alias("l").join(rows.alias("r").hint("merge"), same & close).select(
        F.col("l.id").alias("a"), F.col("r.id").alias("b"), hamming("l.", "r.").alias("distance")
    )


BLOCK_ROWS = 2000


def _in_blocks(rows: DataFrame, salts: int) -> DataFrame:
    """Add ``n_blocks`` of the row's bucket and side, and ``block``. Rows: bucket, side, id, _salt; sizes travel by salt."""
    sizes = rows.groupBy("bucket", "side").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("n_blocks"))
    both = sizes.groupBy("bucket").agg(*[F.max(F.when(F.col("side") == k, F.col("n_blocks"))).alias(f"n{k}") for k in (0, 1)])
    spread = both.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    own = F.when(F.col("side") == 0, F.col("n0")).otherwise(F.col("n1"))
    return rows.join(spread, ["bucket", "_salt"]).withColumn("block", F.pmod(F.xxhash64(F.lit(1), "id"), own))


def _bridges(rows: DataFrame, t: int, salts: int) -> DataFrame:
    """An edge (a, b) for each row b of side 1 that is within ``t`` of a row of side 0 in its bucket.

    Each block of one side meets each block of the other in a group of its own.
    """
    placed = _in_blocks(rows, salts).where(F.col("n0").isNotNull() & F.col("n1").isNotNull())
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = placed.where("side = 0").select("bucket", "id", *WORDS, F.col("block").alias("i"), every("n1").alias("j"))
    right = placed.where("side = 1").select(
        "bucket", F.col("id").alias("r_id"), *[F.col(w).alias("r_" + w) for w in WORDS], every("n0").alias("i"), F.col("block").alias("j")
    )
    met = left.join(right.hint("merge"), ["bucket", "i", "j"]).where(hamming("", "r_") <= t)
    return met.groupBy("r_id").agg(F.min("id").alias("a")).select("a", F.col("r_id").alias("b"))


def _forest_of(t: int):
    """Rows of two blocks (or one) -> the edges of a forest that connects all rows within ``t``."""
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        words = np.stack([table.column(w).to_numpy() for w in WORDS], axis=1).view(np.uint64)
        new, edges = np.ones(len(ids), bool), []
        for root in range(len(ids)):
            if not new[root]:
                continue
            new[root], todo = False, [root]
            while todo:
                at = todo.pop()
                near = np.flatnonzero(new)
                near = near[np.bitwise_count(words[near] ^ words[at]).sum(axis=1, dtype=np.int64) <= t]
                new[near] = False
                edges += [(ids[at], ids[k]) for k in near]
                todo += near.tolist()
        return pa.table([pa.array([int(e[i]) for e in edges], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def _forests(rows: DataFrame, t: int, salts: int) -> DataFrame:
    """Edges that connect everything within ``t`` in each bucket, by pairs of blocks: each row travels once per block."""
    placed = _in_blocks(rows.withColumn("side", F.lit(0)), salts)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n0") - 1))
    met = placed.select("bucket", "id", *WORDS, "block", every.alias("other"))
    met = met.select("bucket", "id", *WORDS, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return met.groupBy("bucket", "i", "j").applyInArrow(_forest_of(t), "a long, b long")


def _star_rounds(rows: DataFrame, t: int, rounds: int = 8, salts: int = 64) -> DataFrame:
    """Edges that connect everything within ``t`` in crowded buckets, without listing all pairs.

    Rows: bucket, id, words. Each round takes one leader per bucket. Rows within ``t`` of it are tied to
    the leader and leave; they are compared with the ring ``t`` to ``2t``, one edge per ring row. What is left after the
    rounds is compared pairwise. Both comparisons go by pairs of blocks of at most about ``BLOCK_ROWS`` rows.
    """
    edges = None

    def add(more: DataFrame):
        nonlocal edges
        edges = more if edges is None else edges.unionByName(more)

    salt = F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")
    rest = cut_lineage(rows.select("bucket", "id", *WORDS).withColumn("_salt", salt))
    for _ in range(rounds):
        if rest.isEmpty():
            return edges
        leaders = (
            rest.groupBy("bucket").agg(F.min(F.struct("id", *WORDS)).alias("l"))
            .select("bucket", *[F.col("l." + c).alias("b_" + c) for c in ["id", *WORDS]])
            .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        )
        near = cut_lineage(rest.join(leaders, ["bucket", "_salt"]).withColumn("d", hamming()))
        inner = near.where(F.col("d") <= t)
        add(inner.where(F.col("id") != F.col("b_id")).select(F.col("b_id").alias("a"), F.col("id").alias("b")))
        add(_bridges(near.where(F.col("d") <= 2 * t).withColumn("side", (F.col("d") > t).cast("int")), t, salts))
        rest = near.where(F.col("d") > t).select("bucket", "id", *WORDS, "_salt")
    add(_forests(rest, t, salts))  # exact, whatever is left
    return edges


def close_pairs(
    reps: DataFrame, t: int = vocab.HASH_DISTANCE, bucket_cap: int = 2000, complete: bool = True
) -> DataFrame:
    """Pairs (a < b) of distinct hashes that differ in at most ``t`` bits. ``reps``: id and the hash words.

    Two such hashes agree in at least one of ``t + 1`` bands, so only rows sharing a band value meet. A bucket
    of more than ``bucket_cap`` rows is split by ``t + 1`` bands of its bits not used yet, again and again, as long as
    that at least halves the comparisons. Where it does not, the bucket's hashes are alike in nearly all bits: with
    ``complete`` they are compared pairwise, for they are the result; without, they give connecting edges, which
    is enough for grouping. With ``complete`` every pair comes once; without, a pair may repeat.
    """
    parts = t + 1
    bands = _cuts([(0, BITS)], parts)
    rest = {str(k): [r for n, run in enumerate(bands) if n != k for r in run] for k in range(parts)}
    keys = ["branch", "value"]
    rows = cut_lineage(reps.select("id", *WORDS, F.posexplode(F.array(*[_value(run) for run in bands])).alias("i", "value")).select(
        "id", *WORDS, F.col("i").cast("string").alias("branch"), "value"
    ))
    found = []
    while True:
        crowded = cut_lineage(rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > bucket_cap))
        found.append(_pairs_in(rows.join(crowded, keys, "left_anti"), keys, t))
        branches = [r[0] for r in crowded.select("branch").distinct().collect()]  # names of bit ranges, not data
        if not branches:
            break
        full = rows.join(crowded, keys)
        nested, values = {}, []
        for name in branches:
            cuts = _cuts(rest[name], parts) if sum(hi - lo for lo, hi in rest[name]) >= parts else []
            for k, run in enumerate(cuts):
                nested[f"{name}.{k}"] = [r for n, other in enumerate(cuts) if n != k for r in other]
            values.append(F.when(F.col("branch") == name, F.array(*[
                F.struct(F.lit(f"{name}.{k}").alias("branch"), F.xxhash64("value", _value(run)).alias("value")) for k, run in enumerate(cuts)
            ]) if cuts else F.array().cast("array<struct<branch:string,value:long>>")))
        rest = nested
        split = cut_lineage(full.select("id", *WORDS, *keys, "n", F.explode(F.coalesce(*values)).alias("k")))
        helped = cut_lineage(
            split.groupBy(*keys, "n", "k").agg(F.count("*").alias("c")).groupBy(*keys, "n").agg(F.sum(F.col("c") * F.col("c")).alias("s"))
            .where("2 * s <= n * n").select(*keys)
        )
        alike = full.join(helped, keys, "left_anti")
        if complete:
            found.append(_pairs_in(alike, keys, t))
        elif (edges := _star_rounds(alike.withColumn("bucket", F.struct(*keys)), t)) is not None:
            found.append(edges)
        rows = cut_lineage(split.join(helped, keys, "left_semi").select("id", *WORDS, "k.branch", "k.value"))
    if complete:
        return reduce(DataFrame.unionByName, found).distinct()
    return reduce(DataFrame.unionByName, [f.select("a", "b") for f in found])


def representatives(images: DataFrame) -> DataFrame:
    """One row per distinct hash, with its words, its smallest image id and the number of copies.

    Written once: the crowding check, both sides of the pair join and the labelling read it again.
    """
    reps = images.groupBy("phash").agg(F.min("image_id").alias("id"), F.count("*").alias("copies"))
    return cut_lineage(with_words(reps))


def window_pairs(images: DataFrame, t: int = vocab.HASH_DISTANCE, window: int = 50) -> DataFrame:
    """The source system's approximation: each hash meets the next ``window`` ones in sorted order only."""
    placed = stats.with_global_position(
        images.select(F.col("image_id").alias("id"), "phash"), [F.col("phash"), F.col("id")], "pos"
    )
    rows = with_words(placed).withColumn("block", F.floor(F.col("pos") / window)).drop("phash")
    right = rows.select("block", *[F.col(c).alias("b_" + c) for c in ["id", "pos", *WORDS]])
    left = rows.withColumn("block", F.explode(F.array("block", F.col("block") + 1)))
    gap = F.col("b_pos") - F.col("pos")
    return left.join(right, "block").where((gap >= 1) & (gap <= window) & (hamming() <= t)).select(
        F.least("id", "b_id").alias("a"), F.greatest("id", "b_id").alias("b"), hamming().alias("distance")
    )


def near_duplicate_pairs(images: DataFrame, t: int = vocab.HASH_DISTANCE) -> DataFrame:
    """Pairs within ``t`` bits: every pair of distinct hashes, by their smallest image, and one pair
    (smallest image, copy) per exact copy."""
    reps = representatives(images)
    copies = (
        images.select("image_id", "phash").join(reps.hint("merge"), "phash").where(F.col("image_id") != F.col("id"))
        .select(F.col("id").alias("a"), F.col("image_id").alias("b"), F.lit(0).alias("distance"))
    )
    return close_pairs(reps, t).unionByName(copies)


HUB_EDGES = 100_000


def with_least(edges: DataFrame, at_most: int, hub_edges: int = HUB_EDGES) -> DataFrame:
    """Edges (u, v), ``at_most`` of them, with ``m``, the least v of their u.

    The edges of a hub, a u with more than ``hub_edges`` of them, are dealt in parts of about that many, each of which gets the
    hub's minimum. At most 65,536 nodes count as hubs, so their list can be sent to all tasks.
    """
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))  # combined before the shuffle
    if at_most <= hub_edges:  # no node can have more
        return edges.join(low.select("u", "m"), "u")
    limit = max(hub_edges, at_most >> 16)
    hubs = F.broadcast(low.where(F.col("n") > limit).select("u", F.ceil(F.col("n") / limit).alias("parts")))
    part = F.coalesce(F.pmod(F.xxhash64("v"), F.col("parts")), F.lit(0).cast("long"))
    every = F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1).cast("long")) - 1)
    dealt = edges.join(hubs, "u", "left").select("u", "v", part.alias("part"))
    return dealt.join(low.join(hubs, "u", "left").select("u", "m", F.explode(every).alias("part")).hint("merge"), ["u", "part"])


def connected_components(edges: DataFrame, hub_edges: int = HUB_EDGES) -> DataFrame:
    """(node, component) for every node with an edge; the component is its smallest node.

    Alternates the large-star and small-star steps until no edge changes. Each round is written to the
    checkpoint folder, so lost executors do not replay the earlier ones. Hubs: see :func:`with_least`.
    """
    def tidy(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(
            F.col("u") != F.col("v")
        ).distinct()

    def mark(df: DataFrame):
        return df.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()

    current = cut_lineage(tidy(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    seen = mark(current)
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = with_least(both, 2 * seen.n, hub_edges).where(F.col("v") > F.col("u"))
        large = tidy(up.select(F.col("v").alias("u"), F.least("m", "u").alias("v")))
        large = cut_lineage(large) if 2 * seen.n > hub_edges else large
        down = with_least(large, 2 * seen.n, hub_edges)
        small = down.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")).distinct())
        current = cut_lineage(tidy(small))
        now = mark(current)
        if now == seen:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen = now


def near_duplicates(
    images: DataFrame, t: int = vocab.HASH_DISTANCE, mode: str = "exact", bucket_cap: int = 2000
) -> DataFrame:
    """(image_id, cluster_id) for every image; the cluster id is the smallest image id in the group.

    ``exact`` finds every pair within ``t`` bits. ``window`` repeats the sorted-neighbour approximation,
    which finds a subset of those pairs.
    """
    if mode == "window":
        parts = connected_components(window_pairs(images, t))
        return images.select("image_id").join(
            parts.select(F.col("node").alias("image_id"), "component"), "image_id", "left"
        ).select("image_id", F.coalesce("component", "image_id").alias("cluster_id"))
    reps = representatives(images)
    parts = connected_components(close_pairs(reps, t, bucket_cap, complete=False))
    labelled = reps.join(parts.select(F.col("node").alias("id"), "component"), "id", "left").select(
        "phash", F.coalesce("component", "id").alias("cluster_id")
    )
    # merge: both sides grow with the data, and a hash with many copies is split by the skew rule
    return images.select("image_id", "phash").join(labelled.hint("merge"), "phash").select("image_id", "cluster_id")


def cluster_best(scored: DataFrame, clusters: DataFrame) -> DataFrame:
    """Add cluster_id and is_cluster_best: the highest score of the cluster over all its images, hard
    fails included; ties by image id."""
    rows = scored.join(clusters, "image_id")
    best = rows.groupBy("cluster_id").agg(
        F.min(F.struct((-F.col("quality_score")).alias("s"), "image_id")).alias("b")
    ).select(F.col("b.image_id").alias("image_id"), F.lit(True).alias("_best"))
    return rows.join(best, "image_id", "left").withColumn(
        "is_cluster_best", F.coalesce("_best", F.lit(False))
    ).drop("_best")


def curate(images: DataFrame, t: int = vocab.HASH_DISTANCE, mode: str = "exact") -> DataFrame:
    """Score, filter and de-duplicate; ``keep_final`` marks the images to use."""
    filtered = quality.filtered_images(images)
    marked = cluster_best(filtered, near_duplicates(images, t, mode))
    return marked.withColumn("keep_final", F.col("keep_pre_dedup") & F.col("is_cluster_best"))
