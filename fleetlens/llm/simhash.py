"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints within ``tau`` bits agree within t_i bits on at least one of m partitions when the t_i sum to
tau - m + 1 (t_i = -1 leaves partition i out). Correlated bits are put into the same partition, and the t_i are chosen by
dynamic programming over the candidate pairs each partition would give at each threshold, counted on all fingerprints.
Rows meet in buckets (partition, value within t_i); a bucket is compared inside one task and gives a spanning
forest of its links, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import ascii_lower, by_value, stored, words
from fleetlens.llm.suffix_dedup import BASE, mixed
from fleetlens.operators.dedup import connected_components

by_value(__name__)

BUCKET_ROWS = 16384  # rows compared in one task; a larger bucket is split by further bits until it is smaller
PARTS = 4
BAND, MISS = 3, 1e-12  # minima a key is made of; bound on each of the two ways to miss a pair of just the similarity
SKETCH_ROWS = 4096  # rows of one key compared in one task


# --- fingerprints ---

def shingle_hashes(w: Column, k: int, distinct: bool = False) -> Column:
    """XXH64 (seed 42) of the k-word shingles of the words ``w``; fewer words: the whole sequence. ``w`` must be a plain
    column: an expression would be evaluated anew for every shingle."""
    n = F.size(w)
    whole = F.when(n == 0, F.array().cast("array<long>")).otherwise(F.array(F.xxhash64(F.concat_ws(" ", w))))
    hashes = F.transform(w, lambda x: F.xxhash64(x)) if k == 1 else F.transform(
        F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(w, i + j) for j in range(k)]))
    )
    return F.when(n < k, whole).otherwise(F.array_distinct(hashes) if distinct else hashes)


def majority(lists: pa.ListArray) -> pa.Array:
    """Fingerprint per list of hashes: a bit is 1 if more than half of the hashes have it."""
    values = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False)).astype(np.int64).view(np.uint8)
    ends = np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))]).astype(np.int64)
    out = np.zeros(len(lists), dtype=np.uint64)
    for i in range(len(lists)):
        a, b = ends[i], ends[i + 1]
        if b > a:
            counts = np.zeros(64, dtype=np.int64)
            for c in range(a, b, 65536):  # bounded memory for very long texts
                d = min(b, c + 65536)
                counts += np.unpackbits(values[c * 8:d * 8].reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[i] = np.packbits(2 * counts > b - a, bitorder="little").view(np.uint64)[0]
    return pa.array(out.view(np.int64))


def bit_majority(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, hashes -> id, fp."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), majority(batch.column(1))], ["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, k: int, distinct: bool = False) -> DataFrame:
    """(id, fp) per row; a text without words, or null, has fingerprint 0."""
    split = docs.select(F.col(id_col).alias("id"), words(ascii_lower(F.col(text_col))).alias("w"))
    return split.select("id", shingle_hashes(F.col("w"), k, distinct).alias("hashes")).mapInArrow(
        bit_majority, f"id {docs.schema[id_col].dataType.simpleString()}, fp long"
    )


# --- partitions and thresholds ---

def bit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """fp -> one row (i, ones): per bit i, how often each bit is 1 together with it."""
    total = np.zeros((64, 64), dtype=np.int64)
    for batch in batches:
        fps = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).view(np.uint8).reshape(-1, 8)
        for c in range(0, len(fps), 1 << 16):
            bits = np.unpackbits(fps[c:c + (1 << 16)], axis=1, bitorder="little").astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(np.arange(64), 64)), pa.array(np.tile(np.arange(64), 64)), pa.array(total.ravel())], ["i", "j", "n"]
    )


def correlated_partitions(together: np.ndarray, n: int, parts: int = PARTS) -> list[list[int]]:
    """64 bits in ``parts`` groups of equal width: each group grows by the bit most correlated with it."""
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    free, groups = list(range(64)), []
    for g in range(parts):
        width = len(free) // (parts - g)
        group = [free.pop(0)]
        while len(group) < width:
            best = max(free, key=lambda b: (corr[b, group].sum(), -b))
            free.remove(best)
            group.append(best)
        groups.append(sorted(group))
    return groups


def candidate_counts(histogram: np.ndarray, width: int, tau: int) -> list[float]:
    """Per threshold -1, 0, ... tau: how many pairs a partition with these value counts would bring together, plus
    the rows its keys would be sent as. Pairs per difference are the self-convolution over XOR (Walsh-Hadamard)."""
    x, half = histogram.astype(np.float64), 1
    for _ in range(2):
        half = 1
        while half < len(x):
            x = x.reshape(-1, 2, half)
            x = np.stack([x[:, 0] + x[:, 1], x[:, 0] - x[:, 1]], axis=1).ravel()
            half *= 2
        x = x * x if _ == 0 else x / len(x)
    by_distance = np.bincount(np.bitwise_count(np.arange(len(x))), weights=x, minlength=width + 1)
    n, out, keys = float(histogram.sum()), [0.0], 0.0
    for t in range(tau + 1):
        keys += n * comb(width, t) / 2 ** t
        out.append(float(by_distance[:t + 1].sum()) / 2 + keys)
    return out


def allocate(costs: list[list[float]], tau: int) -> list[int]:
    """Thresholds t_i >= -1 with sum tau - m + 1 and least total cost; costs[i][t + 1] is the cost of t on partition i."""
    best = {0: (0.0, [])}
    for row in costs:  # spent[i] = sum of t_i + 1 over the partitions so far
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for t in range(-1, tau + 1):
                if (s := spent + t + 1) <= tau + 1 and (cost + row[t + 1], chosen) < step.get(s, (np.inf, [])):
                    step[s] = (cost + row[t + 1], [*chosen, t])
        best = step
    return best[tau + 1][1]


def project(fp: Column, bits: list[int]) -> Column:
    out = F.lit(0)
    for place, b in enumerate(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, b).bitwiseAND(F.lit(1)), place).cast("int"))
    return out


def plan_partitions(points: DataFrame, tau: int, parts: int = PARTS) -> tuple[list[list[int]], list[int]]:
    """(partitions, thresholds) from all of ``points`` (fp). 64 x 64 sums and the counts of 16-bit values reach the
    driver: a fixed number, whatever the input."""
    together, n = np.zeros((64, 64), dtype=np.int64), points.count()
    sums = points.select("fp").mapInArrow(bit_counts, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))
    for i, j, c in sums.collect():
        together[i, j] = c
    groups = correlated_partitions(together, n, parts)
    values = points.select(F.explode(F.array(*[
        F.struct(F.lit(g).alias("g"), project(F.col("fp"), bits).alias("v")) for g, bits in enumerate(groups)
    ])).alias("x")).groupBy("x.g", "x.v").count()
    histograms = [np.zeros(1 << len(bits), dtype=np.int64) for bits in groups]
    table = values.toArrow()
    g, v, c = (table.column(i).to_numpy() for i in range(3))
    for i, h in enumerate(histograms):
        h[v[g == i]] = c[g == i]
    return groups, allocate([candidate_counts(h, len(bits), tau) for h, bits in zip(histograms, groups)], tau)


# --- buckets ---

def bucket_keys(groups: list[list[int]], thresholds: list[int]) -> Column:
    """Array of (branch, value): the buckets of a row with the projections v0, v1, ... With t_i >= 1 a row also enters the
    buckets of values it reaches by raising up to t_i zero bits; two values within t_i bits then share a bucket."""
    found = []
    for g, (bits, t) in enumerate(zip(groups, thresholds)):
        if t < 0:
            continue
        flips = [sum(1 << b for b in f) for r in range(t + 1) for f in combinations(range(len(bits)), r)]
        value = F.col(f"v{g}")
        masks = F.array(*[F.lit(m) for m in flips])
        found.append(F.transform(
            F.filter(masks, lambda m: value.bitwiseAND(m) == 0),
            lambda m: F.struct(F.lit(str(g)).alias("branch"), value.bitwiseOR(m).cast("long").alias("value")),
        ))
    return F.flatten(F.array(*found))


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest member of the component of each of n nodes under the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def compare_buckets(tau: int):
    """Rows sorted by bucket -> links (u, v) of fingerprints within tau bits, a spanning forest per bucket."""
    def links_of(fps: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        label, left, right, waiting = np.arange(len(fps)), [], [], 0
        at = np.arange(len(fps) - 1)
        offset = 1
        while len(at):  # row i against row i + offset, for all buckets at once
            at = at[at + offset < len(fps)]
            at = at[bucket[at] == bucket[at + offset]]
            close = np.bitwise_count(fps[at] ^ fps[at + offset]) <= tau
            left.append(at[close])
            right.append(at[close] + offset)
            waiting += int(close.sum())
            if waiting > 1 << 20:  # keep only what connects
                label = forest(np.concatenate([*left, np.arange(len(fps))]), np.concatenate([*right, label]), len(fps))
                left, right, waiting = [], [], 0
            offset += 1
        label = forest(np.concatenate([*left, np.arange(len(fps))]), np.concatenate([*right, label]), len(fps))
        joined = np.flatnonzero(label != np.arange(len(fps)))
        return fps[label[joined]], fps[joined]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(fps, bucket):
            u, v = links_of(fps, bucket)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        kept_key, kept_fp = None, None  # the last bucket of a batch may go on in the next
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            fps = np.ascontiguousarray(batch.column(1).to_numpy(zero_copy_only=False)).view(np.uint64)
            if kept_key is not None:
                key, fps = np.concatenate([kept_key, key]), np.concatenate([kept_fp, fps])
            if not len(key):
                continue
            others = np.flatnonzero(key != key[-1])
            last = others[-1] + 1 if len(others) else 0
            kept_key, kept_fp = key[last:], fps[last:]
            if last:
                yield emit(fps[:last], key[:last])
        if kept_key is not None and len(kept_key):
            yield emit(kept_fp, kept_key)

    return run


def compared(rows: DataFrame, key: str, tau: int) -> DataFrame:
    return rows.select(key, "fp").repartition(key).sortWithinPartitions(key).mapInArrow(compare_buckets(tau), "u long, v long")


def close_links(points: DataFrame, tau: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``points`` (fp) that connect exactly what all pairs within ``tau`` bits
    connect.

    Buckets of up to ``bucket_rows`` are compared in one task. In a larger one, the bits not used yet are cut into tau + 1
    pieces; by the pigeonhole principle two linked rows agree on one of these, so each row may go on in tau + 1
    smaller buckets. It does where that at least halves the comparisons. Else the bucket's rows are alike in all pieces:
    it is cut into blocks, and each pair of blocks is compared in one task. Either way no link is lost, and no task
    compares more than two blocks.
    """
    groups, thresholds = plan_partitions(points, tau)
    used = {str(g): frozenset(bits) for g, bits in enumerate(groups)}
    projected = points.select("fp", *[project(F.col("fp"), bits).alias(f"v{g}") for g, bits in enumerate(groups)])
    rows = projected.select("fp", F.explode(bucket_keys(groups, thresholds)).alias("k")).select("fp", "k.branch", "k.value")
    links = []
    while True:
        # equal keys of different buckets would only add comparisons
        rows = stored(rows.withColumn("key", F.xxhash64("branch", "value")), "simhash-buckets")
        crowded = stored(rows.groupBy("branch", "value").agg(F.count("*").alias("n")).where(F.col("n") > bucket_rows).select(
            F.col("branch").alias("b"), F.col("value").alias("w"), "n"
        ), "simhash-crowded")
        same = (F.col("branch") == F.col("b")) & (F.col("value") == F.col("w"))
        links.append(compared(rows.join(crowded, same, "left_anti"), "key", tau))
        branches = [r[0] for r in crowded.select("b").distinct().collect()]  # at most parts x (tau + 1) ^ depth names
        if not branches:
            break
        pieces, nested = [], {}
        for name in branches:
            rest = sorted(set(range(64)) - used[name])
            cuts = [rest[i::tau + 1] for i in range(tau + 1)] if len(rest) > tau else []
            for i, bits in enumerate(cuts):
                nested[f"{name}.{i}"] = used[name] | frozenset(bits)
            pieces.append(F.when(F.col("b") == name, F.array(*[
                F.struct(F.lit(f"{name}.{i}").alias("branch"), F.xxhash64("w", project(F.col("fp"), bits)).alias("value"))
                for i, bits in enumerate(cuts)
            ]) if cuts else F.array().cast("array<struct<branch:string,value:long>>")))
        used = nested
        full = rows.join(crowded, same).select("fp", "b", "w", "n")
        cut = stored(full.select("*", F.explode(F.coalesce(*pieces)).alias("k")).select("fp", "b", "w", "n", "k.branch", "k.value"), "simhash-cut")
        each = cut.groupBy("b", "w", "n", "branch", "value").agg(F.count("*").alias("c"))
        helped = stored(each.groupBy("b", "w", "n").agg(F.sum(F.col("c") * F.col("c")).alias("s")).where("2 * s <= n * n").select("b", "w"), "simhash-helped")
        blocks = F.ceil(F.col("n") / bucket_rows)
        own = F.pmod(F.xxhash64("fp"), blocks)
        alike = full.join(helped, ["b", "w"], "left_anti").withColumn("own", own).withColumn(
            "other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
        ).withColumn("key", F.xxhash64("b", "w", F.least("own", "other"), F.greatest("own", "other")))
        links.append(compared(alike, "key", tau))
        rows = cut.join(helped, ["b", "w"], "left_semi").select("fp", "branch", "value")
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (u, v); the component is its smallest node. Links of a hub are dealt in parts."""
    return connected_components(links.select(F.col("u").alias("a"), F.col("v").alias("b")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, tau: int = 3) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits), component_id (smallest id reachable over links
    of at most ``tau`` differing bits, itself included).

    The fingerprint is taken over the ``k``-word shingles of the whole text, repeats included. Equal
    fingerprints are one point, so copies never meet as pairs. Null and empty texts have fingerprint zero and
    are linked like any other. Null ids take no part in "smallest"; a component of null ids alone has a null
    component_id. Empty input gives empty output; other columns of ``docs`` are not read.
    """
    prints = stored(fingerprints(docs, id_col, text_col, k), "simhash-prints")
    points = stored(prints.groupBy("fp").agg(F.min("id").alias("first")), "simhash-points")
    parts = components(close_links(points, tau))
    labelled = points.join(parts, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component")
    )
    smallest = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = stored(labelled.join(smallest, "component").select(F.col("fp").alias("point"), "component_id"), "simhash-classes")
    return prints.join(classes, F.col("fp") == F.col("point")).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


# --- near duplicates by shingle similarity ---

def sketch_plan(similarity: float, miss: float = MISS) -> tuple[int, int]:
    """(bands, least): a pair of at least ``similarity`` agrees in no band of ``BAND`` minima, or in fewer than ``least`` of
    all minima, with a probability of at most ``miss`` each. Minima agree independently with the pair's Jaccard similarity."""
    bands = 1 if similarity >= 1 else max(1, ceil(log(miss) / log1p(-similarity ** BAND)))
    n, least, tail = bands * BAND, 0, 0.0
    while least < n and (tail := tail + comb(n, least) * similarity ** least * (1 - similarity) ** (n - least)) <= miss:
        least += 1
    return bands, least


def minima(values: np.ndarray, starts: np.ndarray, functions: int) -> np.ndarray:
    """(set, function): least value of each hash function over the sets that begin at ``starts``."""
    seeds = mixed(np.arange(1, functions + 1, dtype=np.uint64) * np.uint64(BASE))
    out = np.empty((len(starts), functions), dtype=np.uint64)
    ends, i = np.append(starts[1:], len(values)), 0
    while i < len(starts):  # slices that stay in the processor's cache
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + 32768, side="right")))
        part, at = values[starts[i]:ends[j - 1]], starts[i:j] - starts[i]
        for f in range(functions):
            out[i:j, f] = np.minimum.reduceat(mixed(part ^ seeds[f]), at)
        i = j
    return out


def sketches(bands: int):
    """id, hashes -> id, keys (one per band), sketch (a byte of each minimum), fp; no keys and no sketch for a text without words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            values = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False)).astype(np.int64).view(np.uint64)
            sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            full = sizes > 0
            least = minima(values, (np.cumsum(sizes) - sizes)[full], bands * BAND)
            keys = np.empty((len(least), bands), dtype=np.uint64)
            for b in range(bands):
                key = np.full(len(least), b + 1, dtype=np.uint64)
                for f in range(b * BAND, (b + 1) * BAND):
                    key = mixed(key * np.uint64(BASE) + least[:, f])
                keys[:, b] = key
            ends = np.concatenate([[0], np.cumsum(full * bands)]).astype(np.int32)
            held = iter((least & np.uint64(255)).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel().view(np.int64))),
                pa.array([next(held).tobytes() if x else b"" for x in full], pa.binary()), majority(lists),
            ], ["id", "keys", "sketch", "fp"])

    return run


def compare_sketches(least: int):
    """key, node, sketch sorted by key -> links (u, v): of each key a forest that connects what its pairs with ``least``
    equal bytes connect."""
    def links_of(nodes: np.ndarray, sketch: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(nodes)
        label, left, right, offset, at = np.arange(n), [], [], 1, np.arange(n - 1)
        while len(at):  # row i against row i + offset, for all keys at once
            at = at[at + offset < n]
            at = at[bucket[at] == bucket[at + offset]]
            apart = at[label[at] != label[at + offset]]  # what is connected needs no further link
            for c in range(0, len(apart), 1 << 15):
                i = apart[c:c + (1 << 15)]
                i = i[np.count_nonzero(sketch[i] == sketch[i + offset], axis=1) >= least]
                left.append(i)
                right.append(i + offset)
            if left and offset & (offset - 1) == 0 or len(left) > 64:
                label = forest(np.concatenate([*left, np.arange(n)]), np.concatenate([*right, label]), n)
                left, right = [], []
            offset += 1
        label = forest(np.concatenate([*left, np.arange(n)]), np.concatenate([*right, label]), n)
        joined = np.flatnonzero(label != np.arange(n))
        return nodes[label[joined]], nodes[joined]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(key, nodes, sketch):
            u, v = links_of(nodes, sketch, key)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        kept = None  # the last key of a batch may go on in the next
        for batch in batches:
            if not len(batch):
                continue
            key, nodes = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            sketch = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(batch), -1)
            if kept is not None:
                key, nodes, sketch = (np.concatenate(x) for x in zip(kept, (key, nodes, sketch)))
            others = np.flatnonzero(key != key[-1])
            last = others[-1] + 1 if len(others) else 0
            kept = key[last:], nodes[last:], sketch[last:]
            if last:
                yield emit(key[:last], nodes[:last], sketch[:last])
        if kept is not None:
            yield emit(*kept)

    return run


def sketch_links(points: DataFrame, least: int, rows: int = SKETCH_ROWS) -> DataFrame:
    """Links (u, v) that connect what all pairs of ``points`` (node, keys, sketch) with a common key and ``least`` equal bytes
    connect. Of keys with the same members one is compared; one with more than ``rows`` members by pairs of blocks."""
    keyed = points.select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("m"), F.expr("bit_xor(xxhash64(node))").alias("who")).where("m > 1")
    once = stored(shared.groupBy("m", "who").agg(F.min("key").alias("k")).select("k", "m"), "similar-keys")
    met = keyed.join(once, F.col("key") == F.col("k")).select(F.col("node").alias("o"), "key", "m")
    blocks = F.ceil(F.col("m") / rows)
    spread = met.join(points.select("node", "sketch"), F.col("o") == F.col("node")).withColumn(
        "own", F.pmod(F.xxhash64("node"), blocks)
    ).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    cells = spread.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "node", "sketch")
    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(compare_sketches(least), "u long, v long")


def print_links(classes: DataFrame, tau: int) -> DataFrame:
    """Links (u, v) of ``classes`` (node, fp) that connect the nodes whose fingerprints :func:`close_links` connects: those of
    one fingerprint with its smallest, and the smallest ones of linked fingerprints."""
    points = stored(classes.groupBy("fp").agg(F.min("node").alias("first")), "similar-points")
    alike = classes.select("fp", "node").join(points, "fp").where("node <> first").select(F.col("first").alias("u"), F.col("node").alias("v"))
    left, right = (points.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_node")) for c in "uv")
    across = close_links(points.select("fp"), tau).join(left, "u").join(right, "v")
    return alike.unionByName(across.select(F.col("u_node").alias("u"), F.col("v_node").alias("v")))


def similar_blocks(similarity: float):
    """Members of some block pairs (part, low, high, node, shingles) -> links (u, v): of each block pair a spanning forest of
    the exact Jaccard links. Shared shingles are counted over lists of the members that have a shingle."""
    def links(nodes: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n, sizes = len(nodes), np.array([len(x) for x in sets])
        owner = np.repeat(np.arange(n), sizes)
        values, code = np.unique(np.concatenate(sets), return_inverse=True)
        by_value = owner[np.argsort(code, kind="stable")]
        ends = np.cumsum(np.bincount(code, minlength=len(values)))
        starts, at = ends - np.bincount(code, minlength=len(values)), np.cumsum(sizes) - sizes
        left, right, waiting = [np.arange(n)], [np.arange(n)], 0
        for i in range(n):
            own = code[at[i]:at[i] + sizes[i]]
            having = np.concatenate([by_value[a:b] for a, b in zip(starts[own].tolist(), ends[own].tolist())]) if len(own) else own
            shared = np.bincount(having, minlength=n)[i + 1:]
            near = np.flatnonzero(shared >= similarity * (sizes[i] + sizes[i + 1:] - shared)) + i + 1
            left.append(np.full(len(near), i))
            right.append(near)
            waiting += len(near)
            if waiting > 1 << 20:  # keep only what connects
                left, right, waiting = [np.arange(n)], [forest(np.concatenate(left), np.concatenate(right), n)], 0
        label = forest(np.concatenate(left), np.concatenate(right), n)
        joined = np.flatnonzero(label != np.arange(n))
        return nodes[label[joined]], nodes[joined]

    def run(table: pa.Table) -> pa.Table:
        keys = np.stack([table.column(c).to_numpy() for c in ("part", "low", "high")])
        nodes, sets = table.column("node").to_numpy(), table.column("shingles").combine_chunks()
        order = np.lexsort(keys)
        cuts = np.flatnonzero((np.diff(keys[:, order], axis=1) != 0).any(axis=0)) + 1
        found = [(nodes[:0], nodes[:0])]
        for group in np.split(order, cuts):
            if len(group) > 1:
                found.append(links(nodes[group], [sets[int(i)].values.to_numpy(zero_copy_only=False) for i in group]))
        return pa.table({"u": np.concatenate([u for u, _ in found]), "v": np.concatenate([v for _, v in found])})

    return run


def similar_edges(members: DataFrame, similarity: float, block: int = 1024) -> DataFrame:
    """Links (u, v) that connect exactly what all pairs of ``members`` (node, part, m: members of the part, shingles:
    array of distinct hashes) of one part with Jaccard similarity of at least ``similarity`` connect.

    A part is cut into blocks, and every pair of blocks is compared in one task, so that no group grows beyond two
    blocks and pairs never become rows. Small parts share tasks.
    """
    blocks = F.ceil(F.col("m") / block)
    own = F.pmod(F.xxhash64("node"), blocks)
    spread = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    keyed = spread.select("part", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node", "shingles", "m")
    tasks = max(64, members.count() // block)
    task = F.when(F.col("m") <= block, F.pmod(F.xxhash64("part"), F.lit(tasks))).otherwise(F.xxhash64("part", "low", "high"))
    return keyed.withColumn("task", task).groupBy("task").applyInArrow(similar_blocks(similarity), "u long, v long")


def without_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: float = 0.8, tau: int = 3
) -> DataFrame:
    """The rows of ``docs``, with all their columns, less all but one of each group of copies and near copies.

    Texts with the same lower-cased words are copies. Texts are near copies if their ``k``-word shingle sets (a shorter
    text: its whole sequence) have Jaccard similarity of at least ``similarity``, and groups are what such links
    connect. Candidates are the texts whose SimHash fingerprints over these shingles, repeats included, link at ``tau`` or
    fewer differing bits (:func:`close_links`, as in :func:`near_duplicates`). A change in one place can move more bits than
    selective buckets allow, so candidates are also taken by minima of independent hash functions over the same sets:
    whatever changed, edits here and there or a long passage, a pair is missed with a probability of at most
    2 * ``MISS`` (see :func:`sketch_plan`). All are verified exactly, directly or through others.
    The smallest id of a group stays (null ids last); of rows that repeat its id and words, exactly one.
    Null and empty texts are copies of each other. Empty input gives empty output.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    split = docs.select(F.col(id_col).alias("id"), words(ascii_lower(text)).alias("w"))
    kind = docs.schema[id_col].dataType.simpleString()
    bands, least = sketch_plan(similarity)
    hashed = split.select("id", F.xxhash64(F.concat_ws(" ", "w")).alias("node"), shingle_hashes(F.col("w"), k).alias("hashes"))
    rows = stored(hashed.select(F.struct("id", "node").alias("id"), "hashes").mapInArrow(
        sketches(bands), f"id struct<id:{kind},node:long>, keys array<long>, sketch binary, fp long"
    ).select("id.id", "id.node", "keys", "sketch", "fp"), "similar-rows")
    classes = stored(rows.groupBy("node").agg(
        F.min(F.struct(F.col("id").isNull().alias("z"), "id")).alias("best"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"),
        F.first("fp").alias("fp"),
    ), "similar-classes")
    parts = components(print_links(classes, tau).unionByName(sketch_links(classes, least))).select(F.col("node").alias("f"), F.col("component").alias("part"))
    near = classes.join(parts, F.col("node") == F.col("f")).select("node", "best", "part")
    crowded = near.groupBy("part").agg(F.count("*").alias("m")).select(F.col("part").alias("q"), "m")
    wanted = stored(near.join(stored(crowded, "similar-parts"), F.col("part") == F.col("q")).select(
        "part", "m", "best.id", F.col("node").alias("own")
    ), "similar-wanted")
    # merge: both sides grow with the data; only texts travel, words are taken of those that matched
    texts = docs.select(F.col(id_col).alias("t_id"), text.alias("text")).join(wanted.hint("merge"), F.col("t_id").eqNullSafe(F.col("id")))
    found = texts.select("part", "m", "own", words(ascii_lower(F.col("text"))).alias("w")).withColumn("node", F.xxhash64(F.concat_ws(" ", "w")))
    members = stored(found.where("node = own").dropDuplicates(["node"]).select(
        "node", "part", "m", shingle_hashes(F.col("w"), k, True).alias("shingles")
    ), "similar-members")
    groups = components(similar_edges(members, similarity)).select(F.col("node").alias("g"), "component")
    labelled = stored(classes.join(groups, F.col("node") == F.col("g"), "left").select("node", "best", F.coalesce("component", "node").alias("component")), "similar-groups")
    stays = labelled.groupBy("component").agg(F.min(F.struct("best.z", "best.id", "node")).alias("s")).select(
        F.col("s.id").alias("_stay_id"), F.col("s.node").alias("_stay_node")
    )
    node = F.xxhash64(F.concat_ws(" ", words(ascii_lower(text))))
    kept = docs.withColumn("_node", node).join(
        stored(stays, "similar-stays").hint("merge"), F.col(id_col).eqNullSafe(F.col("_stay_id")) & (F.col("_node") == F.col("_stay_node")), "left_semi"
    )
    if rows.groupBy("id", "node").count().where("count > 1").isEmpty():
        return kept.drop("_node")
    return kept.dropDuplicates([id_col, "_node"]).drop("_node")
