"""Hard-negative mining with a GNAT-style multiway hyperplane tree.

Each node of the tree has a few split points; a vector belongs to the nearest one (the hyperplanes between the split points bound
their parts). For each pair of siblings the node stores the range of distances from the one's split point to all vectors of the
other's subtree. A search window on scores is an annulus of distances around the anchor; a sibling whose range from some
split point does not meet it is left out with its whole subtree. What remains are leaves, which are compared exactly.

Inner products become distances by one more coordinate: all indexed vectors x get sqrt(M - x.x), M the largest
x.x, and anchors a get 0, so that distance^2 = a.a + M - 2 * score: a score window is exactly an annulus.

The tree is fitted on a bounded sample and broadcast; ranges, leaves and searches run over all rows. Leaves above
``leaf_rows`` are dealt in slices, anchors of a leaf in chunks, so that no task meets more than a slice and a chunk at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import by_value, stored

by_value(__name__)

SCALE = 256  # components become floor(SCALE * x)
CLASSES = 10
FANOUT = 8
LEAF_ROWS = 2048  # rows a leaf is planned for, and of a slice
CHUNK_ANCHORS = 4096
SAMPLE = 8192  # rows that split points are chosen from
MAX_LEVELS = 4
POSITIVES, NEGATIVES = 5, 5
LOW, HIGH = 80, 100  # percent of the positive's score

POINT = "uid long, id long, label int, q array<int>"
FOUND = "anchor long, anchor_id long, label int, a array<int>, other long, other_id long, score long"


@dataclass
class Node:
    """``points`` are split points with their extra coordinate; ``low`` and ``high`` (i, j): distances from i to the rows of part j."""

    number: int
    points: np.ndarray
    children: list["Node | None"] = field(default_factory=list)
    leaves: list[int] = field(default_factory=list)
    low: np.ndarray | None = None
    high: np.ndarray | None = None


def lifted(x: np.ndarray, largest: float) -> np.ndarray:
    """Vectors with the coordinate that brings them all to the same length."""
    x = x.astype(np.float64)
    return np.concatenate([x, np.sqrt(np.maximum(largest - (x * x).sum(axis=1), 0))[:, None]], axis=1)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)
    return np.sqrt(np.maximum(d, 0))


def split_points(x: np.ndarray, fanout: int, rng: np.random.Generator) -> np.ndarray:
    """Points far from each other: the first by chance, each next the farthest of some candidates from those before."""
    some = x[rng.permutation(len(x))[:3 * fanout]]
    taken, gap = [0], distances(some, some[:1])[:, 0]
    while len(taken) < fanout and gap.max() > 1e-3:
        taken.append(int(gap.argmax()))
        gap = np.minimum(gap, distances(some, some[taken[-1:]])[:, 0])
    return some[taken]


def grow(x: np.ndarray, levels: int, fanout: int, seed: int = 42) -> tuple[list[Node], int]:
    """(nodes, number of leaves) of a tree over the sample ``x``; node 0 is the root. A part that is too small to split is a leaf."""
    rng, nodes, leaves = np.random.default_rng(seed), [], 0

    def build(part: np.ndarray, level: int) -> Node | None:
        nonlocal leaves
        points = split_points(part, fanout, rng) if level and len(part) >= 2 else part[:0]
        if len(points) < 2:
            return None
        node = Node(len(nodes), points)
        nodes.append(node)
        nearest = distances(part, points).argmin(axis=1)
        for j in range(len(points)):
            child = build(part[nearest == j], level - 1)
            node.children.append(child)
            node.leaves.append(-1 if child else leaves)
            leaves += child is None
        return node

    build(x, levels)
    return nodes, max(leaves, 1)


def descend(nodes: list[Node], x: np.ndarray) -> Iterator[tuple[Node, np.ndarray, np.ndarray, np.ndarray]]:
    """(node, rows that reach it, their distances to its split points, the part each belongs to)."""
    todo = [(nodes[0], np.arange(len(x)))] if nodes and len(x) else []
    while todo:
        node, rows = todo.pop()
        d = distances(x[rows], node.points)
        part = d.argmin(axis=1)
        yield node, rows, d, part
        for j, child in enumerate(node.children):
            own = rows[part == j]
            if child and len(own):
                todo.append((child, own))


def leaves_of(nodes: list[Node], x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    for node, rows, _, part in descend(nodes, x):
        leaf = np.array(node.leaves)[part]
        out[rows[leaf >= 0]] = leaf[leaf >= 0]
    return out


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of equal width; a shorter vector is followed by zeros."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.value_lengths())
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int32)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def range_meter(nodes: list[Node], width: int, largest: float):
    """Points -> node, i, j, low, high: the ranges of a partition's rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = [np.full((len(n.points),) * 2, np.inf) for n in nodes]
        high = [np.full((len(n.points),) * 2, -np.inf) for n in nodes]
        for batch in batches:
            x = lifted(matrix(batch.column(0), width), largest)
            for node, _, d, part in descend(nodes, x):
                for j in np.unique(part):
                    own = d[part == j]
                    low[node.number][:, j] = np.minimum(low[node.number][:, j], own.min(axis=0))
                    high[node.number][:, j] = np.maximum(high[node.number][:, j], own.max(axis=0))
        for k, (a, b) in enumerate(zip(low, high)):
            i, j = np.nonzero(np.isfinite(a))
            if len(i):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(i), k)), pa.array(i), pa.array(j), pa.array(a[i, j]), pa.array(b[i, j])], ["node", "i", "j", "low", "high"]
                )

    return run


def placer(nodes: list[Node], width: int, largest: float):
    """Points -> points with their leaf."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = leaves_of(nodes, lifted(matrix(batch.column("q"), width), largest))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], [*batch.schema.names, "leaf"])

    return run


def met_leaves(nodes: list[Node], n_leaves: int, a: np.ndarray, largest: float, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(anchor, leaf): may the leaf hold a row whose score with the anchor is between ``low`` and ``high``?"""
    out = np.zeros((len(a), n_leaves), bool)
    if not nodes:
        out[:] = True
        return out
    a = a.astype(np.float64)
    square = (a * a).sum(axis=1) + largest
    slack = 1e-6 * np.sqrt(square) + 1e-3
    inner = np.sqrt(np.maximum(square - 2 * high, 0)) - slack
    outer = np.sqrt(np.maximum(square - 2 * low, 0)) + slack
    flat = np.concatenate([a, np.zeros((len(a), 1))], axis=1)
    todo = [(nodes[0], np.arange(len(a)))]
    while todo:
        node, rows = todo.pop()
        d = distances(flat[rows], node.points)[:, :, None]
        nearest = np.maximum(d - node.high, node.low - d).max(axis=1)  # of part j, seen from all split points
        farthest = (d + node.high).min(axis=1)
        meets = (nearest <= outer[rows, None]) & (farthest >= inner[rows, None])
        for j, child in enumerate(node.children):
            own = rows[meets[:, j]]
            if not len(own):
                continue
            if child:
                todo.append((child, own))
            else:
                out[own, node.leaves[j]] = True
    return out


@dataclass
class Tree:
    nodes: list[Node]
    n_leaves: int
    width: int
    largest: float
    slices: dict[int, int]
    rows: DataFrame


def measured_tree(points: DataFrame, leaf_rows: int, fanout: int, sample: int) -> Tree:
    """The tree over all ``points``; they are written with their leaves to the shared folder."""
    spark = points.sparkSession
    size = F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x)
    n, width, largest, top = points.agg(
        F.count("*"), F.coalesce(F.max(F.size("q")), F.lit(0)), F.coalesce(F.max(size), F.lit(0)), F.coalesce(F.max(F.array_max(F.transform("q", F.abs))), F.lit(0))
    ).first()
    if top * top * max(width, 1) >= 1 << 53:
        raise ValueError("scores of such large components are not exact")
    levels = min(MAX_LEVELS, max(1, math.ceil(math.log(max(n / leaf_rows, 1), fanout))))
    chosen = points.orderBy(F.xxhash64("uid"), "uid").limit(sample).select("q").toArrow()  # bounded by the parameter
    x = matrix(chosen.column("q").combine_chunks(), width) if n else np.zeros((0, width), np.int32)
    nodes, n_leaves = grow(lifted(x, largest), levels, fanout)
    ranges = points.select("q").mapInArrow(range_meter(nodes, width, largest), "node long, i long, j long, low double, high double")
    for node in nodes:
        node.low = np.full((len(node.points),) * 2, np.inf)
        node.high = np.full((len(node.points),) * 2, -np.inf)
    for node, i, j, low, high in ranges.groupBy("node", "i", "j").agg(F.min("low"), F.max("high")).collect() if nodes else []:  # bounded by the tree
        nodes[node].low[i, j], nodes[node].high[i, j] = low, high
    rows = stored(points.mapInArrow(placer(nodes, width, largest), POINT + ", leaf long"), "gnat-rows")
    counts = dict(rows.groupBy("leaf").count().collect())  # one number a leaf
    slices = {leaf: -(-count // leaf_rows) for leaf, count in counts.items()}
    return Tree(nodes, n_leaves, width, largest, slices, rows)


def prober(tree_nodes: list[Node], n_leaves: int, width: int, largest: float, slices: dict[int, int], home: bool, rest: bool):
    """uid, id, label, q, leaf (own), low, high -> one row per leaf slice that may hold a score in low ... high.

    ``home`` keeps the anchor's own leaf, ``rest`` the others.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_slices = np.array([slices.get(leaf, 0) for leaf in range(n_leaves)])
        for batch in batches:
            a = matrix(batch.column("q"), width)
            met = met_leaves(tree_nodes, n_leaves, a, largest, batch.column("low").to_numpy(), batch.column("high").to_numpy())
            own = np.arange(n_leaves)[None, :] == batch.column("leaf").to_numpy()[:, None]
            row, leaf = np.nonzero(met & ((own & home) | (~own & rest)))
            times = n_slices[leaf]
            row, leaf = np.repeat(row, times), np.repeat(leaf, times)
            part = np.arange(len(leaf)) - np.repeat(np.cumsum(times) - times, times)
            for s in range(0, len(row), 10000):
                at = pa.array(row[s:s + 10000])
                columns = [c.take(at) for n, c in zip(batch.schema.names, batch.columns) if n != "leaf"]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(leaf[s:s + 10000]), pa.array(part[s:s + 10000])], [*(n for n in batch.schema.names if n != "leaf"), "leaf", "slice"]
                )

    return run


def first_of_each(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k rows of highest score, then smallest id, of each group, in order."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    begin = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(begin, np.diff(np.append(begin, len(g))))
    return order[rank < k]


def ids_of(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)


def scores_of(anchors: pa.Table, rows: pa.Table, width: int) -> np.ndarray:
    a, x = (matrix(t.column("q").combine_chunks(), width).astype(np.float64) for t in (anchors, rows))
    return a @ x.T  # exact: all sums stay below 2^53


def same_label(width: int, k: int):
    """Anchors and a leaf slice -> the k best rows of the anchor's label, other than itself, that score ``low`` or more."""
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not (anchors.num_rows and rows.num_rows):
            return found_table(anchors, rows, [np.zeros(0, np.int64)] * 2, np.zeros(0))
        s = scores_of(anchors, rows, width)
        label, uid, low = (anchors.column(c).to_numpy() for c in ("label", "uid", "low"))
        fits = (label[:, None] == rows.column("label").to_numpy()) & (uid[:, None] != rows.column("uid").to_numpy()) & (s >= low[:, None])
        i, j = np.nonzero(fits)
        best = first_of_each(i, s[i, j], ids_of(rows.column("id"))[j], k)
        return found_table(anchors, rows, [i[best], j[best]], s[i[best], j[best]])

    return run


def found_table(anchors: pa.Table, rows: pa.Table, at: list[np.ndarray], score: np.ndarray) -> pa.Table:
    i, j = (pa.array(x, pa.int64()) for x in at)
    return pa.table([
        *(anchors.column(c).combine_chunks().take(i) for c in ("uid", "id", "label", "q")), *(rows.column(c).combine_chunks().take(j) for c in ("uid", "id")),
        pa.array(score.astype(np.int64)),
    ], ["anchor", "anchor_id", "label", "a", "other", "other_id", "score"])


def other_labels(width: int, k: int, low: int, high: int):
    """Anchors with their positives' scores, and a leaf slice -> the k best rows of other labels in each positive's window."""
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        names = ["anchor", "positive", "negative_id", "negative_score"]
        if not (anchors.num_rows and rows.num_rows):
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64())], names)
        s = scores_of(anchors, rows, width).astype(np.int64)
        label, least, most = (anchors.column(c).to_numpy() for c in ("label", "low", "high"))
        i, j = np.nonzero((label[:, None] != rows.column("label").to_numpy()) & (s >= least[:, None]) & (s <= most[:, None]))
        hit = s[i, j]
        wanted = anchors.column("scores").combine_chunks()
        out = []
        for p in range(int(np.asarray(wanted.value_lengths()).max())):
            own = np.array([x[p] if p < len(x) else np.iinfo(np.int64).min // 200 for x in wanted.to_pylist()], dtype=np.int64)[i]
            inside = np.flatnonzero((low * own <= 100 * hit) & (100 * hit <= high * own))
            inside = inside[first_of_each(i[inside], hit[inside], ids_of(rows.column("id"))[j[inside]], k)]
            out.append([anchors.column("uid").to_numpy()[i[inside]], np.full(len(inside), p), j[inside], hit[inside]])
        uid, p, j, hit = (np.concatenate(x) for x in zip(*out))
        return pa.table([pa.array(uid), pa.array(p, pa.int32()), rows.column("id").combine_chunks().take(pa.array(j)), pa.array(hit)], names)

    return run


def probe(tree: Tree, anchors: DataFrame, home: bool, rest: bool, chunk: int, compare, kind: str) -> DataFrame:
    """``compare`` over all (chunk of anchors, leaf slice) that may meet."""
    asked = anchors.mapInArrow(
        prober(tree.nodes, tree.n_leaves, tree.width, tree.largest, tree.slices, home, rest),
        T.StructType([f for f in anchors.schema.fields if f.name != "leaf"]).add("leaf", "long").add("slice", "long"),
    )
    asked = stored(asked, "gnat-probes")
    load = asked.where("slice = 0").groupBy("leaf").agg((F.floor((F.count("*") - 1) / chunk) + 1).alias("chunks"))
    n_slices = anchors.sparkSession.createDataFrame(list(tree.slices.items()), "leaf long, slices long")
    load = F.broadcast(load.join(F.broadcast(n_slices), "leaf"))  # two numbers a leaf
    left = asked.join(load, "leaf").select(*asked.columns, F.pmod(F.xxhash64("uid"), "chunks").alias("chunk"))
    right = tree.rows.join(load, "leaf").select(
        "uid", "id", "label", "q", "leaf", F.pmod(F.xxhash64("uid"), "slices").alias("slice"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"),
    )
    keys = ["leaf", "slice", "chunk"]
    return left.groupBy(keys).cogroup(right.groupBy(keys)).applyInArrow(compare, kind)


def best(found: DataFrame, by: list[str], score: str, id_: str, k: int, *same: str) -> DataFrame:
    """The first k (id, score) of each group, in order, as an array ``top``; ``same`` columns are equal within a group."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), F.asc_nulls_last(id_)))
    rows = found.withColumn("place", place).where(F.col("place") <= k)
    top = F.array_sort(F.collect_list(F.struct("place", F.col(id_).alias("id"), F.col(score).alias("score"))))
    return rows.groupBy(*by).agg(top.alias("top"), *(F.first(c).alias(c) for c in same))


def points_of(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """uid, id, label, q for the rows that take part."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    label = F.col(label_col).cast("int")
    shifted = F.when(F.col(id_col) % 7 == 0, (label + 1) % CLASSES).otherwise(label)
    q = F.transform(x, lambda v: F.floor(v * SCALE).cast("int"))
    return vectors.where(label.isNotNull() & x.isNotNull() & finite).select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id"), shifted.alias("label"), q.alias("q")
    )


def hard_negatives(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", anchor_every: int = 100,
    leaf_rows: int = LEAF_ROWS, fanout: int = FANOUT, sample: int = SAMPLE, chunk: int = CHUNK_ANCHORS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), exact.

    Rows with a null label, a null vector or a component that is null or not finite take no part; where the id is
    divisible by 7 the label is first (label + 1) % 10. Components are floor(256 * x); scores are integer inner products, a
    shorter vector counting as followed by zeros. Anchors are the rows whose id ``anchor_every`` divides; an anchor's
    positives are the first five other rows of its label by falling score, then id (null last), and each positive's
    negatives the first five rows of other labels that score 80 to 100 percent of it (none for a negative
    score). A row that repeats an id is a row of its own, as anchor too. Empty input gives no rows; other columns are
    not read. Components whose scores could pass 2^53 raise an error.

    Positives: an anchor searches its own leaf first; the worst of its best five there narrows the annulus for
    all other leaves. Negatives: one search per anchor in the annulus of its positives' windows.
    """
    points = stored(points_of(vectors, id_col, vector_col, label_col), "gnat-points")
    tree = measured_tree(points, leaf_rows, fanout, sample)
    anchors = tree.rows.where(F.col("id") % anchor_every == 0)
    wide = float(1 << 60)
    first = stored(probe(
        tree, anchors.select("*", F.lit(-wide).alias("low"), F.lit(wide).alias("high")), True, False, chunk, same_label(tree.width, POSITIVES), FOUND
    ), "gnat-home")
    near = best(first, ["anchor"], "score", "other_id", POSITIVES).select(
        "anchor", F.when(F.size("top") == POSITIVES, F.element_at("top", -1)["score"]).cast("double").alias("worst")
    )
    again = anchors.join(near, F.col("uid") == F.col("anchor"), "left").select(
        *anchors.columns, F.coalesce("worst", F.lit(-wide)).alias("low"), F.lit(wide).alias("high")
    )
    second = probe(tree, again, False, True, chunk, same_label(tree.width, POSITIVES), FOUND)
    positives = stored(
        best(first.unionByName(second), ["anchor"], "score", "other_id", POSITIVES, "anchor_id", "label", "a"), "gnat-positives"
    )
    windows = positives.select(
        F.col("anchor").alias("uid"), F.col("anchor_id").alias("id"), "label", F.col("a").alias("q"), F.lit(-1).cast("long").alias("leaf"),
        F.transform("top", lambda t: t["score"]).alias("scores"),
    ).where(F.element_at("scores", 1) >= 0)
    least = F.array_min(F.filter("scores", lambda s: s >= 0))
    asked = windows.select("*", (F.ceil(LOW * least / 100) - 1).cast("double").alias("low"), F.element_at("scores", 1).cast("double").alias("high"))
    found = probe(
        tree, asked, False, True, chunk, other_labels(tree.width, NEGATIVES, LOW, HIGH), "anchor long, positive int, negative_id long, negative_score long"
    )
    chosen = best(found, ["anchor", "positive"], "negative_score", "negative_id", NEGATIVES).select(
        F.col("anchor").alias("uid"), "positive", F.explode("top").alias("negative")
    )
    positive = F.get("top", "positive")
    return chosen.join(positives, F.col("uid") == F.col("anchor")).select(
        "anchor_id", positive["id"].alias("positive_id"), F.col("negative.place").alias("rank"), F.col("negative.id").alias("negative_id"),
        positive["score"].alias("positive_score"), F.col("negative.score").alias("negative_score"),
    )
