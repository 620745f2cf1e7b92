"""Substring dedup by column-wise construction of the Burrows-Wheeler order of many strings.

Every window of ``length`` bytes has an anchor: its ``anchor_bytes``-gram of least hash. Equal windows have equal anchors at equal
offsets, so runs of windows with one anchor ("strings", at most twice ``length`` long) can only repeat within that
anchor's group. Strings of a shard are aligned at their anchors and built up from the last column to the first: each round
inserts one symbol per string, re-sorts the order of the suffixes stably by it (the transform's step), and
updates the common prefixes of neighbours by range minima. Suffixes of different columns cannot share a window,
so a round reads and writes one column's order and prefixes in sequence; they stand in for the external files,
which a shard of bounded size does not need.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import by_value, stored

by_value(__name__)

LENGTH, ANCHOR = 400, 128
SHARD_STRINGS = 4096  # strings a shard is planned for
GROUP_STRINGS = 65536  # an anchor with more different strings is resolved window by window
CHUNK = 1 << 20
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(raw: np.ndarray, size: int, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:len(raw)], out=sums[1:])
    return mixed((sums[size:] - sums[:-size]) * down[:len(raw) - size + 1])


def window_anchors(hashes: np.ndarray, width: int) -> np.ndarray:
    """Position of the least hash (leftmost of equals) among each ``width`` consecutive ones."""
    m, mask = len(hashes), np.uint64(2 * CHUNK - 1)
    key = (hashes & ~mask) | np.arange(m, dtype=np.uint64)
    blocks = np.concatenate([key, np.full(-m % width, ~np.uint64(0))]).reshape(-1, width)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = m - width + 1
    return (np.minimum(tail[:n], head[width - 1:width - 1 + n]) & mask).astype(np.int64)


def pieces(offsets: np.ndarray, length: int) -> Iterator[list[tuple[int, int, int]]]:
    """Chunks of (row, from, to) in the batch's bytes; a longer text is cut so that each window is in one piece."""
    chunk, total = [], 0
    for row in range(len(offsets) - 1):
        a, b = int(offsets[row]), int(offsets[row + 1])
        if b - a < length:
            continue
        if b - a > CHUNK:
            if chunk:
                yield chunk
                chunk, total = [], 0
            for s in range(a, b - length + 1, CHUNK - length + 1):
                yield [(row, s, min(b, s + CHUNK))]
            continue
        chunk.append((row, a, b))
        total += b - a
        if total > CHUNK // 2:
            yield chunk
            chunk, total = [], 0
    if chunk:
        yield chunk


def string_refs(length: int, anchor: int):
    """id, h, text -> id, h, start, windows, off (of the anchor), anchor (hash), content (hash): one row per string."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        up, down = powers(BASE, 2 * CHUNK), powers(pow(BASE, -1, 1 << 64), 2 * CHUNK)
        names = ["row", "start", "windows", "off", "anchor", "content"]
        for batch in batches:
            text = batch.column(2).cast(pa.large_binary())
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
            data = memoryview(text.buffers()[2]) if text.buffers()[2] is not None else memoryview(b"")
            found: list[list[np.ndarray]] = [[] for _ in names]
            for chunk in pieces(offsets, length):
                raw = np.concatenate([np.frombuffer(data[a:b], np.uint8) for _, a, b in chunk])
                sizes = np.array([b - a for _, a, b in chunk])
                begins = np.cumsum(sizes) - sizes
                hashes = gram_hashes(raw, anchor, up, down)
                at = window_anchors(hashes, length - anchor + 1)
                valid = np.zeros(len(at) + 1, dtype=np.int8)  # windows inside one text
                valid[begins] += 1
                valid[begins + sizes - length + 1] -= 1
                live = np.flatnonzero(np.cumsum(valid[:-1]))
                a = at[live]
                cut = np.flatnonzero((live[1:] != live[:-1] + 1) | (a[1:] != a[:-1])) + 1
                first, last = np.append(0, cut), np.append(cut, len(live))
                start, windows = live[first], last - first
                doc = np.searchsorted(begins, start, side="right") - 1
                view = memoryview(np.ascontiguousarray(raw))
                content = np.fromiter(
                    (xxhash.xxh3_64_intdigest(view[s:e]) for s, e in zip(start.tolist(), (start + windows + length - 1).tolist())),
                    dtype=np.uint64, count=len(start),
                )
                rows, base = np.array([r for r, _, _ in chunk]), np.array([f - int(offsets[r]) for r, f, _ in chunk])
                for held, x in zip(found, [rows[doc], start - begins[doc] + base[doc], windows, a[first] - start, hashes[a[first]], content]):
                    held.append(x)
            if not found[0]:
                continue
            row, *rest = (np.concatenate(x) for x in found)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), *[pa.array(x.view(np.int64)) for x in rest]],
                ["id", "h", *names[1:]],
            )

    return run


def cut_strings(length: int):
    """text, wanted (structs of anchor, content, n, crowded, start, windows, off) -> one row per string with its bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = [("anchor", pa.int64()), ("content", pa.int64()), ("n", pa.int64()), ("crowded", pa.bool_()), ("windows", pa.int64()),
                ("off", pa.int64()), ("bytes", pa.binary())]
        for batch in batches:
            rows = []
            for text, wanted in zip(batch.column(0), batch.column(1)):
                raw = text.as_py().encode()
                for w in wanted.as_py():
                    rows.append((w["anchor"], w["content"], w["n"], w["crowded"], w["windows"], w["off"], raw[w["start"]:w["start"] + w["windows"] + length - 1]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kind)], [k for k, _ in kind])

    return run


def range_minima(values: np.ndarray) -> list[np.ndarray]:
    tables, step = [values], 1
    while 2 * step <= len(values):
        last = tables[-1]
        tables.append(np.minimum(last[:-step], last[step:]))
        step *= 2
    return tables


def column_order(matrix: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int) -> np.ndarray:
    """Boolean (string, column): a window of ``length`` bytes starts there and another string has it at the same column.

    String i fills the columns begin[i] ... end[i] - 1. ``order`` are the strings whose suffix at the last column is
    alive, in suffix order; ``common`` the symbols each shares with the one before (at most ``length``).
    """
    repeated = np.zeros(matrix.shape, dtype=bool)
    order, common = np.zeros(0, np.int64), np.zeros(0, np.int16)
    starting = {int(c): np.flatnonzero(end == c) for c in np.unique(end)}
    stopping = {int(c) for c in np.unique(begin)}
    for column in range(matrix.shape[1] - 1, -1, -1):
        if column + 1 in stopping and len(order):  # strings that began at the last column leave
            keep = np.flatnonzero(begin[order] <= column)
            if len(keep) < len(order):
                common = np.minimum.reduceat(common[:keep[-1] + 1], np.append(0, keep[:-1] + 1)) if len(keep) else common[:0]
                order = order[keep]
        if (new := starting.get(column + 1)) is not None:  # the empty suffix sorts first and shares nothing
            order, common = np.concatenate([new, order]), np.concatenate([np.zeros(len(new), np.int16), common])
        if not len(order):
            continue
        symbol = matrix[order, column]
        step = np.argsort(symbol, kind="stable")
        a, b = step[:-1], step[1:]  # neighbours in the new order, by their old rank
        same = symbol[a] == symbol[b]
        fresh = np.zeros(len(order), np.int16)
        near = same & (b == a + 1)
        fresh[1:][near] = common[b[near]] + 1
        far = np.flatnonzero(same & (b != a + 1))
        if len(far):
            tables = range_minima(common)
            low, high = a[far] + 1, b[far]
            level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
            least = np.zeros(len(far), np.int16)
            for k in np.unique(level):
                at = np.flatnonzero(level == k)
                least[at] = np.minimum(tables[k][low[at]], tables[k][high[at] - (1 << int(k)) + 1])
            fresh[1:][far] = least + 1
        order, common = order[step], np.minimum(fresh, length)
        full = np.flatnonzero(common >= length)
        if len(full):
            repeated[order[full], column] = True
            repeated[order[full - 1], column] = True
    return repeated


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


SPAN = "anchor long, content long, lo long, hi long"


def spans_table(rows: list[tuple[int, int, int, int]]) -> pa.Table:
    return pa.table({n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(["anchor", "content", "lo", "hi"])})


def order_shard(length: int):
    """Strings of a shard -> (anchor, content, lo, hi): the bytes of each string that repeated windows cover."""
    def run(table: pa.Table) -> pa.Table:
        n, windows, off = (table.column(c).to_numpy() for c in ("n", "windows", "off"))
        sizes, lead = windows + length - 1, int(off.max())
        begin = lead - off
        end = begin + sizes
        matrix = np.zeros((len(n), int(end.max())), dtype=np.uint8)
        for i, raw in enumerate(table.column("bytes").to_pylist()):
            matrix[i, begin[i]:end[i]] = np.frombuffer(raw, np.uint8)
        repeated = column_order(matrix, begin, end, length)
        out = []
        for i, (anchor, content) in enumerate(zip(table.column("anchor").to_pylist(), table.column("content").to_pylist())):
            found = [(0, int(windows[i]))] if n[i] > 1 else runs(repeated[i, begin[i]:begin[i] + windows[i]])
            out += [(anchor, content, lo, hi + length - 1) for lo, hi in found]
        return spans_table(out)

    return run


def single_windows(length: int):
    """Strings -> (anchor, content, lo, n, w1, w2): 128 bits of hash per window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                for i in range(r["windows"]):
                    h = xxhash.xxh3_128_digest(r["bytes"][i:i + length])
                    rows.append((r["anchor"], r["content"], i, r["n"], int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(6)], ["anchor", "content", "lo", "n", "w1", "w2"])

    return run


def remove_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, text, spans -> id, n_bytes, n_removed, n_spans, kept."""
    for batch in batches:
        out = ([], [], [], [])
        for text, spans in zip(batch.column(1), batch.column(2)):
            raw, kept, at, n = (text.as_py() or "").encode(), [], 0, 0
            size = len(raw)
            if spans.is_valid:
                pairs = np.array([(s["lo"], s["hi"]) for s in spans.as_py()], dtype=np.int64)
                pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
                reach = np.maximum.accumulate(pairs[:, 1])
                first = np.append(True, pairs[1:, 0] > reach[:-1])  # spans that touch are one run
                begins, ends = pairs[first, 0], reach[np.append(np.flatnonzero(first)[1:] - 1, len(pairs) - 1)]
                for a, b in zip(begins.tolist(), ends.tolist()):
                    kept.append(raw[at:a])
                    at, n = b, n + 1
                kept.append(raw[at:])
                raw = b"".join(kept)
            for held, x in zip(out, (size, size - len(raw), n, raw)):
                held.append(x)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(x, pa.int64()) for x in out[:3]], pa.array(out[3], pa.binary())],
            ["id", "n_bytes", "n_removed", "n_spans", "kept"],
        )


def repeated_spans(
    keyed: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, shard_strings: int = SHARD_STRINGS, group_strings: int = GROUP_STRINGS
) -> DataFrame:
    """(id, h, spans): the byte spans of ``keyed`` (id, h, text) that repeated windows cover, by row."""
    kind = keyed.schema["id"].dataType.simpleString()
    refs = stored(keyed.mapInArrow(
        string_refs(length, anchor), f"id {kind}, h long, start long, windows long, off long, anchor long, content long"
    ), "suffix-refs")
    # an anchor seen once has no repeated window; one with a single string is repeated as a whole
    anchors = stored(refs.groupBy("anchor").agg(
        F.count("*").alias("n"), (F.min("content") != F.max("content")).alias("several")
    ).where("n > 1").select(F.col("anchor").alias("a"), "several"), "suffix-anchors")
    again = stored(refs.join(anchors, F.col("anchor") == F.col("a")).drop("a"), "suffix-again")
    strings = stored(again.where("several").groupBy("anchor", "content").agg(
        F.count("*").alias("n"), F.min(F.struct(F.col("id").isNull().alias("z"), "id", "h", "start", "windows", "off")).alias("r")
    ), "suffix-strings")
    crowded = strings.groupBy(F.col("anchor").alias("a")).agg(F.count("*").alias("k")).where(F.col("k") > group_strings)
    wanted = strings.join(stored(crowded, "suffix-crowded"), F.col("anchor") == F.col("a"), "left").groupBy(
        F.col("r.id").alias("w_id"), F.col("r.h").alias("w_h")
    ).agg(F.collect_list(F.struct(
        "anchor", "content", "n", F.col("k").isNotNull().alias("crowded"), F.col("r.start").alias("start"), F.col("r.windows").alias("windows"), F.col("r.off").alias("off")
    )).alias("wanted"))
    with_text = keyed.join(wanted, F.col("id").eqNullSafe(F.col("w_id")) & (F.col("h") == F.col("w_h"))).select("text", "wanted")
    cut = stored(with_text.mapInArrow(
        cut_strings(length), "anchor long, content long, n long, crowded boolean, windows long, off long, bytes binary"
    ), "suffix-cut")
    n_shards = max(1, strings.count() // shard_strings)
    covered = cut.where("NOT crowded").groupBy(F.pmod("anchor", F.lit(n_shards)).alias("shard")).applyInArrow(order_shard(length), SPAN)
    rest = cut.where("crowded")
    if not rest.isEmpty():
        each = stored(rest.mapInArrow(single_windows(length), "anchor long, content long, lo long, n long, w1 long, w2 long"), "suffix-windows")
        twice = stored(each.groupBy(F.col("w1").alias("v1"), F.col("w2").alias("v2")).agg(F.sum("n").alias("m")).where("m > 1"), "suffix-twice")
        covered = covered.unionByName(each.join(twice, (F.col("w1") == F.col("v1")) & (F.col("w2") == F.col("v2"))).select(
            "anchor", "content", "lo", (F.col("lo") + length).alias("hi")
        ))
    found = stored(covered.select(F.col("anchor").alias("f_anchor"), F.col("content").alias("f_content"), "lo", "hi"), "suffix-found")
    span = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi")).alias("span")
    alone = again.where("NOT several").select("id", "h", span(F.col("start"), F.col("start") + F.col("windows") + length - 1))
    shared = again.where("several").join(found, (F.col("anchor") == F.col("f_anchor")) & (F.col("content") == F.col("f_content"))).select(
        "id", "h", span(F.col("start") + F.col("lo"), F.col("start") + F.col("hi"))
    )
    return alone.unionByName(shared).groupBy("id", "h").agg(F.collect_set("span").alias("spans"))


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR,
    shard_strings: int = SHARD_STRINGS, group_strings: int = GROUP_STRINGS,
) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept (the remaining bytes, concatenated).

    Texts are UTF-8 bytes; null is empty; matches never cross documents. A byte goes if a string of ``length`` bytes that
    covers it also starts anywhere else, in the same document too; overlaps count, and all is judged on the
    input. Rows that repeat an id and a text count as two documents and lose the same bytes. Empty input gives
    empty output; other columns of ``docs`` are not read. ``anchor`` < ``length`` changes the cost only.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    spans = repeated_spans(keyed, length, anchor, shard_strings, group_strings)
    named = spans.select(F.col("id").alias("s_id"), F.col("h").alias("s_h"), "spans")
    joined = keyed.join(named, F.col("id").eqNullSafe(F.col("s_id")) & (F.col("h") == F.col("s_h")), "left").select("id", "text", "spans")
    kind = keyed.schema["id"].dataType.simpleString()
    return joined.mapInArrow(
        remove_spans, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary"
    ).withColumnRenamed("id", id_col)
