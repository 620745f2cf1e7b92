"""One large JSON document, read by many tasks.

Spark's text source cuts a file at byte ranges and gives whole pieces up to a separator, here the closing brace. Whether a range begins
inside a string, and how deep, depends on all that comes before it, so there are two passes: the first counts, for each
range, the quotes and the brackets, once as if it began outside and once as if inside a string; the few numbers per
range are added up in order of the file; the second, now that each range knows its state, cuts at the commas of the outermost
object or array. An entry that crosses from one range to the next is put together by one small shuffle.

A file compressed by gzip cannot be entered in its middle: it is unpacked and cut from its beginning by one task, in one pass and
without scratch tables.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.session import scratch_path

QUOTE, BACKSLASH, COMMA = b'"\\,'
CHUNK = 1 << 22  # bytes looked at together
PACKED = 64 << 20  # a gzip file of at most so many bytes is handed to its task at once, a larger one as pieces
STEP = np.zeros(256, dtype=np.int8)  # what a byte outside strings adds to the depth
STEP[list(b"{[")], STEP[list(b"}]")] = 1, -1
MARKS = bytes(b in b'"{}[],' for b in range(256))


def marks(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some whole pieces: the places of quotes that end or begin a string, brackets and commas; their bytes; whether an odd number of
    such quotes lies before each."""
    data = np.frombuffer(text, np.uint8)
    at = np.flatnonzero(np.frombuffer(text.translate(MARKS), bool))
    if BACKSLASH in text:  # the byte behind an odd run of backslashes is escaped; no run crosses the end of a piece
        escapes = np.flatnonzero(data == BACKSLASH)
        first = np.append(True, np.diff(escapes) != 1)
        runs = np.flatnonzero(first)
        lengths = np.diff(np.append(runs, len(escapes)))
        at = at[~np.isin(at, (escapes[runs] + lengths)[lengths % 2 == 1], assume_unique=True)]
    found = data[at]
    quotes = found == QUOTE
    return at, found, ((np.cumsum(quotes, dtype=np.uint8) - quotes) & 1).astype(bool)  # whether odd is all that is kept of the count


def runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, bytes]]:
    """(file, start, text) of the successive pieces of one range, each with its brace, at most ``CHUNK`` bytes and a piece at a time."""
    if not len(batch):
        return
    files, starts = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
    code, pieces = files.indices.to_numpy(), batch.column(2).cast(pa.binary()).to_pylist()
    size = np.cumsum(np.diff(np.frombuffer(batch.column(2).cast(pa.binary()).buffers()[1], np.int32, len(batch) + 1, batch.column(2).offset * 4))) // CHUNK
    cuts = np.flatnonzero((np.diff(code) != 0) | (np.diff(starts) != 0) | (np.diff(size) != 0)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)]):
        yield files.dictionary[int(code[a])].as_py(), int(starts[a]), b"}".join(pieces[a:b]) + b"}"


def count_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, start, value -> per range: quotes (odd number), depth gained if it begins outside a string, and if inside."""
    found: dict[tuple, list[int]] = {}
    for batch in batches:
        for file, start, text in runs(batch):
            about = found.setdefault((file, start), [0, 0, 0])
            _, kinds, odd = marks(text)
            step = STEP[kinds]
            deltas = int(step[~odd].sum(dtype=np.int64)), int(step[odd].sum(dtype=np.int64))  # outside, inside, as the text begins outside
            about[1] += deltas[about[0]]
            about[2] += deltas[1 - about[0]]
            about[0] ^= int(np.count_nonzero(kinds == QUOTE)) & 1
    rows = [(*key, *about) for key, about in found.items()]
    yield pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))],
        ["file", "start", "odd", "outside", "inside"],
    )


class Cutter:
    """Cuts the text of one range at the commas of depth 1; ``inside`` and ``depth`` are the state as the range begins."""

    def __init__(self, inside: bool, depth: int):
        self.inside, self.depth = inside, max(depth, 0)
        self.held: list[bytes] | None = [] if depth > 0 else None

    def feed(self, text: bytes) -> list[bytes]:
        """Entries, or parts of them, that a comma ends in this text."""
        at, kinds, odd = marks(text)
        quotes = kinds == QUOTE
        outside = (odd == self.inside) & ~quotes
        self.inside = bool((int(np.count_nonzero(quotes)) + self.inside) & 1)
        at, kinds = at[outside], kinds[outside]
        depth = self.depth + np.cumsum(STEP[kinds], dtype=np.int64)
        depth -= np.minimum(np.minimum.accumulate(depth), 0) if len(depth) else 0  # a bracket too many behind the document counts for nothing
        before = np.append(self.depth, depth[:-1])
        opens, cuts = (before == 0) & (depth == 1), (depth == 1) & (kinds == COMMA)
        ends = (before == 1) & (depth == 0)
        some = np.flatnonzero(opens | cuts | ends)
        found, from_ = [], 0
        for place, opened, ended in zip(at[some].tolist(), opens[some].tolist(), ends[some].tolist()):
            if not opened:
                self.held.append(text[from_:place])
                found.append(b"".join(self.held) if len(self.held) > 1 else self.held[0])
            self.held = None if ended else []  # nothing comes behind the document; the outermost bracket belongs to no entry
            from_ = place + 1
        if len(depth):
            self.depth = int(depth[-1])
        if self.depth:
            self.held.append(text[from_:])
        return found


def cut_ranges(states: dict[tuple, tuple[bool, int]]):
    """file, start, value -> file, start, number, last, text: what the commas of each range cut; number 0 continues the range before."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutters: dict[tuple, tuple[Cutter, list]] = {}
        names = ["file", "start", "number", "last", "text"]

        def made(file: str, start: int, number: int, last: bool, texts: list[bytes]) -> pa.RecordBatch:
            n = len(texts)
            return pa.RecordBatch.from_arrays([
                pa.array([file] * n, pa.string()), pa.array(np.full(n, start, np.int64)), pa.array(np.arange(number, number + n, dtype=np.int64)),
                pa.array([last] * n, pa.bool_()), pa.array(texts, pa.binary()).cast(pa.string()),
            ], names)

        for batch in batches:
            for file, start, text in runs(batch):
                if (file, start) not in cutters:
                    cutters[file, start] = Cutter(*states[file, start]), [0]
                cutter, number = cutters[file, start]
                texts = cutter.feed(text)
                yield made(file, start, number[0], False, texts)
                number[0] += len(texts)
        for (file, start), (cutter, number) in cutters.items():
            yield made(file, start, number[0], True, [b"".join(cutter.held or [])])

    return run


def cut_packed(numbers: dict[str, int]):
    """file, content (gzip) -> pos, entry. A task holds files as they are stored (a batch), and of their text a chunk and an entry."""
    def placed(pos: int, texts: list[bytes]) -> pa.RecordBatch:
        at = pa.array(np.arange(pos, pos + len(texts), dtype=np.int64))
        return pa.RecordBatch.from_arrays([at, pa.array(texts, pa.binary()).cast(pa.string())], ["pos", "entry"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1)):
                cutter, pos = Cutter(False, 0), numbers[file.as_py()] << 44
                with gzip.open(pa.BufferReader(content.as_buffer())) as stream:
                    while text := stream.read(CHUNK):
                        while text.endswith(b"\\") and (more := stream.read(1)):  # no run of backslashes crosses the end of a chunk
                            text += more
                        texts = cutter.feed(text)
                        yield placed(pos, texts)
                        pos += len(texts)
                yield placed(pos, [b"".join(cutter.held or [])])

    return run


def json_entries(spark: SparkSession, path: str) -> DataFrame:
    """(pos, entry): the text of each entry of the outermost object or array of each file below ``path``.

    An entry of an object is ``"key": value``. White space around entries is left; an empty object, array or file has no
    entry. ``pos`` grows in the order of the files' names and within a file. Files must be well-formed JSON in UTF-8 with one document each. A
    compressed file is read by one task, any other at ranges by many; a task holds one range's pieces in turn, and one entry.
    """
    packed = F.col("_metadata.file_path").endswith(".gz") & (F.col("_metadata.file_size") <= PACKED)
    stored = spark.read.format("binaryFile").load(path)
    found = stored.select(F.col("_metadata.file_path").alias("file"), packed.alias("packed")).collect()  # a row per file
    numbers = {file: i for i, file in enumerate(sorted(r.file for r in found))}
    parts = []
    if any(r.packed for r in found):
        contents = stored.where(packed).select(F.col("_metadata.file_path").alias("file"), "content")
        parts.append(contents.mapInArrow(cut_packed(numbers), "pos long, entry string"))
    if not parts or not all(r.packed for r in found):
        text = spark.read.option("lineSep", "}").text(path)
        parts.append(range_entries(text.where(~packed) if parts else text, numbers))
    return reduce(DataFrame.unionByName, parts).where(F.col("entry").rlike(r"\S"))


def range_entries(text: DataFrame, numbers: dict[str, int]) -> DataFrame:
    """(pos, entry) of the files of ``text``, which has them as pieces up to a brace."""
    spark = text.sparkSession
    pieces = text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value"
    )
    counts = pieces.mapInArrow(count_ranges, "file string, start long, odd long, outside long, inside long").collect()  # a row per range
    states, order, state, before = {}, [], (False, 0), None
    for r in sorted(counts, key=lambda r: (r.file, r.start)):
        if r.file != before:
            state, before = (False, 0), r.file
        states[r.file, r.start] = state
        order.append((r.file, r.start))
        state = state[0] ^ bool(r.odd), state[1] + (r.inside if state[0] else r.outside)
    cut = scratch_path(spark, "json-entries")
    pieces.mapInArrow(cut_ranges(states), "file string, start long, number long, last boolean, text string").write.parquet(cut)
    rows = spark.read.schema("file string, start long, number long, last boolean, text string").parquet(cut)
    # the last part of a range goes on in the ranges behind it, up to the first that has a comma
    ends = {(r.file, r.start): r.number for r in rows.where("last").select("file", "start", "number").collect()}  # a row per range
    owners, owner, before = [], None, None
    for i, (file, start) in enumerate(order):
        if file != before:
            owner, before = (start, 0), file
        owners.append((file, start, *owner, i))
        if ends[file, start]:
            owner = start, ends[file, start]
    owned = F.broadcast(spark.createDataFrame(owners, "file string, start long, o_start long, o_number long, place long"))
    files = F.broadcast(spark.createDataFrame([(numbers[f], f) for f in dict.fromkeys(f for f, _ in order)], "file_no long, file string"))
    whole = rows.where("number > 0 AND NOT last").select("file", F.col("start").alias("range_start"), "number", F.col("text").alias("entry"))
    first = (F.col("number") == 0) & ((F.col("start") != F.col("o_start")) | (F.col("o_number") != 0))
    split = rows.where("number = 0 OR last").join(owned, ["file", "start"]).select(
        "file", F.when(first, F.col("o_start")).otherwise(F.col("start")).alias("range_start"),
        F.when(first, F.col("o_number")).otherwise(F.col("number")).alias("number"), "place", "text",
    )
    joined = split.groupBy("file", "range_start", "number").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda p: p["text"]), "").alias("entry")
    )
    # a range has fewer entries than bytes
    pos = F.shiftleft("file_no", 44) + F.col("range_start") + F.col("number")
    return whole.unionByName(joined).join(files, "file").select(pos.alias("pos"), "entry")
