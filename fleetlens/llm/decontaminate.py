"""Benchmark decontamination: documents that hold a test item with at most a given number of edits.

An item with an error budget of k edits is cut into k + 1 pieces; wherever the item occurs within budget, one piece occurs
unchanged. All pieces of a block of items are searched at once (Aho-Corasick), and the surroundings of every hit are
verified by Myers' bit-parallel edit distance.
"""

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import by_value

by_value(__name__)

BLOCK_BYTES = 8 << 20  # of test items that one pass over the documents searches
CHARS_PER_EDIT = 20  # one edit of budget for so many characters
SHORT = 30  # a shorter item must occur unchanged, as whole words


def normalised(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def cut(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece) of budget + 1 pieces of about equal length."""
    marks = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(marks, marks[1:])]


def occurrences(item: str, masks: dict[str, int], text: str, limit: int) -> tuple[int, int] | None:
    """(edits, end) of the best occurrence of ``item`` in ``text`` within ``limit`` edits, the first of equals; by Myers'
    bit vectors, one column per character."""
    m = len(item)
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, None
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        x = (((eq & up) + up) ^ up) | eq
        across_up, across_down = down | ~(x | up), up & x
        score += bool(across_up & high) - bool(across_down & high)
        across_up, across_down = across_up << 1, across_down << 1
        up, down = (across_down | ~(eq | down | across_up)) & full, across_up & (eq | down) & full
        if score <= limit and (best is None or score < best[0]):
            best = score, j + 1
            if not score:
                break
    return best


def char_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        masks[c] |= 1 << i
    return dict(masks)


def merged(windows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(windows):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


class Searcher:
    """A block of items (item_id, text), ready to search texts."""

    def __init__(self, block: list[tuple[int, str]], chars_per_edit: int, short: int):
        import ahocorasick

        items: dict[str, int] = {}  # equal items are one, by their smallest id
        for item_id, text in block:
            if (item := normalised(text)) and (item not in items or item_id < items[item]):
                items[item] = item_id
        # one short word would be found anywhere: it must be the whole document
        self.whole = {item: item_id for item, item_id in items.items() if len(item) < short and " " not in item}
        self.known = [
            (item, item_id, len(item) // chars_per_edit if len(item) >= short else 0, {}, len(item) < short)
            for item, item_id in items.items() if item not in self.whole
        ]
        found = defaultdict(list)
        for n, (item, _, budget, _, _) in enumerate(self.known):
            for offset, piece in cut(item, budget):
                found[piece].append((n, offset))
        self.automaton = ahocorasick.Automaton() if found else None
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        if found:
            self.automaton.make_automaton()

    def near(self, doc: str) -> dict[int, list[tuple[int, int]]]:
        """Per item, the windows of ``doc`` around its piece hits."""
        near: dict[int, list[tuple[int, int]]] = {}
        for end, (size, places) in self.automaton.iter(doc) if self.automaton and doc else ():
            for n, offset in places:
                item, _, budget, _, _ = self.known[n]
                start = end + 1 - size - offset
                window = max(0, start - budget), start + len(item) + budget
                held = near.setdefault(n, [])
                if held and held[-1][0] <= window[0] <= held[-1][1]:  # hits come by their end: mostly in order
                    held[-1] = held[-1][0], max(held[-1][1], window[1])
                else:
                    held.append(window)
        return near

    def matches(self, text: str | None) -> Iterator[tuple[int, int, int]]:
        """(item_id, edits, end) of each item that ``text`` holds."""
        doc = normalised(text)
        if doc in self.whole:
            yield self.whole[doc], 0, len(doc)
        for n, windows in self.near(doc).items():
            item, item_id, budget, masks, short = self.known[n]
            if short:
                if alone := re.search(rf"(?<!\w){re.escape(item)}(?!\w)", doc):
                    yield item_id, 0, alone.end()
                continue
            if (at := doc.find(item)) >= 0:
                yield item_id, 0, at + len(item)
                continue
            if not masks:
                masks.update(char_masks(item))
            best = None
            for a, b in merged(windows):
                hit = occurrences(item, masks, doc[a:b], budget)
                if hit and (best is None or hit[0] < best[0]):
                    best = hit[0], a + hit[1]
            if best:
                yield item_id, *best


def searcher(block, chars_per_edit: int, short: int):
    """id, text -> id, item_id, edits, end for every item of the block that the document holds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Searcher(block.value, chars_per_edit, short)
        for batch in batches:
            rows = [
                (id_, *found) for id_, text in zip(batch.column(0).to_pylist(), batch.column(1)) for found in search.matches(text.as_py())
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], batch.schema.field(0).type), *[pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2, 3)]],
                ["id", "item_id", "edits", "end"],
            )

    return run


def normalised_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([normalised(t.as_py()) for t in batch.column(1)], pa.string())], ["item_id", "text"])


def blocks(benchmark: DataFrame, block_bytes: int) -> Iterator:
    """Broadcasts of (item_id, text) lists of about ``block_bytes``. Items whose normalised texts are equal are one, by their
    smallest id, before blocks are cut, so that no result hangs on the size of a block."""
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    items = items.mapInArrow(normalised_items, "item_id long, text string").where("text <> ''").groupBy("text").agg(F.min("item_id").alias("item_id"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-total // block_bytes))
    for b in range(n_blocks):
        mine = items.where(F.pmod(F.xxhash64("text"), F.lit(n_blocks)) == b).select("item_id", "text")
        yield benchmark.sparkSession.sparkContext.broadcast([tuple(r) for r in mine.collect()])


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_per_edit: int = CHARS_PER_EDIT,
    short: int = SHORT, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(id, item_id, edits, end): one row per row of ``docs`` and different item text that it holds.

    Both sides are lower-cased with white space collapsed. An item of m characters is held if it occurs with at most
    m / ``chars_per_edit`` edits (insert, delete, replace one character); ``edits`` is the least, ``end`` where the first such
    occurrence ends in the normalised text. Items below ``short`` characters must occur unchanged, with no letter, digit or
    underscore right before or behind them, and one of a single word must be the whole document. Null or empty texts hold
    nothing; null or empty items are never held; of items with equal normalised texts the smallest item_id is given, and
    items without id are left out. Repeated documents give a row each. Texts of any length are searched whole, one at a time.
    Empty tables give no rows. Other columns are not read.

    ``benchmark`` (item_id, text) is taken in blocks of about ``block_bytes``, one pass over the documents each;
    a block is collected and broadcast. Documents are not shuffled.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = [
        rows.mapInArrow(searcher(block, chars_per_edit, short), f"id {kind}, item_id long, edits long, end long")
        for block in blocks(benchmark, block_bytes)
    ]
    return reduce(DataFrame.unionByName, found).withColumnRenamed("id", id_col)


def clean_test(block, chars_per_edit: int, short: int):
    @F.pandas_udf("boolean")
    def clean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        search = Searcher(block.value, chars_per_edit, short)
        for texts in parts:
            yield pd.Series([next(search.matches(t), None) is None for t in texts], dtype=bool)

    return clean


def clean_documents(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", chars_per_edit: int = CHARS_PER_EDIT, short: int = SHORT,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of ``docs`` in which :func:`contaminated` finds no item, with all their columns; nothing is shuffled. Items
    without id count too."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(-1)).alias("item_id"), "text")
    for block in blocks(items, block_bytes):
        docs = docs.where(clean_test(block, chars_per_edit, short)(F.col(text_col).cast("string")))
    return docs
