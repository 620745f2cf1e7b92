"""Token counts by section: whole documents are encoded once, and tokens are attributed by their spans."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import by_value

by_value(__name__)

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before merges, for this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("first", "last", "largest")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


def section_bounds(raw: bytes) -> np.ndarray:
    """Byte offsets 0 < ... < n at which sections end: a section is a line with its \\n."""
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    return ends if len(ends) and ends[-1] == len(raw) else np.append(ends, len(raw))


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """(tokens per section, tokens that cross a boundary) for token spans [start, end) over sections that end at ``bounds``.

    A token inside one section counts there. A crossing token counts whole, once: ``first``: where it starts;
    ``last``: where it ends; ``largest``: in the section that holds most of its bytes, the earliest of equals.
    """
    low = np.searchsorted(bounds, starts, side="right")
    high = np.searchsorted(bounds, ends - 1, side="right")
    crossing = np.flatnonzero(high > low)
    home = high.copy() if rule == "last" else low.copy()
    if rule == "largest" and len(crossing):
        # interval join of crossing tokens and the sections they touch
        width = (high - low)[crossing] + 1
        token = np.repeat(crossing, width)
        section = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + low[token]
        begin = np.where(section > 0, bounds[section - 1], 0)
        share = np.minimum(ends[token], bounds[section]) - np.maximum(starts[token], begin)
        order = np.lexsort((section, -share, token))
        best = order[np.append(True, token[order][1:] != token[order][:-1])]
        home[token[best]] = section[best]
    return np.bincount(home, minlength=len(bounds)), len(crossing)


def counter(ranks, rule: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        table = ranks.value
        encoding = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        lengths = np.zeros(max(table.values()) + 1, dtype=np.int64)
        for piece, rank in table.items():
            lengths[rank] = len(piece)
        for batch in batches:
            n_bytes, n_tokens, crossings, counts = [], [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                raw = text.encode()
                ends = np.cumsum(lengths[np.array(encoding.encode_ordinary(text), dtype=np.int64)])
                bounds = section_bounds(raw)
                if not len(ends):
                    each, crossed = np.zeros(len(bounds), np.int64), 0
                else:
                    each, crossed = attribute(np.append(0, ends[:-1]), ends, bounds, rule)
                n_bytes.append(len(raw))
                n_tokens.append(len(ends))
                crossings.append(crossed)
                counts.append(each)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(crossings, pa.int64()),
                pa.array(counts, pa.list_(pa.int64())),
            ], ["id", "n_bytes", "n_tokens", "n_crossing", "section_tokens"])

    return run


def token_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, rule: str = "largest"
) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_tokens, n_sections, n_crossing, section_tokens.

    The whole text is encoded at once by the byte-level vocabulary, so spans follow from the tokens' byte lengths.
    Sections are lines, each with its \\n; ``section_tokens`` has one count per section and sums to ``n_tokens``.
    ``rule`` says where a token that crosses a boundary counts (see :func:`attribute`). A null or empty text
    has one section without tokens. Repeated rows are counted each; empty input gives empty output; other
    columns are not read. The vocabulary (a fixed file) is read by the driver and broadcast.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(
        counter(ranks, rule), f"id {kind}, n_bytes long, n_tokens long, n_crossing long, section_tokens array<long>"
    ).select(F.col("id").alias(id_col), "n_bytes", "n_tokens", F.size("section_tokens").alias("n_sections"), "n_crossing", "section_tokens")
