"""Ranked lexical search by Block-Max MaxScore over an index of many shards.

An index is a table: per shard one row for each term (its postings in compressed blocks, each block with the last document and the
greatest impact it holds) and one head row (the ids of the shard's documents and their length terms). Tasks build shards from
the documents they read, so nothing is shuffled for it. A search takes queries in blocks of bounded size; each shard's
rows for the terms of the block meet in one task, and the shards' short lists are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import ascii_lower, by_value, stored

by_value(__name__)

#: What a term is, and the constants of the score.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UNIT, TF_STEP, LENGTH_STEP, LENGTH_BASE, LENGTH_SHARE = 1_000_000_000, 1000, 8, 10, 90

TOP = 10
SHARD_BYTES = 16 << 20  # text of a shard; a longer document is a shard of its own
BLOCK = 64  # postings a block
QUERY_BYTES = 4 << 20  # text of the queries that are searched at a time

#: Bytes of a text to bytes of terms: A-Z lower-cased, other ASCII that is no letter or digit to a space.
FOLD = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()
ROW = "shard long, term binary, df long, ends array<int>, peaks array<long>, cuts array<int>, data binary, ids array<long>, lengths array<long>"


class Numbers(dict):
    """Numbers new keys in the order they come."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, first byte of each value) in groups of seven bits, low ones first."""
    size = np.ones(len(values), np.int64)
    for bits in (7, 14, 21, 28, 35, 42):
        size += values >= 1 << bits
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        at = np.flatnonzero(size > k)
        out[start[at] + k] = (values[at] >> (7 * k)) & 127 | np.where(size[at] > k + 1, 128, 0)
    return out, start


def from_varints(raw: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(raw < 128)
    first = np.append(0, last[:-1] + 1)
    place = np.arange(len(raw)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), first)


def impacts(tf: np.ndarray, length: np.ndarray) -> np.ndarray:
    return UNIT * tf // (TF_STEP * tf + LENGTH_STEP * length)


def lists(values: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), pa.array(values, kind))


def shard_rows(shard: int, ids: list, words: list[np.ndarray], names: list[bytes], n_docs: int, n_terms: int) -> Iterator[pa.RecordBatch]:
    """The rows of one shard; ``words`` has the term numbers of each document."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    lengths = LENGTH_BASE + np.array([LENGTH_SHARE * int(n) * n_docs // n_terms for n in sizes], dtype=np.int64)
    one = pa.array([shard], pa.int64())
    none = {f: pa.nulls(1, t) for f, t in FIELDS}
    yield pa.RecordBatch.from_pydict(
        none | {"shard": one, "ids": pa.array([ids], pa.list_(pa.int64())), "lengths": pa.array([lengths.tolist()], pa.list_(pa.int64()))}, SCHEMA
    )
    key = np.concatenate(words).astype(np.int64) * len(ids) + np.repeat(np.arange(len(ids)), sizes)
    key, tf = np.unique(key, return_counts=True)
    term, doc = np.divmod(key, len(ids))
    begin = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
    df = np.diff(np.append(begin, len(term)))
    fresh = (np.arange(len(term)) - np.repeat(begin, df)) % BLOCK == 0
    block = np.flatnonzero(fresh)
    gap = doc.copy()
    gap[1:] -= np.where(fresh[1:], 0, doc[:-1])
    raw, place = varints(np.stack([gap, tf], axis=1).ravel())
    place = place[::2]
    first_block = np.searchsorted(block, begin)
    data_at = place[begin]
    blob = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(np.append(data_at, len(raw)).astype(np.int32)), pa.py_buffer(raw)])
    columns = {
        "shard": pa.array(np.full(len(begin), shard)), "term": pa.array([names[i] for i in term[begin].tolist()], pa.binary()), "df": pa.array(df),
        "ends": lists(doc[np.append(block[1:], len(doc)) - 1], first_block, pa.int32()),
        "peaks": lists(np.maximum.reduceat(impacts(tf, lengths[doc]), block), first_block, pa.int64()),
        "cuts": lists(place[block] - np.repeat(data_at, np.diff(np.append(first_block, len(block)))), first_block, pa.int32()),
        "data": blob, "ids": pa.nulls(len(begin), pa.list_(pa.int64())), "lengths": pa.nulls(len(begin), pa.list_(pa.int64())),
    }
    rows = pa.RecordBatch.from_pydict(columns, SCHEMA)
    yield from (rows.slice(i, 10000) for i in range(0, rows.num_rows, 10000))


FIELDS = [("shard", pa.int64()), ("term", pa.binary()), ("df", pa.int64()), ("ends", pa.list_(pa.int32())), ("peaks", pa.list_(pa.int64())),
          ("cuts", pa.list_(pa.int32())), ("data", pa.binary()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))]
SCHEMA = pa.schema(FIELDS)


def index_builder(n_docs: int, n_terms: int, shard_bytes: int):
    """id, text -> rows of the index; documents without a term are left out, for no query finds them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() << 32
        ids, words, numbers, held = [], [], Numbers(), 0
        for batch in batches:
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = (text.as_py() or "").encode()
                found = raw.translate(FOLD).split()
                if not found:
                    continue
                if held and held + len(raw) > shard_bytes:
                    yield from shard_rows(shard, ids, words, list(numbers), n_docs, n_terms)
                    shard, ids, words, numbers, held = shard + 1, [], [], Numbers(), 0
                ids.append(id_)
                words.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
                held += len(raw)
        if ids:
            yield from shard_rows(shard, ids, words, list(numbers), n_docs, n_terms)

    return run


def term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text -> n_docs (with a term), n_terms."""
    for batch in batches:
        found = [len((text.as_py() or "").encode().translate(FOLD).split()) for text in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array([sum(n > 0 for n in found)], pa.int64()), pa.array([sum(found)], pa.int64())], ["n_docs", "n_terms"])


@dataclass
class Index:
    rows: DataFrame
    n_docs: int


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> Index:
    """The index of all rows of ``docs``, written to the shared folder; ids are integers."""
    counts = docs.select(F.col(text_col).cast("string")).mapInArrow(term_counts, "n_docs long, n_terms long")
    totals = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_docs", "n_terms"))).first()
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        index_builder(totals.n_docs, max(1, totals.n_terms), shard_bytes), ROW
    )
    return Index(stored(rows, "lexical-index"), totals.n_docs)


@dataclass
class Postings:
    """One term's postings in one shard; a block is decompressed when it is first needed."""

    ends: np.ndarray
    peaks: np.ndarray
    cuts: np.ndarray
    data: np.ndarray
    lengths: np.ndarray
    ready: dict = field(default_factory=dict)

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        if b not in self.ready:
            stop = self.cuts[b + 1] if b + 1 < len(self.cuts) else len(self.data)
            gap, tf = from_varints(self.data[self.cuts[b]:stop]).reshape(-1, 2).T
            doc = np.cumsum(gap)
            self.ready[b] = doc, impacts(tf, self.lengths[doc])
        return self.ready[b]

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.ends) == 1:
            return self.block(0)
        if -1 not in self.ready:
            docs, values = zip(*(self.block(b) for b in range(len(self.ends))))
            self.ready[-1] = np.concatenate(docs), np.concatenate(values)
        return self.ready[-1]

    def peaks_at(self, docs: np.ndarray) -> np.ndarray:
        """Upper bound of the impact for each document, from its block alone."""
        b = np.searchsorted(self.ends, docs)
        return np.where(b < len(self.ends), self.peaks[np.minimum(b, len(self.ends) - 1)], 0)

    def values_at(self, docs: np.ndarray) -> np.ndarray:
        """Impacts for ascending documents, 0 where the term is absent; reads their blocks only."""
        out = np.zeros(len(docs), np.int64)
        at = np.searchsorted(self.ends, docs)
        for b in np.unique(at[at < len(self.ends)]).tolist():
            lo, hi = np.searchsorted(at, [b, b + 1])
            own, values = self.block(b)
            place = np.minimum(np.searchsorted(own, docs[lo:hi]), len(own) - 1)
            out[lo:hi] = np.where(own[place] == docs[lo:hi], values[place], 0)
        return out


def kth(values: np.ndarray, k: int) -> int:
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else 1


def best_of_shard(terms: list[tuple[int, Postings]], n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the shard that may be among the k best for a query; terms are (weight, postings).

    Lists are taken by falling bound (weight times greatest impact). They are essential, and read whole, while what follows
    could still lift an unseen document to the k-th best score so far. In the other lists only known candidates
    are looked up, and those go first that the maxima of their blocks cannot lift that far.
    """
    terms = sorted(((w * int(p.peaks.max()), w, p) for w, p in terms), key=lambda x: -x[0])
    rest = np.append(np.cumsum([b for b, _, _ in terms][::-1])[::-1], 0)
    scores, least, i = np.zeros(n_docs, np.int64), 1, 0
    seen = np.zeros(0, np.int64)
    while i < len(terms) and rest[i] >= least:
        _, w, p = terms[i]
        docs, values = p.all()
        scores[docs] += w * values
        seen = np.flatnonzero(scores) if len(docs) > 64 else np.union1d(seen, docs)
        least = max(least, kth(scores[seen], k))
        i += 1
    docs = seen[scores[seen] + rest[i] >= least]
    got = scores[docs]
    others = terms[i:]
    if others and len(docs):
        peaks = np.stack([w * p.peaks_at(docs) for _, w, p in others])
        ahead = np.cumsum(peaks[::-1], axis=0)[::-1]  # from this list on
        for j, (_, w, p) in enumerate(others):
            keep = got + ahead[j] >= least
            docs, got, ahead, peaks = docs[keep], got[keep], ahead[:, keep], peaks[:, keep]
            near = np.flatnonzero(peaks[j])
            got[near] += w * p.values_at(docs[near])
            least = max(least, kth(got, k))
    keep = got >= least
    return docs[keep], got[keep]


def shard_searcher(queries: list[tuple[int, list[tuple[int, int]]]], k: int):
    """Rows of one shard (with the number of their term) -> q, doc_id, score: the best k of each query."""
    def run(table: pa.Table) -> pa.Table:
        head, found = None, {}
        for batch in table.to_batches():
            terms = batch.column("n").to_pylist()
            for i, n in enumerate(terms):
                if n is None:
                    head = batch.column("ids")[i].as_py(), batch.column("lengths")[i].values.to_numpy()
                else:
                    found[n] = [batch.column(c)[i].values.to_numpy() for c in ("ends", "peaks", "cuts")], np.frombuffer(batch.column("data")[i].as_buffer(), np.uint8)
        ids, lengths = head
        postings = {n: Postings(*arrays, data, lengths) for n, (arrays, data) in found.items()}
        last = np.iinfo(np.int64).max
        keys = np.array([last if x is None else x for x in ids], dtype=np.int64)
        out = []
        for q, terms in queries:
            own = [(w, postings[n]) for n, w in terms if n in postings]
            if not own:
                continue
            docs, scores = best_of_shard(own, len(ids), k)
            for j in np.lexsort((keys[docs], -scores))[:k].tolist():
                out.append((q, ids[int(docs[j])], int(scores[j])))
        return pa.table({n: pa.array([r[i] for r in out], pa.int64()) for i, n in enumerate(["q", "doc_id", "score"])})

    return run


def search_block(index: Index, terms: DataFrame, k: int) -> DataFrame:
    """(q, rank, doc_id, score) for queries of bounded size; ``terms`` is (q, term), a query's terms once each."""
    spark = terms.sparkSession
    numbers = Numbers()
    asked: dict[int, list[int]] = {}
    for q, term in terms.collect():  # a block of queries: QUERY_BYTES of text
        asked.setdefault(q, []).append(numbers[bytes(term)])
    words = F.broadcast(spark.createDataFrame([(bytearray(t), n) for t, n in numbers.items()], "term binary, n long"))
    hits = index.rows.where("term IS NOT NULL").join(words, "term")
    df = dict(hits.groupBy("n").agg(F.sum("df")).collect())
    weight = {n: math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * d + 1))) for n, d in df.items()}
    queries = [(q, [(n, weight[n]) for n in own if weight.get(n, 0) > 0]) for q, own in asked.items()]
    columns = ["shard", "n", "ends", "peaks", "cuts", "data", "ids", "lengths"]
    heads = index.rows.where("term IS NULL").withColumn("n", F.lit(None).cast("long"))
    # the work of a shard is in its search, not in its bytes, so that shards are not packed into a few tasks
    rows = hits.select(columns).unionByName(heads.select(columns)).repartition(max(1, heads.count()), "shard")
    best = rows.groupBy("shard").applyInArrow(shard_searcher(queries, k), "q long, doc_id long, score long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(
    index: Index, queries: DataFrame, query_id: str = "item_id", text_col: str = "text", k: int = TOP, query_bytes: int = QUERY_BYTES
) -> DataFrame:
    """(query id, rank, doc_id, score): the ``k`` best documents of each row of ``queries`` with a score above 0.

    Terms are the maximal matches of ``TERM`` with A-Z lower-cased, a query's terms count once each; null and empty texts have
    none and find nothing. Equal scores come by ascending doc_id, null last. Rows that repeat an id, in the queries or in the
    documents, each count as their own. Empty tables give no rows; other columns are not read.
    Texts of any length are read whole; a document longer than a shard is a shard of its own.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    numbered = stored(queries.select(F.monotonically_increasing_id().alias("q"), F.col(query_id).alias("id"), text.alias("text")), "lexical-queries")
    size = numbered.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_blocks = size // query_bytes + 1
    terms = numbered.select("q", F.explode(F.array_distinct(F.regexp_extract_all(ascii_lower("text"), F.lit(TERM), F.lit(0)))).alias("t"))
    terms = terms.select("q", F.encode("t", "UTF-8").alias("term"))
    found = None
    for b in range(n_blocks):
        own = terms.where(F.pmod(F.xxhash64("q"), F.lit(n_blocks)) == b)
        part = stored(search_block(index, own, k), "lexical-found")
        found = part if found is None else found.unionByName(part)
    return numbered.select("q", F.col("id").alias(query_id)).join(found, "q").select(query_id, "rank", "doc_id", "score")
