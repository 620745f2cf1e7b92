"""Language-model scoring by a hierarchical Pitman-Yor model, seated by Gibbs sampling.

A context of words is a restaurant: the tokens that follow it are customers, each table serves one word, and every table
is a customer of the parent restaurant, whose context is one word shorter. Contexts that share their last words
share that parent; the root has no context and the uniform distribution above it. P(w | context) is
(c - d t + (s + d T) P(w | parent)) / (s + C), for c customers at t tables of the word, C and T of the restaurant.

Tokens are dealt to shards by their last context word, so a shard holds whole branches below the root and samples them in
itself. The root is common to all shards; it is sampled between two rounds:

1. Each shard seats the contexts of one word and reports its tables by word: the customers of the root, which is seated in
   parts of the words.
2. Each shard gets the root's probabilities of its words, seats all its restaurants from the longest contexts up, averages the
   predictive probabilities over several states of the sampler, and scores the tokens of all documents.

A context word with more than an eighth of the tokens that a shard should hold is dealt by the word before it too; each such
part has a restaurant of its own below the root. Rows are packed: one per chunk of documents and shard, words as hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import by_value, stored

by_value(__name__)

ORDER = 3  # words of an n-gram
SHARD_TOKENS, CHUNK_TOKENS = 1_200_000, 4_000_000
PART_OF_SHARD = 8  # a context word with more than this part of a shard's tokens is dealt, so that shards are even
ROOT_SWEEPS, BURN_IN, SAMPLES = 3, 2, 3
COMMON = 1 << 17  # words that have a number of their own in all packed rows; others come with their hashes
SLOTS = 10  # customers of a word are moved in so many groups, at most one in ten at a time
DISCOUNTS, STRENGTH = (0.6, 0.75, 0.85), 1.0  # root, one word of context, two or more
KEPT = np.uint64(2**48 - 1)  # of a hash; words are told apart within a shard, that is among few millions, and in the root
END, START = np.uint64(0x5C0DE5ED0001), np.uint64(0x5C0DE5ED0002)  # in place of word hashes
BASE = 0x9E3779B97F4A7C15
PIECE = 1 << 20  # bytes of text that are hashed at a time
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
STREAM = "shard long, chunk long, hashes binary, columns array<binary>"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def packed(values: np.ndarray) -> bytes:
    """Whole numbers below 2^31, byte by byte of all, compressed."""
    import zstandard

    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(raw: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


@dataclass
class Chunk:
    """Documents read together. ``tokens`` number the chunk's words; 0 is the end, 1 stands before the first word."""

    number: int
    ids: list
    held: np.ndarray
    sizes: np.ndarray
    tokens: np.ndarray
    hashes: np.ndarray


def word_hashes(raw: bytes, up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first bytes, hashes) of the words of ``raw``: a polynomial of each word's bytes, from running sums, mixed."""
    data = np.frombuffer(raw, np.uint8)
    inside = np.concatenate([[False], ~SPACE[data], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    first, end = edge[::2], edge[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=sums[1:])
    return first, mixed((sums[end] - sums[first]) * down[first] + (end - first).astype(np.uint64))


def chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[Chunk]:
    """id, held, text -> chunks of about ``limit`` tokens; a document is never cut."""
    from pyspark import TaskContext

    number, ids, held, sizes, parts, total = TaskContext.get().partitionId() << 32, [], [], [], [], 0
    up, down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def chunk() -> Chunk:
        tokens, words = pd.factorize(np.concatenate(parts))
        size = np.array(sizes) + 1  # the end of each document comes behind its words
        ends = np.cumsum(size) - 1
        own = np.ones(int(size.sum()), bool)
        own[ends] = False
        full = np.zeros(len(own), np.int32)
        full[own] = tokens + 2
        return Chunk(number, ids, np.array(held, dtype=bool), size, full, np.append([END, START], words & KEPT))

    for batch in batches:
        texts, known = batch.column(2), zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        at = 0
        while at < len(texts):  # as many texts as make up a piece, or one longer text
            raws, size = [], 0
            while at < len(texts) and (not raws or size < PIECE):
                raws.append((texts[at].as_py() or "").encode().lower())
                size += len(raws[-1]) + 1
                at += 1
            if len(up) < size:
                up, down = (np.cumprod(np.append(np.ones(1, np.uint64), np.full(size, x, np.uint64))) for x in (BASE, pow(BASE, -1, 1 << 64)))
            first, hashes = word_hashes(b"\n".join(raws), up, down)
            starts = np.cumsum([0] + [len(r) + 1 for r in raws])
            cuts = np.searchsorted(first, starts)
            for i, (id_, out) in zip(range(len(raws)), known):
                ids.append(id_)
                held.append(out)
                parts.append(hashes[cuts[i]:cuts[i + 1]])
                sizes.append(len(parts[-1]))
                total += len(parts[-1]) + 1
                if total >= limit:
                    yield chunk()
                    number, ids, held, sizes, parts, total = number + 1, [], [], [], [], 0
    if ids:
        yield chunk()


def counter(limit: int, id_kind: pa.DataType):
    """Per chunk and word: hash, train, total (occurrences); per document: place, id, held, n_tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("chunk", pa.int64()), ("hash", pa.int64()), ("train", pa.int64()), ("total", pa.int64()), ("place", pa.int64()), ("id", id_kind),
                 ("held", pa.bool_()), ("n_tokens", pa.int64())]
        for c in chunks(batches, limit):
            train = np.bincount(c.tokens[np.repeat(~c.held, c.sizes)], minlength=len(c.hashes))
            total = np.bincount(c.tokens, minlength=len(c.hashes))
            seen = np.flatnonzero(total)
            words = {"hash": c.hashes[seen].view(np.int64), "train": train[seen], "total": total[seen]}
            docs = {"place": np.arange(len(c.ids)), "id": c.ids, "held": c.held, "n_tokens": c.sizes}
            for columns, n in ((words, len(seen)), (docs, len(c.ids))):
                full = {"chunk": np.full(n, c.number)} | columns
                batch = pa.RecordBatch.from_arrays([pa.array(full[k], t) if k in full else pa.nulls(n, t) for k, t in kinds], [k for k, _ in kinds])
                yield from (batch.slice(i, 10000) for i in range(0, n, 10000))

    return run


@dataclass
class Plan:
    """What all tasks know: numbers of shards, and the words with more tokens than a shard should hold (sorted hashes)."""

    order: int
    n_shards: int
    n_words: int
    n_tokens: int
    hot: np.ndarray
    hot_parts: np.ndarray
    hot_train: np.ndarray
    common: np.ndarray  # sorted hashes
    common_rank: np.ndarray

    def lookup(self, hashes: np.ndarray, values: np.ndarray, default: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.hot, hashes), max(len(self.hot) - 1, 0))
        known = self.hot[at] == hashes if len(self.hot) else np.zeros(len(hashes), bool)
        return known, np.where(known, values[at] if len(self.hot) else default, default)


def contexts(chunk: Chunk, order: int) -> list[np.ndarray]:
    """The words before each token, the nearest first."""
    starts, out, last = np.cumsum(chunk.sizes) - chunk.sizes, [], chunk.tokens
    for _ in range(order - 1):
        before = np.empty_like(last)
        before[1:] = last[:-1]
        before[starts] = 1
        out.append(before)
        last = before
    return out


def shards_of(chunk: Chunk, plan: Plan) -> tuple[list[np.ndarray], np.ndarray]:
    before = contexts(chunk, max(plan.order, 3))
    _, parts = plan.lookup(chunk.hashes, plan.hot_parts, 1)
    part = mixed(chunk.hashes)[before[1]] % parts[before[0]].astype(np.uint64)
    shard = mixed(chunk.hashes[before[0]] + part * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(plan.n_shards)
    return before[:plan.order - 1], shard.astype(np.int64)


def stream_rows(chunk: Chunk, plan: Plan, shard: np.ndarray, words: list[np.ndarray], numbers: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """One row per shard: columns of words (the rank of a common one, or behind these the place of its hash in the row's list) and columns
    of plain numbers. Sorted by shard."""
    cut = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else np.zeros(0, np.int64)
    n = len(plan.common)
    at = np.minimum(np.searchsorted(plan.common, chunk.hashes), max(n - 1, 0))
    common = plan.common[at] == chunk.hashes if n else np.zeros(len(chunk.hashes), bool)
    place = np.where(common, plan.common_rank[at] if n else 0, 0).astype(np.int64)
    for a, b in zip(cut.tolist(), np.append(cut[1:], len(shard)).tolist()):
        used = np.zeros(len(chunk.hashes), bool)
        for column in words:
            used[column[a:b]] = True
        own = np.flatnonzero(used & ~common)
        place[own] = n + np.arange(len(own))
        columns = [packed(place[c[a:b]]) for c in words] + [packed(c[a:b]) for c in numbers]
        raw = np.ascontiguousarray(chunk.hashes[own]).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(shard[a])]), pa.array([chunk.number]), pa.array([raw.tobytes()], pa.binary()), pa.array([columns], pa.list_(pa.binary()))],
            ["shard", "chunk", "hashes", "columns"],
        )


def pair_stream(plan: Plan, limit: int):
    """Distinct pairs of words of a chunk, with their number of occurrences in training documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches, limit):
            before, shard = shards_of(c, plan)
            size = len(c.hashes)
            key, inverse = np.unique((shard * size + before[0]) * size + c.tokens, return_inverse=True)
            count = np.bincount(inverse, weights=np.repeat(~c.held, c.sizes), minlength=len(key))
            rest, word = np.divmod(key, size)
            shard, last = np.divmod(rest, size)
            yield from stream_rows(c, plan, shard, [word, last], [count])

    return run


def token_stream(plan: Plan, limit: int):
    """All tokens of a chunk with their contexts and documents (twice the place, plus 1 if held out)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches, limit):
            before, shard = shards_of(c, plan)
            doc = np.repeat(np.arange(len(c.ids)) * 2 + c.held, c.sizes)
            order = np.argsort((shard * len(c.hashes) + before[0]) * len(c.hashes) + before[-1], kind="stable")
            yield from stream_rows(c, plan, shard[order], [w[order] for w in (c.tokens, *before)], [doc[order]])

    return run


class Seating:
    """The tables of all restaurants of one length of context, as far as one task holds them.

    A cell is a word in a restaurant: ``rest`` names its restaurant, ``c`` counts its customers, ``t`` its tables; ``tables``
    are a restaurant's tables. Customers of cells with three or more are seated one by one: ``z`` is a customer's table, named by
    one of the customers at it. Two customers sit together or apart, so ``t`` says it all.
    """

    def __init__(self, rest: np.ndarray, discount: float, strength: float, rng: np.random.Generator, share: float = 1.0):
        self.rest, self.d, self.s, self.rng, self.share = rest.astype(np.int32), discount, strength, rng, share
        self.n_rest = int(rest.max(initial=-1)) + 1
        self.c = np.zeros(len(rest), np.int32)
        self.first = np.zeros(len(rest), np.int32)  # of a cell's customers
        self.z = np.zeros(0, np.int32)
        self.t = np.zeros(len(rest), np.int32)

    def receive(self, c: np.ndarray) -> None:
        """Change the numbers of customers: some of a cell leave, or new ones sit down with the others for the time being."""
        c = c.astype(np.int32)
        many = np.flatnonzero(c >= 3).astype(np.int32)
        size = c[many]
        n = int(size.sum())
        first = np.zeros(len(c), np.int32)
        first[many] = np.cumsum(size) - size
        cell = np.repeat(many, size)
        place = np.arange(n, dtype=np.int32) - first[cell]
        seated = np.where(self.c >= 3, self.c, 0)
        stay = np.minimum(seated, c)[cell]
        turn = (self.rng.random(len(c)) * seated).astype(np.int32)
        z = first[cell]  # a cell that was not seated starts at one table
        old = np.flatnonzero(stay > 0)
        own = cell[old]
        source = self.first[own] + (place[old] % stay[old] + turn[own]) % seated[own]
        label = np.zeros(2 * len(self.z) + 1, np.int32)
        table = self.z[source]
        label[table[::-1]] = old[::-1]  # the first customer at a table names it
        z[old] = label[table]
        pair = np.where(self.c == 2, self.t, 1)
        self.c, self.first, self.z, self.cell = c, first, z, cell
        self.two = np.flatnonzero(c == 2)
        slot = ((place + (self.rng.random(len(c)) * SLOTS).astype(np.int32)[cell]) % SLOTS).astype(np.uint8)
        self.groups = np.split(np.argsort(slot, kind="stable").astype(np.int32), np.cumsum(np.bincount(slot, minlength=SLOTS))[:-1])
        self.size = np.bincount(z, minlength=2 * n).astype(np.int32)
        self.t = np.where(c == 2, pair, np.minimum(c, 1)).astype(np.int32)
        self.t[many] = np.bincount(cell[np.flatnonzero(self.size[:n])], minlength=len(c))[many]
        self.tables = np.bincount(self.rest, weights=self.t, minlength=self.n_rest)
        self.customers = np.bincount(self.rest, weights=c, minlength=self.n_rest)

    def settle(self) -> None:
        """Name the tables anew after a sweep, when the numbers of customers stay."""
        n = len(self.z)
        label = np.zeros(2 * n + 1, np.int32)
        label[self.z[::-1]] = np.arange(n, dtype=np.int32)[::-1]
        self.z = label[self.z]
        self.size = np.bincount(self.z, minlength=2 * n).astype(np.int32)

    def sweep(self, parent: np.ndarray) -> None:
        """Gibbs: every customer gets up once and sits down again; ``parent`` has the parent's probability of each cell's word."""
        n, d, seated = len(self.z), self.d, self.c.copy()
        if len(self.two):
            own = self.two
            apart = self.t[own] - 1
            fresh = (self.s + d * (self.tables[self.rest[own]] - apart) / self.share) * parent[own]
            now = self.rng.random(len(own)) * (1 - d + fresh) < fresh
            self.t[own] = 1 + now
            self.tables += np.bincount(self.rest[own], weights=now - apart, minlength=self.n_rest)
        one = np.int32(1)
        for who in self.groups:
            if not len(who):
                continue
            cell = self.cell[who].astype(np.int64)
            left = self.z[who].astype(np.int64)
            np.subtract.at(self.size, left, one)
            np.subtract.at(seated, cell, one)
            gone = np.unique(left[self.size[left] == 0])
            gone = self.cell[gone % n].astype(np.int64)
            np.subtract.at(self.t, gone, one)
            np.subtract.at(self.tables, self.rest[gone].astype(np.int64), 1.0)
            self.z[who] = -1
            fresh = (self.s + d * self.tables[self.rest[cell]] / self.share) * parent[cell]
            joined = seated[cell] - d * self.t[cell]
            opens = self.rng.random(len(who)) * (joined + fresh) < fresh
            opens |= seated[cell] == 0
            table = np.where(opens, n + who, -1).astype(np.int64)
            wait = np.flatnonzero(~opens)
            while len(wait):  # a table by its size less the discount: that of a random customer, kept by that share
                own = cell[wait]
                seen = self.z[self.first[own] + (self.rng.random(len(wait)) * self.c[own]).astype(np.int64)]
                full = self.size[np.maximum(seen, 0)]
                keep = (seen >= 0) & (self.rng.random(len(wait)) * full < full - d)
                table[wait[keep]] = seen[keep]
                wait = wait[~keep]
            np.add.at(self.size, table, one)
            np.add.at(seated, cell, one)
            np.add.at(self.t, cell[opens], one)
            np.add.at(self.tables, self.rest[cell[opens]].astype(np.int64), 1.0)
            self.z[who] = table

    def predict(self, parent: np.ndarray) -> np.ndarray:
        """P of each cell's word in its restaurant."""
        return (self.c - self.d * self.t + (self.s + self.d * self.tables[self.rest]) * parent) / (self.s + self.customers[self.rest])


def discount(level: int) -> float:
    return DISCOUNTS[min(level, len(DISCOUNTS) - 1)]


def six_bytes(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def merged(table: pa.Table, n_words: int, plan: Plan) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, list[int]]:
    """(hashes, columns, row of each entry, chunk of each row); the first ``n_words`` columns number the hashes, common words first."""
    rows = sorted(table.select(["chunk", "hashes", "columns"]).to_pylist(), key=lambda r: r["chunk"])
    raw, n = [six_bytes(r["hashes"]) for r in rows], len(plan.common)
    rare, inverse = np.unique(np.concatenate(raw), return_inverse=True)
    ranked = np.zeros(n, np.uint64)
    ranked[plan.common_rank] = plan.common
    inverse = np.concatenate([inverse.astype(np.int32) + n, np.zeros(1, np.int32)])
    starts = np.cumsum([0] + [len(x) for x in raw])

    def numbered(codes: np.ndarray, start: int) -> np.ndarray:
        return np.where(codes < n, codes, inverse[np.maximum(codes - n, 0) + start])

    parts = [[numbered(unpacked(c), starts[k]) if i < n_words else unpacked(c) for i, c in enumerate(r["columns"])] for k, r in enumerate(rows)]
    columns = [np.concatenate(x) for x in zip(*parts)]
    return np.concatenate([ranked, rare]), columns, np.repeat(np.arange(len(rows)), [len(p[0]) for p in parts]), [r["chunk"] for r in rows]


def in_hash_order(word: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The different words, sorted by hash."""
    own = np.flatnonzero(np.bincount(word, minlength=len(hashes)))
    return own[np.argsort(hashes[own])]


def root_part(hashes: np.ndarray, n_parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(16)) * np.uint64(n_parts)) >> np.uint64(32)


def seat_pairs(plan: Plan, sweeps: int, strength: float, seed: int):
    """Round 1: the words that may follow in this shard, by root part, and the tables that serve each."""
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        hashes, (word, last, count), _, _ = merged(table, 2, plan)
        inverse, key = pd.factorize(last.astype(np.int64) * len(hashes) + word)
        count = np.bincount(inverse, weights=count).astype(np.int64)
        rest, word = np.divmod(key, len(hashes))
        follows = in_hash_order(word, hashes)
        seating = Seating(pd.factorize(rest)[0], discount(1), strength, np.random.default_rng((seed, 1, shard)))
        seating.receive(count)
        for _ in range(sweeps):
            share = np.bincount(word, weights=seating.t, minlength=len(hashes)) + 0.5
            seating.sweep((share / share.sum())[word])
            seating.settle()
        tables = np.bincount(word, weights=seating.t, minlength=len(hashes))[follows]
        own = hashes[follows]
        part = root_part(own, plan.n_shards)
        out = [[], [], [], []]
        for p in np.unique(part):
            mine = part == p
            for held, x in zip(out, (int(p), shard, own[mine].tobytes(), packed(tables[mine]))):
                held.append(x)
        return pa.table([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["part", "shard", "hashes", "tables"])

    return run


def seat_root(plan: Plan, sweeps: int, strength: float, seed: int):
    """A part of the root's words -> for each shard its words' customers and tables; a row without shard has the sums."""
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["shard"])
        raw = [np.frombuffer(r["hashes"], np.uint64) for r in rows]
        hashes, inverse = np.unique(np.concatenate(raw), return_inverse=True)
        count = np.bincount(inverse, weights=np.concatenate([unpacked(r["tables"]) for r in rows])).astype(np.int64)
        part = rows[0]["part"]
        # the parts are alike, so all tables of the root are about as many times those of this part
        seating = Seating(np.zeros(len(hashes), np.int64), discount(0), strength, np.random.default_rng((seed, 2, part)), 1 / plan.n_shards)
        seating.receive(count)
        for _ in range(sweeps):
            seating.sweep(np.full(len(hashes), 1 / (plan.n_words + 1)))
            seating.settle()
        maps = np.split(inverse, np.cumsum([len(x) for x in raw])[:-1])
        out = [[r["shard"] for r in rows] + [None], [part] * (len(rows) + 1), [packed(count[m]) for m in maps] + [None],
               [packed(seating.t[m]) for m in maps] + [None], [None] * len(rows) + [int(count.sum())], [None] * len(rows) + [int(seating.t.sum())]]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        return pa.table([pa.array(x, t) for x, t in zip(out, kinds)], ["shard", "part", "c", "t", "all_c", "all_t"])

    return run


@dataclass
class Levels:
    """Cells of each length of context, the shortest first; ``cell`` has each token's cell, ``parent`` the cell one word shorter."""

    rest: list[np.ndarray]
    parent: list[np.ndarray]
    cell: np.ndarray


def levels_of(word: np.ndarray, before: list[np.ndarray], size: int) -> Levels:
    rest, parent, context, shorter = [], [], np.zeros(len(word), np.int32), word
    for w in before:
        context = pd.factorize(context.astype(np.int64) * size + w)[0].astype(np.int32)
        cell, cells = pd.factorize(context.astype(np.int64) * size + word)
        cell = cell.astype(np.int32)
        up, own = np.zeros(len(cells), np.int32), np.zeros(len(cells), np.int32)
        up[cell], own[cell] = shorter, context
        rest.append(own)
        parent.append(up)
        shorter = cell
    return Levels(rest, parent, shorter)


def averaged(levels: Levels, root: np.ndarray, count: np.ndarray, burn_in: int, samples: int, strength: float, rng: np.random.Generator) -> np.ndarray:
    """Predictive probability of each cell of the longest contexts, averaged over states of the sampler."""
    seats = [Seating(rest, discount(i + 1), strength, rng) for i, rest in enumerate(levels.rest)]

    def rise(i: int) -> None:
        """The tables of one length of context become the customers of the next shorter one."""
        seats[i - 1].receive(np.bincount(levels.parent[i], weights=seats[i].t, minlength=len(levels.rest[i - 1])))

    def predictions() -> list[np.ndarray]:
        out = [root]
        for seat, parent in zip(seats, levels.parent):
            out.append(seat.predict(out[-1][parent]))
        return out

    seats[-1].receive(count)
    for i in range(len(seats) - 1, 0, -1):
        rise(i)
    mean = np.zeros(len(count))
    for step in range(burn_in + samples):
        above = predictions()
        for i in range(len(seats) - 1, -1, -1):
            seats[i].sweep(above[i][levels.parent[i]])
            if i:
                rise(i)
        seats[-1].settle()
        if step >= burn_in:
            mean += predictions()[-1] / samples
    return mean


def score_shard(plan: Plan, root_c: int, root_t: int, burn_in: int, samples: int, strength: float, seed: int):
    """Round 2: tokens of a shard and the root's counts of its words -> per chunk: places of documents, and their sums."""
    def run(tokens: pa.Table, root: pa.Table) -> pa.Table:
        names, kinds = ["chunk", "place", "known", "base", "score"], [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        if not tokens.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names)
        shard = tokens.column("shard")[0].as_py()
        hashes, columns, row, chunk_of = merged(tokens, plan.order, plan)
        word, before, doc = columns[0], columns[1:plan.order], columns[-1]
        parts = sorted(root.to_pylist(), key=lambda r: r["part"])
        c, t = (np.concatenate([unpacked(r[k]) for r in parts]) for k in ("c", "t"))
        follows = in_hash_order(word, hashes)
        top = np.zeros(len(hashes))  # equal words in equal order as in round 1
        top[follows] = (c - discount(0) * t + (strength + discount(0) * root_t) / (plan.n_words + 1)) / (strength + root_c)
        train = doc % 2 == 0
        levels = levels_of(word, before, len(hashes))
        del columns, tokens
        count = np.bincount(levels.cell, weights=train, minlength=len(levels.rest[-1])).astype(np.int64)
        p = averaged(levels, top, count, burn_in, samples, strength, np.random.default_rng((seed, 3, shard)))
        score = np.log10(p)[levels.cell]
        # a word's occurrences are those of the tokens that follow it; for one dealt to several shards they are known
        seen = np.bincount(before[0], weights=train, minlength=len(hashes))
        hot, total = plan.lookup(hashes, plan.hot_train, 0)
        seen = np.where(hot, total, seen)
        real = (hashes != START)[before[0]]
        base = np.where(real, np.log10((seen + 0.5) / (plan.n_tokens + 0.5 * (plan.n_words + 1)))[before[0]], 0)
        known = real & (seen > 0)[before[0]]
        inverse, key = pd.factorize(row * (int(doc.max()) + 2) + doc // 2)
        sums = [np.bincount(inverse, weights=x, minlength=len(key)) for x in (known, base, score)]
        of_row, place = np.divmod(key, int(doc.max()) + 2)
        out = [[], [], [], [], []]
        for r in np.unique(of_row).tolist():
            own = of_row == r
            for held, x in zip(out, (chunk_of[r], packed(place[own]), packed(sums[0][own]), sums[1][own].tobytes(), sums[2][own].tobytes())):
                held.append(x)
        return pa.table([pa.array(x, k) for x, k in zip(out, kinds)], names)

    return run


def total_scores(plan: Plan, end_train: int):
    """Documents of a chunk and their sums by shard -> id, held, n_tokens, n_known, base, score."""
    def run(docs: pa.Table, sums: pa.Table) -> pa.Table:
        n = int(docs.column("place").to_numpy().max()) + 1
        known, base, score = np.full(n, int(end_train > 0)), np.zeros(n), np.zeros(n)
        base += np.log10((end_train + 0.5) / (plan.n_tokens + 0.5 * (plan.n_words + 1)))
        for r in sorted(sums.to_pylist(), key=lambda r: (r["score"], r["base"])):  # an order that does not hang on the shuffle
            place = unpacked(r["place"])
            known[place] += unpacked(r["known"])
            base[place] += np.frombuffer(r["base"])
            score[place] += np.frombuffer(r["score"])
        at = docs.column("place").to_numpy()
        return pa.table([
            docs.column("id"), docs.column("held"), docs.column("n_tokens"), pa.array(known[at]), pa.array(base[at]), pa.array(score[at])
        ], ["id", "held", "n_tokens", "n_known", "base", "score"])

    return run


def log_scores(
    docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, shard_tokens: int = SHARD_TOKENS,
    chunk_tokens: int = CHUNK_TOKENS, root_sweeps: int = ROOT_SWEEPS, burn_in: int = BURN_IN, samples: int = SAMPLES, strength: float = STRENGTH, seed: int = 42,
) -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    ``held_out`` is a boolean column of ``docs``; the model learns from all other rows (null counts as not held out).
    Texts are lower-cased in A-Z; tokens are the words ``[^\\x20\\x09-\\x0D]+`` and one end. ``score`` is the log10 probability of the
    tokens, ``base_score`` that of the smoothed unigram model, ``n_known`` the tokens seen in training, ``train_tokens``
    all training tokens; ``perplexity`` is 10^(-score / n_tokens). Null and empty texts are the end alone. Rows that
    repeat an id, or a text, each count. Texts of any length are read whole, one at a time; an unknown word has the probability that
    the root leaves to a word never seen. Empty input gives empty output; other columns are not read. Seeds are
    fixed by shard, so reruns over the same partitions agree.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    id_kind = spark.createDataFrame([], source.select("id").schema).toArrow().schema.field(0).type
    counts = stored(source.mapInArrow(
        counter(chunk_tokens, id_kind), f"chunk long, hash long, train long, total long, place long, id {kind}, held boolean, n_tokens long"
    ), "lm-counts")
    words = stored(counts.where("hash IS NOT NULL").groupBy("hash").agg(F.sum("train").alias("train"), F.sum("total").alias("total")), "lm-words")
    n_words, n_tokens, total = words.agg(F.count_if(F.col("train") > 0), F.coalesce(F.sum("train"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    # fewer than 65,536 words can have that many tokens
    limit = max(shard_tokens // PART_OF_SHARD, total >> 16)
    hot = sorted((h % (1 << 64), train, -(-all_ // limit)) for h, train, all_ in words.where(F.col("total") > limit).collect())
    top = words.orderBy(F.desc("total"), "hash").limit(COMMON).select("hash").toArrow().column("hash").to_numpy().astype(np.uint64)
    by_hash = np.argsort(top)
    plan = Plan(
        order, max(1, -(-total // shard_tokens)), n_words, n_tokens,
        *(np.array([r[i] for r in hot], dtype=t) for i, t in ((0, np.uint64), (2, np.int64), (1, np.int64))), top[by_hash], by_hash.astype(np.int32),
    )
    end_train = counts.where(F.col("place").isNotNull() & ~F.col("held")).count()
    pairs = source.mapInArrow(pair_stream(plan, chunk_tokens), STREAM)
    asked = pairs.groupBy("shard").applyInArrow(seat_pairs(plan, root_sweeps, strength, seed), "part long, shard long, hashes binary, tables binary")
    root = stored(asked.groupBy("part").applyInArrow(
        seat_root(plan, root_sweeps, strength, seed), "shard long, part long, c binary, t binary, all_c long, all_t long"
    ), "lm-root")
    root_c, root_t = root.agg(F.coalesce(F.sum("all_c"), F.lit(0)), F.coalesce(F.sum("all_t"), F.lit(0))).first()
    tokens = source.mapInArrow(token_stream(plan, chunk_tokens), STREAM)
    shares = root.where("shard IS NOT NULL").select("shard", "part", "c", "t")
    sums = tokens.groupBy("shard").cogroup(shares.groupBy("shard")).applyInArrow(
        score_shard(plan, root_c, root_t, burn_in, samples, strength, seed), "chunk long, place binary, known binary, base binary, score binary"
    )
    rows = counts.where("place IS NOT NULL").select("chunk", "place", "id", "held", "n_tokens")
    scored = rows.groupBy("chunk").cogroup(sums.groupBy("chunk")).applyInArrow(
        total_scores(plan, end_train), f"id {kind}, held boolean, n_tokens long, n_known long, base double, score double"
    )
    return scored.select(
        F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
