"""Language model, hard negatives and lexical search against plain Python, with edge rows."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import hard_negatives, language_model, lexical_search, queries
from fleetlens.llm.common import table
from tests.oracle import DATA

CLASH = ["q", "uid", "id", "label2", "leaf", "slice", "chunk", "low", "high", "score", "rank", "term", "shard", "df", "n", "held", "place", "word", "hash", "train", "c", "t"]


def with_clashes(df):
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASH])


# --- hard negatives


def brute_negatives(rows, every):
    out = Counter()
    points = []
    for id_, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        points.append((id_, [math.floor(256 * x) for x in v], (label + 1) % 10 if id_ is not None and id_ % 7 == 0 else label))
    order = lambda x: (-x[1], x[0] is None, x[0] or 0)
    for i, (a_id, a, a_label) in enumerate(points):
        if a_id is None or a_id % every:
            continue
        scored = [(id_, sum(x * y for x, y in zip(a, q)), label) for j, (id_, q, label) in enumerate(points) if j != i]
        for p_id, p, _ in sorted((r for r in scored if r[2] == a_label), key=order)[:5]:
            window = [r for r in scored if r[2] != a_label and 80 * p <= 100 * r[1] <= 100 * p]
            for rank, (n_id, n, _) in enumerate(sorted(window, key=order)[:5], 1):
                out[(a_id, p_id, rank, n_id, p, n)] += 1
    return out


def vectors(kind, n=400, width=6):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, width))
    x = centres[rng.integers(0, 8, n)] + rng.normal(scale=0.05, size=(n, width)) if kind == "clusters" else rng.normal(size=(n, width)).round(1)
    return [(i, [float(v) for v in x[i]], int(rng.integers(0, 3))) for i in range(n)]


EDGES = [
    (500, [1.0, 2.0], 1), (500, [1.0, 2.0], 1), (500, [2.0, 1.0], 1), (None, [1.0] * 6, 1), (None, [1.0] * 6, 0), (600, None, 1), (601, [1.0] * 6, None),
    (602, [1.0, None, 0.0], 1), (603, [float("nan")] * 6, 1), (604, [float("inf")] + [0.0] * 5, 2), (700, [], 2), (701, [0.0] * 6, 2), (800, [-1.0] * 6, 9),
    *[(900 + i, [0.5] * 6, i % 2) for i in range(40)],
]


@pytest.mark.parametrize("kind", ["clusters", "ties"])
@pytest.mark.parametrize("size", [8, 2048])
def test_hard_negatives(spark, kind, size):
    rows = vectors(kind) + EDGES
    df = with_clashes(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    got = hard_negatives.hard_negatives(df, anchor_every=20, leaf_rows=size, fanout=4, chunk=3)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute_negatives(single, 20)
    assert Counter(tuple(r) for r in got.collect()) == want and len(want) > 50


def test_hard_negatives_empty(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert hard_negatives.hard_negatives(spark.createDataFrame([], kind)).count() == 0
    assert hard_negatives.hard_negatives(spark.createDataFrame([(0, [1.0], 1)], kind)).count() == 0
    assert hard_negatives.hard_negatives(spark.createDataFrame([(0, None, 1), (None, [1.0], None)], kind)).count() == 0
    with pytest.raises(ValueError):
        hard_negatives.hard_negatives(spark.createDataFrame([(0, [1e6] * 4, 1), (1, [1e6] * 4, 1)], kind)).count()


def test_ranges_leave_leaves_out():
    rng = np.random.default_rng(1)
    x = np.floor(256 * (rng.normal(size=(8, 5))[rng.integers(0, 8, 3000)] + rng.normal(scale=0.02, size=(3000, 5)))).astype(np.int32)
    largest = int((x.astype(np.int64) ** 2).sum(axis=1).max())
    nodes, n_leaves = hard_negatives.grow(hard_negatives.lifted(x[:500], largest), 2, 4)
    lifted = hard_negatives.lifted(x, largest)
    for node in nodes:
        node.low, node.high = (np.full((len(node.points),) * 2, s * np.inf) for s in (1, -1))
    for node, _, d, part in hard_negatives.descend(nodes, lifted):
        for j in np.unique(part):
            node.low[:, j], node.high[:, j] = d[part == j].min(axis=0), d[part == j].max(axis=0)
    leaf = hard_negatives.leaves_of(nodes, lifted)
    a, scores = x[:50], x[:50].astype(np.int64) @ x.T.astype(np.int64)
    high = scores.max(axis=1).astype(float)
    met = hard_negatives.met_leaves(nodes, n_leaves, a, largest, 0.9 * high, high)
    inside = (scores >= 0.9 * high[:, None]) & (scores <= high[:, None])
    for i in range(50):
        assert set(leaf[inside[i]]) <= set(np.flatnonzero(met[i]))
    assert met.mean() < 0.6


# --- lexical search


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(docs, items, k=10):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    total, n = sum(sum(b.values()) for _, b in bags), len(bags)
    df = Counter(t for _, b in bags for t in b)
    out = Counter()
    for item, text in items:
        found = []
        for i, b in bags:
            m = 10 + 90 * sum(b.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in set(terms(text)) if b[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        for rank, (score, _, _, i) in enumerate(sorted(found)[:k], 1):
            out[(item, rank, i, -score)] += 1
    return out


WORDS = [f"w{i}" for i in range(60)]
DOCS = [(i, " ".join(WORDS[(i * j * j + j) % (5 + i % 50)] for j in range(i % 40 + 1))) for i in range(300)] + [
    (None, "w1 w2 w3"), (None, "w1 w2 w3"), (7, "W1 W2 w3"), (7, "w1 w2 w3"), (301, None), (302, ""), (303, "--- !!"), (304, "Größe größe ÄÖ w1"), (305, "w1,w2;W3_w4"),
    (306, " ".join(WORDS[i * 7 % 60] for i in range(50000))), (307, "only\x00here once"), (308, "w1 " * 3000),
]
ITEMS = [(1, "w1 w2 w3"), (1, "w1 w2 w3"), (2, "W1 w1, w1!"), (None, "w5 w6"), (3, None), (4, ""), (5, "nowhere to be found"), (6, "größe"), (7, " ".join(WORDS)), (8, "once w4 HERE")]


@pytest.mark.parametrize("shard_bytes,query_bytes", [(1 << 24, 1 << 22), (300, 20)])
def test_search(spark, shard_bytes, query_bytes):
    docs = with_clashes(spark.createDataFrame(DOCS, "doc_id long, text string"))
    items = with_clashes(spark.createDataFrame(ITEMS, "item_id long, text string"))
    got = lexical_search.search(lexical_search.build_index(docs, shard_bytes=shard_bytes), items, query_bytes=query_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(r) for r in got.collect()) == brute_search(DOCS, ITEMS)


def test_search_empty(spark):
    no_docs, no_items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical_search.search(lexical_search.build_index(no_docs), items).count() == 0
    assert lexical_search.search(lexical_search.build_index(spark.createDataFrame([(1, None)], no_docs.schema)), items).count() == 0
    assert lexical_search.search(lexical_search.build_index(spark.createDataFrame(DOCS, no_docs.schema)), no_items).count() == 0


def test_varints():
    values = np.array([0, 1, 127, 128, 16383, 16384, 1 << 21, 1 << 28, 1 << 35, 5], dtype=np.int64)
    raw, start = lexical_search.varints(values)
    assert lexical_search.from_varints(raw).tolist() == values.tolist() and start[:4].tolist() == [0, 1, 2, 3]


def test_blocks_that_cannot_help_stay_compressed():
    rng = np.random.default_rng(2)
    lengths = np.full(20000, 100, dtype=np.int64)

    def postings(docs, tf):
        starts = np.arange(0, len(docs), lexical_search.BLOCK)
        gap = docs.copy()
        gap[1:] -= np.where(np.arange(1, len(docs)) % lexical_search.BLOCK == 0, 0, docs[:-1])
        raw, place = lexical_search.varints(np.stack([gap, tf], axis=1).ravel())
        values = lexical_search.impacts(tf, lengths[docs])
        return lexical_search.Postings(
            docs[np.append(starts[1:], len(docs)) - 1], np.maximum.reduceat(values, starts), place[::2][starts], raw, lengths
        ), dict(zip(docs.tolist(), values.tolist()))

    rare, rare_values = postings(np.sort(rng.choice(20000, 30, replace=False)), rng.integers(1, 9, 30))
    common, common_values = postings(np.arange(20000), rng.integers(1, 3, 20000))
    docs, scores = lexical_search.best_of_shard([(6000, rare), (2, common)], 20000, 10)
    want = sorted(((6000 * rare_values.get(d, 0) + 2 * v, -d) for d, v in common_values.items()), reverse=True)[:10]
    assert sorted(zip(scores.tolist(), (-docs).tolist()), reverse=True)[:10] == want
    assert len(common.ready) < 20  # of 313 blocks


# --- language model


def corpus(rows):
    return [(i, re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split()) for i, t in rows]


TEXTS = [(i, " ".join(WORDS[(i % 7 + j * (j + i % 5)) % 30] for j in range(i % 60))) for i in range(200)] + [
    (200, None), (201, ""), (202, "  \t\n"), (203, "w1 unknownword w2"), (203, "w1 unknownword w2"), (None, "w1 w2 w3"), (None, None), (204, "W1 W2\x0bW3"),
    (205, " ".join(WORDS[j * 7 % 60] for j in range(30000))), (206, "w1 " * 5000), (207, "é   ü x"),
]


def out_of(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def scored(spark, rows, **options):
    df = with_clashes(spark.createDataFrame(rows, "doc_id long, text string")).drop("held")
    return language_model.log_scores(df, F.crc32(F.col("doc_id").cast("string")) % 5 == 1, **options)


@pytest.mark.parametrize("options", [{}, {"shard_tokens": 3000, "chunk_tokens": 4000}, {"order": 2}, {"order": 4, "shard_tokens": 20000}])
def test_counts_and_base(spark, options):
    rows = scored(spark, TEXTS, **options).collect()
    words = [(i, [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))] + [None]) for i, t in TEXTS]
    train = Counter(w for i, ws in words if not out_of(i) for w in ws)
    n, v = sum(train.values()), len(train)
    want = sorted((str(i), out_of(i), len(ws), sum(w in train for w in ws), n, round(sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for i, ws in words)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    assert all(r.score < 0 and math.isfinite(r.score) and r.perplexity >= 1 for r in rows)


def test_language_model_empty(spark):
    assert scored(spark, []).count() == 0
    only = scored(spark, [(i, "a b") for i in range(100) if out_of(i)]).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.score == 0 for r in only)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(5)
    size, n = 30, 4000
    word = rng.zipf(1.6, n) % size
    before = [np.append(0, word[:-1]), np.append([0, 0], word[:-2])]
    # every context with every word, so that the sum over words can be taken; only the first n tokens are training
    pairs = np.array([(w, *key) for key in set(zip(*before)) for w in range(size)])
    word, before = np.append(word, pairs[:, 0]), [np.append(before[k], pairs[:, k + 1]) for k in (0, 1)]
    levels = language_model.levels_of(word, before, size)
    count = np.bincount(levels.cell, weights=np.arange(len(word)) < n).astype(np.int64)
    p = language_model.averaged(levels, np.full(size, 1 / size), count, 3, 4, 1.0, rng)
    assert np.bincount(levels.rest[-1], weights=p) == pytest.approx(1)
    assert p.min() > 0


def test_seating_follows_the_restaurant():
    """The number of tables of 6 customers with one dish, against its exact distribution."""
    d, s, parent, c, n = 0.6, 1.5, 0.3, 6, 20000
    weight = np.zeros(c + 1)  # of seatings with t tables, customer by customer
    weight[1] = s * parent
    for k in range(1, c):
        weight = weight * np.maximum(k - d * np.arange(c + 1), 0) + np.append(0, (weight * (s + d * np.arange(c + 1)) * parent)[:-1])
    weight /= weight.sum()
    seating = language_model.Seating(np.arange(n), d, s, np.random.default_rng(8))
    count = np.full(n, c)
    seating.receive(count)
    for _ in range(15):
        seating.sweep(np.full(n, parent))
        assert (np.bincount(seating.cell[np.flatnonzero(np.bincount(seating.z, minlength=2 * len(seating.z))) % len(seating.z)], minlength=n) == seating.t).all()
        seating.receive(count)
    got = np.bincount(seating.t, minlength=c + 1) / n
    assert got == pytest.approx(weight, abs=0.015)
    assert (seating.tables == seating.t).all()
    fewer = np.random.default_rng(9).integers(0, 9, n)
    seating.receive(fewer)
    assert (seating.t <= fewer).all() and ((seating.t > 0) == (fewer > 0)).all()


def test_model_beats_unigrams_on_held_out(spark):
    held = queries.op11_language_model(spark, f"{DATA}/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert held[0] > held[1] + 0.1 * held[2]


def test_more_shards_score_alike(spark):
    docs = table(spark, f"{DATA}/sf0.001", "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    few, many, again = ({r.doc_id: r.score for r in language_model.log_scores(docs, held, shard_tokens=n).collect()} for n in (10**7, 8000, 8000))
    assert many == again
    assert sum(many.values()) == pytest.approx(sum(few.values()), rel=0.05)


def test_hot_words_are_dealt_by_the_word_before():
    chunk = language_model.Chunk(0, [0], np.array([False]), np.array([6]), np.array([2, 3, 2, 4, 2, 0]), np.arange(10, 15).astype(np.uint64))
    plan = language_model.Plan(3, 1000, 5, 6, np.array([12], dtype=np.uint64), np.array([50]), np.array([3]), np.zeros(0, np.uint64), np.zeros(0, np.int32))
    _, shard = language_model.shards_of(chunk, plan)
    by_last = defaultdict(set)
    for s, last in zip(shard.tolist(), [1, 2, 3, 2, 4, 2]):
        by_last[last].add(s)
    assert len(by_last[2]) == 3 and len(by_last[3]) == 1
