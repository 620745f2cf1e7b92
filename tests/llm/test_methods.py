"""The parts of the methods, and the queries, against brute force and check SQL."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import decontaminate, line_dedup, quality, queries, simhash, suffix_dedup, token_counts, warc
from fleetlens.llm.common import table
from tests.oracle import DATA, connect, rows_of


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_check_sql(spark, name):
    folder = f"{DATA}/sf0.001"
    got = queries.QUERIES[name](spark, folder)
    cur = connect(folder).execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(columns, cur.fetchall())


def brute_components(fps, tau):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin((fps[i] ^ fps[j]) & (1 << 64) - 1).count("1") <= tau:
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(find(i), []).append(fps[i])
    return sorted(sorted(g) for g in groups.values() if len(g) > 1)


@pytest.mark.parametrize("tau", [1, 3, 7])
def test_close_links_with_crowded_buckets(spark, tau):
    rnd = random.Random(tau)
    fps = {rnd.getrandbits(64) for _ in range(200)}
    for centre in [rnd.getrandbits(64) for _ in range(3)]:  # dense balls: buckets far above the size at which they split
        for _ in range(120):
            x = centre
            for b in rnd.sample(range(64), rnd.randint(0, 6)):
                x ^= 1 << b
            fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    points = spark.createDataFrame([(x,) for x in signed], "fp long")
    parts = simhash.components(simhash.close_links(points, tau, bucket_rows=8)).collect()
    groups = {}
    for r in parts:
        groups.setdefault(r.component, []).append(r.node)
    assert sorted(sorted(g) for g in groups.values()) == brute_components(signed, tau)


def test_thresholds():
    costs = [[0, 5, 50, 500], [0, 9, 20, 900], [0, 4, 40, 400], [0, 100, 1000, 10000]]
    best = simhash.allocate(costs, 2)
    assert sum(t + 1 for t in best) == 3 and best == [0, 0, 0, -1]
    histogram = np.random.default_rng(1).integers(0, 5, 1 << 6)
    counts = simhash.candidate_counts(histogram, 6, 2)
    pairs = [sum(histogram[a] * histogram[b] for a in range(64) for b in range(64) if bin(a ^ b).count("1") <= t) / 2 for t in range(3)]
    keys = np.cumsum([histogram.sum() * c for c in (1, 6 / 2, 15 / 4)])
    assert counts[1:] == pytest.approx([p + k for p, k in zip(pairs, keys)])


def test_perfect_hash():
    rng = np.random.default_rng(3)
    h1, h2 = (rng.integers(0, 1 << 63, 5000).astype(np.uint64) for _ in range(2))
    sizes, bits = line_dedup.perfect_hash(h1, h2)
    place = line_dedup.places(h1, h2, sizes, bits)
    assert sorted(place) == list(range(5000))


def test_column_order():
    rnd = random.Random(5)
    strings = ["".join(rnd.choice("ab") for _ in range(rnd.randint(6, 30))) for _ in range(40)]
    lead = [rnd.randint(0, 3) for _ in strings]
    width = max(len(s) + a for s, a in zip(strings, lead))
    matrix = np.zeros((len(strings), width), np.uint8)
    begin = np.array(lead)
    end = begin + [len(s) for s in strings]
    for i, s in enumerate(strings):
        matrix[i, begin[i]:end[i]] = list(s.encode())
    got = suffix_dedup.column_order(matrix, begin, end, 6)
    for i, s in enumerate(strings):
        for c in range(width):
            own = s[c - lead[i]:c - lead[i] + 6] if c >= lead[i] else ""
            want = len(own) == 6 and any(j != i and c >= lead[j] and t[c - lead[j]:c - lead[j] + 6] == own for j, t in enumerate(strings))
            assert got[i, c] == want


def edit_distance_within(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, x in enumerate(item, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (x != c)))
        row = new
        best = min(best, row[-1])
    return best


def test_myers():
    rnd = random.Random(7)
    for _ in range(200):
        item = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 90)))
        text = "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 40))) + item[rnd.randint(0, 3):] + "".join(rnd.choice("abc") for _ in range(20))
        want = edit_distance_within(item, text)
        got = decontaminate.occurrences(item, decontaminate.char_masks(item), text, len(item))
        assert (got[0] if got else None) == (want if text and want <= len(item) and got else None)
        assert got is None or got[0] == want


def test_decontamination_against_brute_force(spark):
    folder = f"{DATA}/sf0.001"
    docs, bench = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    items = [(r.item_id, decontaminate.normalised(r.text)) for r in bench.collect()]
    want = set()
    for r in docs.where("length(text) < 3000").collect():
        text = decontaminate.normalised(r.text)
        for item_id, item in items:
            d = 0 if item in text else None
            if d is None and any(item[i:i + 16] in text for i in range(0, len(item) - 16, 4)):
                d = edit_distance_within(item, text)
            if d is not None and d <= len(item) // decontaminate.CHARS_PER_EDIT:
                want.add((r.doc_id, item_id, d))
    got = {(r.doc_id, r.item_id, r.edits) for r in decontaminate.contaminated(docs.where("length(text) < 3000"), bench).collect()}
    assert got == want and got


def test_quality_held_out(spark):
    folder = f"{DATA}/sf0.1"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    rows = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    truth = [(rows[r.doc_id], r.quality) for r in labels.collect() if rows[r.doc_id].held_out]
    assert np.mean([p.predicted == q for p, q in truth]) > 0.97
    # what is held out cannot move a score
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality")
    again = {r.doc_id: r.score for r in quality.quality_scores(docs, turned).collect()}
    assert max(abs(again[i] - rows[i].score) for i in rows) < 1e-6


def test_best_bin_prior():
    rng = np.random.default_rng(2)
    p, n = rng.normal(2, 1, 8000), rng.normal(-2, 1, 8000)
    u = np.concatenate([p[:2400], n[:5600]])
    assert quality.best_bin_prior(rng.normal(2, 1, 8000), u) == pytest.approx(0.3, abs=0.05)


def test_attribution():
    # tokens [0,2) [2,5) [5,9) over sections that end at 3, 4, 9
    starts, ends, bounds = np.array([0, 2, 5]), np.array([2, 5, 9]), np.array([3, 4, 9])
    assert token_counts.attribute(starts, ends, bounds, "first")[0].tolist() == [2, 0, 1]
    assert token_counts.attribute(starts, ends, bounds, "last")[0].tolist() == [1, 0, 2]
    each, crossing = token_counts.attribute(starts, ends, bounds, "largest")
    assert each.tolist() == [2, 0, 1] and crossing == 1


def test_arc_versions():
    def archive(version, lines):
        first = f"{version} 0 x\n{warc.ARC_FIELDS[version]}\n".encode()
        return f"filedesc://x.arc 0.0.0.0 20010203040506 text/plain {len(first)}\n".encode() + first + b"\n" + b"\n".join(lines)

    one = archive(1, [b"http://a/b c 1.2.3.4 20010203040506 text/html 5\nHello", b"dns:x 1.2.3.4 200102030405 text/dns 2\nip", b""])
    two = archive(2, [b"http://a/ 1.2.3.4 20010203040506 text/html 200 - - 0 f 5\nHello", b"bad line\n"])
    rows = list(warc.arc_records(one))
    assert [(r["url"], r["content"]) for r in rows] == [("http://a/b c", b"Hello"), ("dns:x", b"ip")]
    assert warc.warc_fields(rows[0])["date"] == "2001-02-03T04:05:06Z" and warc.warc_fields(rows[1])["date"] == "2001-02-03T04:05:00Z"
    assert warc.warc_fields(rows[1])["type"] == "resource"
    assert [(r["url"], r["result-code"], r["content"]) for r in warc.arc_records(two)] == [("http://a/", "200", b"Hello")]
    assert list(warc.arc_records(b"")) == [] and list(warc.arc_records(b"\x00\x01")) == []


def test_near_duplicates_of_contiguous_changes(spark):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(5))
    texts = []
    for _ in range(60):
        base = [word() for _ in range(rnd.choice([40, 150, 400, 900]))]
        n = len(base)
        scattered = [word() if rnd.random() < 0.015 else w for w in base]
        texts += [base, base + [word() for _ in range(int(n * 0.15))], base + [word() for _ in range(int(n * rnd.uniform(0.2, 0.3)))],
                  base[:int(n * 0.85)], base[:int(n * rnd.uniform(0.72, 0.85))], [word() for _ in range(n // 10)] + base, scattered]
    sets = [{tuple(t[i:i + 5]) for i in range(len(t) - 4)} for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared >= 0.8 * (len(sets[i]) + len(sets[j]) - shared):
                low, high = sorted((find(i), find(j)))
                parent[high] = low
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sorted(r.doc_id for r in simhash.without_near_duplicates(docs).collect())
    assert got == sorted({find(i) for i in range(len(texts))})


def test_fingerprints_give_candidates_that_are_verified(spark, monkeypatch):
    none = lambda points, least: points.select(F.col("node").alias("u"), F.col("node").alias("v")).where("false")
    monkeypatch.setattr(simhash, "sketch_links", none)  # what is found now comes from the fingerprints
    rnd = random.Random(4)
    long = [f"w{rnd.randrange(10**6)}" for _ in range(3000)]
    changed = [*long[:1500], "other", *long[1501:]]
    line = "the same eleven words come again and again in here too "
    ends = [" ".join(f"e{rnd.randrange(10**6)}" for _ in range(60)) for _ in range(2)]  # few words, but most of the set
    texts = [" ".join(long), " ".join(changed), *[line * 800 + e for e in ends], ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = [r.fp for r in simhash.fingerprints(docs, "doc_id", "text", 5).orderBy("id").collect()]
    assert all(0 < (prints[i] ^ prints[i + 1]).bit_count() <= 3 or prints[i] == prints[i + 1] for i in (0, 2))
    assert sorted(r.doc_id for r in simhash.without_near_duplicates(docs).collect()) == [0, 2, 3, 4]


def test_sketch_links(spark):
    bands, least = simhash.sketch_plan(0.8)
    assert (1 - 0.8 ** 3) ** bands <= 1e-12 < (1 - 0.8 ** 3) ** (bands - 1)
    rng = np.random.default_rng(5)
    rows = []
    for g in range(3):  # groups far above the block size, one key shared by all
        centre = rng.integers(0, 256, bands * 3, dtype=np.uint8)
        for i in range(50):
            x = centre.copy()
            x[:20 + g] = rng.integers(0, 256, 20 + g)
            rows.append((g * 50 + i, [7, 100 + g, 1000 + g * 50 + i], bytearray(x.tobytes())))
    points = spark.createDataFrame(rows, "node long, keys array<long>, sketch binary")
    for size in (8, 4096):
        parts = simhash.components(simhash.sketch_links(points, least, size)).collect()
        assert sorted((r.node, r.component) for r in parts) == [(i, i // 50 * 50) for i in range(150)]


def columns_of(strings, lead):
    begin = np.array(lead)
    end = begin + [len(s) for s in strings]
    matrix = np.zeros((len(strings), int(end.max())), np.uint8)
    for i, s in enumerate(strings):
        matrix[i, begin[i]:end[i]] = list(s.encode())
    return matrix, begin, end


def test_column_order_where_strings_leave():
    got = suffix_dedup.column_order(*columns_of(["cabd", "cabe", "zz"], [0, 0, 2]), 3)
    assert got[:, 0].tolist() == [True, True, False] and not got[:, 1:].any()
    rnd = random.Random(9)
    letters = "".join(map(chr, range(33, 97)))
    for _ in range(20):
        anchors = ["".join(rnd.choice(letters) for _ in range(12)) for _ in range(15)]
        cut = [(rnd.randint(0, 8), a + rnd.choice(letters) * 2) for a in anchors for _ in range(4)]
        strings, lead = [a[s:] for s, a in cut], [s for s, _ in cut]
        got = suffix_dedup.column_order(*columns_of(strings, lead), 5)
        for i, s in enumerate(strings):
            for c in range(got.shape[1]):
                own = s[c - lead[i]:c - lead[i] + 5] if c >= lead[i] else ""
                want = len(own) == 5 and any(j != i and c >= lead[j] and t[c - lead[j]:c - lead[j] + 5] == own for j, t in enumerate(strings))
                assert got[i, c] == want
