"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fleetlens.llm import decontaminate, exact_dedup, line_dedup, mixing, quality, queries, sharding, simhash, suffix_dedup, token_counts, warc

WORDS = [f"word{i}" for i in range(50)]
LONG = " ".join(WORDS[i * 7 % 50] + str(i) for i in range(20000))
ROWS = [
    (1, "A line that repeats\nOwn line of one\n", "b"), (2, " a LINE that repeats \nanother own line", "a"), (3, None, None), (4, "", "a"),
    (5, "same  text", "a"), (6, "sametext", "b"), (7, " s a m e t e x t", "c"), (8, LONG, "b"), (9, LONG, "c"), (10, LONG + " tail", "a"),
    (11, "x" * 500, "a"), (12, "x" * 500 + "y", "a"), (5, "same  text", "a"), (5, "same  text", "a"), (None, "no id here at all", "a"),
    (None, "no id here at all", None), (13, " \t\n\x0b\x0c\r ", "b"), (14, "Größe Ünïcode 😀 text\n" * 30, "c"), (15, "\n\n\n", "a"),
]
SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    clash = ["id", "h", "h1", "row", "sha", "kept", "keep_id", "group_size", "text_sha256", "bits", "size", "taken", "target", "w", "fp", "node",
             "shard", "depth", "score", "item_id", "edits", "end", "key", "n", "component", "spans", "gone", "x", "n_bytes", "lang"]
    return df.select("*", *[F.lit("clash").alias(c) for c in clash])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def text_of(t):
    return t or ""


def test_exact(docs, empty):
    got = exact_dedup.exact_duplicates(docs).collect()
    squeezed = [re.sub(r"[\x20\x09-\x0D]", "", text_of(t)) for _, t, _ in ROWS]
    groups = defaultdict(list)
    for (i, t, _), s in zip(ROWS, squeezed):
        groups[s].append((-len(text_of(t)), i is None, i or 0))
    want = Counter((i, min(groups[s])[2] if not min(groups[s])[1] else None, len(groups[s]), hashlib.sha256(s.encode()).hexdigest()) for (i, _, _), s in zip(ROWS, squeezed))
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_lines(docs, empty):
    def key(line):
        k = line.strip(" \t\n\x0b\x0c\r")
        return re.sub("[A-Z]", lambda m: m[0].lower(), k)

    holders = defaultdict(set)
    for i, t, _ in ROWS:
        for line in text_of(t).split("\n"):
            holders[key(line)].add(float("inf") if i is None else i)
    want = Counter()
    for i, t, _ in ROWS:
        lines = text_of(t).split("\n")
        own = float("inf") if i is None else i
        kept = [x for x in lines if len(key(x)) < 10 or min(holders[key(x)]) == own]
        want[(i, len(lines), len(lines) - len(kept), "\n".join(kept))] += 1
    assert Counter(tuple(r) for r in line_dedup.dedup_lines(docs).collect()) == want
    assert line_dedup.dedup_lines(empty).count() == 0


def test_suffix(docs, empty):
    length = 40
    seen = Counter(text_of(t).encode()[i:i + length] for _, t, _ in ROWS for i in range(len(text_of(t).encode()) - length + 1))
    want = Counter()
    for i, t, _ in ROWS:
        raw = text_of(t).encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            if seen[raw[s:s + length]] > 1:
                gone[s:s + length] = b"\1" * length
        want[(i, len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(c for c, g in zip(raw, gone) if not g))] += 1
    for group in (65536, 2):
        left = suffix_dedup.remove_repeats(docs, length=length, anchor=16, group_strings=group)
        assert Counter((*r[:4], bytes(r[4])) for r in left.collect()) == want
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_suffix_planted_passages(spark, tmp_path):
    rnd = random.Random(3)

    def prose(n, long):
        return " ".join("".join(rnd.choice("abcdefghé") for _ in range(rnd.randint(*long))) for _ in range(n))

    rows, kinds = [], {}
    for long, kind in (((7, 12), "long"), ((2, 6), "short"), (None, "clean")):  # passages of 51 to 60 words
        for _ in range(12):
            passage = prose(rnd.randint(51, 60), long) if long else ""
            for _ in range(2 if long else 1):
                kinds[len(rows)] = kind
                rows.append((len(rows), f"{prose(rnd.randint(0, 200), (2, 9))}\n{passage}\n{prose(rnd.randint(60, 200), (2, 9))}"))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    seen = Counter(t.encode()[i:i + 400] for _, t in rows for i in range(len(t.encode()) - 399))
    want = {}
    for i, t in rows:
        raw = t.encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 399):
            if seen[raw[s:s + 400]] > 1:
                gone[s:s + 400] = b"\1" * 400
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        want[i] = (len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: tuple(r)[1:] for r in queries.op7_suffix_dedup(spark, str(tmp_path)).collect()}
    assert got == want
    # the contract counts bytes: a passage of over 50 words goes if it has 400 of them, and n_removed tells it, not n_bytes
    assert all((got[i][1] > 0) == (kind == "long") for i, kind in kinds.items())


def test_simhash(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    by_print = defaultdict(set)
    for r in got:
        by_print[r.fingerprint].add(r.component_id)
    assert all(len(c) == 1 for c in by_print.values())
    zero = [r for r in got if r.fingerprint == "0" * 16]
    assert {r.doc_id for r in zero} == {3, 4, 13, 15} and {r.component_id for r in zero} == {3}
    assert {r.component_id for r in got if r.doc_id in (8, 9)} == {8}
    assert simhash.near_duplicates(empty).count() == 0


def test_mixing(docs, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS)
    totals, wanted, taken = defaultdict(int), {}, defaultdict(int)
    for r in got:
        totals[r.source] += r.size
        taken[r.source] += r.taken
        wanted[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    assert sum(r.size for r in got) == sum(len(re.findall(r"[^\x20\x09-\x0D]+", text_of(t))) for _, t, _ in ROWS)
    assert all(abs(taken[s] - wanted[s]) <= 1 for s in totals)
    assert abs(sum(wanted.values()) - sum(totals.values())) < 1e-6
    assert sorted(tuple(r) for r in mixing.mix(docs.where("doc_id IS NOT NULL AND source IS NOT NULL").repartition(5)).collect()) == sorted(
        tuple(r) for r in mixing.mix(docs.where("doc_id IS NOT NULL AND source IS NOT NULL")).collect())
    assert mixing.mix(empty).count() == 0
    assert mixing.mix(docs.where("text IS NULL")).collect()[0].taken == 0


def test_water_fill(spark):
    sources = spark.createDataFrame([("a", 10, 1), ("b", 100, 2), ("c", 1000, 7), ("d", 0, 5), ("e", 5, 0)], "source string, source_size long, weight long")
    got = {r.source: r.target for r in mixing.water_fill(sources).collect()}
    caps = {"a": 30, "b": 300, "c": 3000, "d": 0, "e": 15}
    weights = {"a": 1, "b": 2, "c": 7, "d": 5, "e": 0}
    fixed: dict = {}
    while True:  # the rule as it is stated
        level = (1115 - sum(fixed.values())) / sum(w for s, w in weights.items() if s not in fixed)
        over = {s: caps[s] for s, w in weights.items() if s not in fixed and level * w > caps[s]}
        if not over:
            break
        fixed |= over
    want = {s: fixed.get(s, level * w) for s, w in weights.items()}
    assert got == pytest.approx(want)


def test_sharding(docs, empty):
    got = sharding.shards(docs, max_bytes=2000).collect()
    assert len(got) == len(ROWS)
    held = defaultdict(int)
    for r in got:
        held[r.shard] += r.n_bytes
    for r in got:
        assert held[r.shard] == r.shard_bytes and len(r.shard) == r.depth
        assert r.oversized == (r.shard_bytes > 2000)
        assert not r.oversized or r.depth == sharding.DEPTH
        siblings = sum(b for s, b in held.items() if s.startswith(r.shard[:-1]))
        assert r.depth == 0 or siblings > 2000  # no bucket was split that fitted
    assert {r.shard for r in sharding.shards(docs, max_bytes=1 << 30).collect()} == {""}
    assert sharding.shards(empty).count() == 0


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_tokens(docs, empty, rule):
    got = token_counts.token_counts(docs, rule=rule).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert sum(r.section_tokens) == r.n_tokens and len(r.section_tokens) == r.n_sections
    by_id = {r.doc_id: r for r in got}
    assert by_id[3].n_tokens == 0 and by_id[3].section_tokens == [0]
    assert by_id[14].n_sections == 30
    assert token_counts.token_counts(empty).count() == 0


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (2, 1), (8, 1), (9, 1), (11, 0), (None, 1), (4, None), (8, 1)], "doc_id long, quality int")
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    none = labels.where("false")
    assert {r.score for r in quality.quality_scores(docs, none).collect()} == {0.5}
    assert quality.quality_scores(empty, labels).count() == 0
    assert set(quality.good_documents(docs, labels).columns) == set(docs.columns)


def test_contaminated(spark, docs, empty):
    item = "This is an Item of the benchmark, with  quite some characters in it."
    near = "before this is an itm of the benchmark, with quite some charakters in it. after"
    bench = spark.createDataFrame([(1, item), (2, item), (None, item), (3, None), (4, ""), (5, "same text")], "item_id long, text string")
    extra = spark.createDataFrame([(100, near, "a"), (101, None, "a"), (102, near.replace("bench", "BUNCHED"), "a")], SCHEMA)
    got = decontaminate.contaminated(docs.select("doc_id", "text", "source").unionByName(extra), bench)
    assert sorted((r.doc_id, r.item_id, r.edits) for r in got.collect()) == [(5, 5, 0)] * 3 + [(100, 1, 2)]
    clean = decontaminate.clean_documents(extra, bench, block_bytes=40)
    assert {r.doc_id for r in clean.collect()} == {101, 102}
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.contaminated(docs, bench.where("false")).count() == 0


def test_warc(spark):
    body = "<html>" + "é" * 200
    rows = [(3, "http://a b/\n", body), (1, "http://c/", body), (None, None, body), (2, "http://d/", "short"), (4, "http://e/", "short"), (5, "http://f/", None),
            (6, "http://g/", "a\r\n\r\nb" * 60), (1, "http://c/", body), (7, "", "WARC/1.1\r\n\r\n" + "HTTP/1.1 200\n" * 20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", F.lit(1).alias("record"), F.lit(2).alias("content"))
    got = Counter(tuple(r) for r in warc.archived(pages).collect())
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    size = lambda t: len((t or "").encode())
    want = Counter()
    for k, (i, _, t) in enumerate(rows):
        first = i == 1 and k == 1
        revisit = t == body and not first
        want[(i, size(t), digest(t), "revisit" if revisit else "response", 1 if revisit else None)] += 1
    assert got == want
    assert warc.archived(pages.where("false")).count() == 0


def test_pipeline_stages(spark, docs, empty):
    kept = simhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert ids == sorted([(False, i) for i in (1, 2, 3, 5, 6, 7, 8, 11, 12, 14)] + [(True, 0)])
    assert simhash.without_near_duplicates(empty).count() == 0
    mixed = mixing.repeated(docs, mixing.mix(docs))
    assert mixed.columns == docs.columns
    assert mixing.repeated(empty, mixing.mix(empty)).count() == 0


def test_items_without_id_are_cleaned(spark):
    item = "a question long enough to be searched inside of other texts"
    docs = spark.createDataFrame([(1, f"before {item} after"), (2, "something else"), (3, None)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(None, item), (4, None)], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.clean_documents(docs, benchmark).collect()) == [2, 3]


def test_short_items_and_blocks(spark, empty):
    """Short items as whole words; the ids that come out do not hang on the size of a block."""
    spellings = ["Three  spellings of one and the same item", "three spellings OF one and the same item", " three spellings of one and the same\titem "]
    bench = spark.createDataFrame([*enumerate(spellings, 1), (4, "forty two"), (5, "yes"), (6, "a b c d e f g")], "item_id long, text string")
    rows = [(1, "so " + spellings[0] + " here"), (2, "the answer: Forty\ntwo."), (3, "forty twos"), (4, "yes of course"), (5, " YES "), (6, "a_b c d e f g"), (7, "x a b c d e f g"), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(1, 1, 0), (2, 4, 0), (5, 5, 0), (7, 6, 0)]
    for size in (20, 40, 1 << 20):
        assert sorted((r.doc_id, r.item_id, r.edits) for r in decontaminate.contaminated(docs, bench, block_bytes=size).collect()) == want
        assert sorted(r.doc_id for r in decontaminate.clean_documents(docs, bench, block_bytes=size).collect()) == [3, 4, 6, 8]


def test_damaged_archives(spark, tmp_path):
    first = f"1 0 x\n{warc.ARC_FIELDS[1]}\n".encode()
    head = lambda name: f"filedesc://{name}.arc 0.0.0.0 20010203040506 text/plain {len(first)}\n".encode() + first
    good = lambda i, body: f"http://a/{i} 1.2.3.4 20010203040506 text/html {len(body)}\n".encode() + body + b"\n"
    records = [good(i, b"body %d" % i * 50) for i in range(3)]
    cases = {
        "whole": (b"".join(records), [0, 1, 2], []), "bad_line": (records[0] + b"what is this 12 x\nand this\n" + records[1] + records[2], [0, 1, 2], ["no header"]),
        "wrong_length": (records[0].replace(b"html 300", b"html 290") + records[1] + records[2], [0, 1, 2], ["no header"]),
        "cut": (records[0] + records[1] + records[2][:-30], [0, 1], ["cut short"]), "tail": (records[0] + b"trailing", [0], ["no header"]),
    }
    for name, (data, urls, reasons) in cases.items():
        found = []
        assert [int(r["url"][-1]) for r in warc.arc_records(head(name) + data, found)] == urls, name
        assert [r for _, r in found] == reasons, name
        (tmp_path / f"part-{name}").write_bytes(head(name) + data)
    (tmp_path / "part-none").write_bytes(b"no archive\n")
    rejects = warc.arc_rejects(spark, str(tmp_path)).collect()
    assert sorted(r.reason for r in rejects) == ["cut short", "no header", "no header", "no header", "no version block"]
    warc.convert_arc(spark, str(tmp_path), str(tmp_path / "out"))
    back = warc.read_warc(spark, str(tmp_path / "out")).collect()
    assert len(back) == 12 and sum(r.record_type == "revisit" for r in back) == 12 - 4


def test_very_long_payload(spark):
    body = "<p>" + "long " * 2_000_000
    pages = spark.createDataFrame([(1, "http://a/", body), (2, "http://b/", body), (3, "http://c/", body + "x")], "page_id long, url string, html string")
    got = sorted(tuple(r) for r in warc.archived(pages).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    n = len(body)
    assert got == [(1, n, sha(body), "response", None), (2, n, sha(body), "revisit", 1), (3, n + 1, sha(body + "x"), "response", None)]
