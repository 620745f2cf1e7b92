"""Large JSON documents, cut at byte ranges, against a plain parser."""

import glob
import gzip
import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetlens.plans import registry
from fleetlens.session import checkpoint_root
from fleetlens.sources import json_parts, readers, sinks
from fleetlens.sources.json_parts import json_entries
from tests.oracle import DATA

ODD = ['plain', 'with "quotes"', "braces }{ and ][", "back\\slash", 'all \\" } , "{" ] , ', "line\nbreak, comma", "Größe }", "", "}" * 40, '\\\\"', "\\"]


def value(rnd, depth=0):
    kind = rnd.randrange(7 if depth < 4 else 4)
    if kind == 0:
        return rnd.choice(ODD) * rnd.randint(1, 3)
    if kind < 4:
        return [None, True, rnd.random(), rnd.randint(-5, 10**12)][rnd.randrange(4)]
    if kind == 4:
        return [value(rnd, depth + 1) for _ in range(rnd.randint(0, 4))]
    return {rnd.choice(ODD) + str(i): value(rnd, depth + 1) for i in range(rnd.randint(0, 4))}


@pytest.fixture
def small_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "997", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def entries(spark, path):
    return [r.entry for r in json_entries(spark, str(path)).orderBy("pos").collect()]


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("indent", [None, 2])
def test_arrays_and_objects(spark, tmp_path, small_ranges, seed, indent):
    rnd = random.Random(seed)
    array = [value(rnd) for _ in range(25)]
    keyed = {f"{rnd.choice(ODD)}{i}": value(rnd) for i in range(25)}
    (tmp_path / "a.json").write_text(json.dumps(array, indent=indent, ensure_ascii=False))
    (tmp_path / "o.json").write_text(" \n" + json.dumps(keyed, indent=indent, ensure_ascii=False) + "\n\n")
    assert [json.loads(e) for e in entries(spark, tmp_path / "a.json")] == array
    got = [json.loads("{" + e + "}") for e in entries(spark, tmp_path / "o.json")]
    assert [next(iter(e.items())) for e in got] == list(keyed.items())


def test_empty_and_several_files(spark, tmp_path, small_ranges):
    for name, text in {"a": "[]", "b": "{ }", "c": "", "d": " \n ", "e": "[1]", "f": '["x", {}]\n', "g": '{"k": [[]]}', "h": "[" + ",".join(['"' + "y" * 300 + '"'] * 3) + "]"}.items():
        (tmp_path / f"{name}.json").write_text(text)
    assert [e.strip() for e in entries(spark, tmp_path)] == ["1", '"x"', "{}", '"k": [[]]', *['"' + "y" * 300 + '"'] * 3]


def register(n):
    rnd = random.Random(n)
    coordinate = lambda: {"projection": rnd.choice(["P1", None]), "segment": "S", "photos": [{"photo_id": "p", "type": rnd.choice(ODD), "url": "u"}] * rnd.randrange(3)}
    damage = lambda i: {"damage_id": f"d{i}", "type": "TYPE_DENT", "part": rnd.choice(ODD), "coordinates": [coordinate() for _ in range(rnd.randrange(3))]}
    case = lambda i: {"damage_case_id": str(i), "damage_created_at": {"seconds": "1700000000"}, "damages": [damage(k) for k in range(rnd.randrange(4))]}
    return {f"M {i} {rnd.choice(ODD)}": {"damage_cases": [case(k) for k in range(rnd.randrange(4))]} for i in range(n)}


def test_register_equals_the_line_reader(spark, tmp_path, small_ranges):
    plates = register(60)
    (tmp_path / "whole.json").write_text(json.dumps(plates, indent=1))
    (tmp_path / "lines.json").write_text("\n".join(json.dumps({k: v}) for k, v in plates.items()))
    whole = readers.read_damage_register(spark, str(tmp_path / "whole.json"))
    lines = readers.read_damage_register(spark, str(tmp_path / "lines.json"), whole_files=False)
    pick = lambda df: [(r.plate_original, r.payload) for r in df.orderBy("source_pos").collect()]
    assert pick(whole) == pick(lines) and len(pick(whole)) == 60
    assert json_entries(spark, str(tmp_path / "whole.json")).select("pos").distinct().count() == 60


def test_export_equals_the_document_reader(spark, tmp_path, small_ranges):
    vehicles = [{"license_plate": f"M {i}", "tasks": [{"task_id": f"{i}-{k}", "completed_at": None, "photos": [{"type": ODD[(i + k) % len(ODD)], "urls": ["u,}"] * k}]} for k in range(i % 4)]} for i in range(50)]
    (tmp_path / "export.json").write_text(json.dumps(vehicles, indent=3))
    got = readers.read_photo_export(spark, str(tmp_path / "export.json"))
    from fleetlens import schemas
    want = spark.read.schema(schemas.PHOTO_EXPORT).json(str(tmp_path / "export.json"), multiLine=True)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 50


def test_one_large_register_is_read_by_many_tasks(spark, tmp_path):
    """60 MB in one line; no task reads more than a few MB."""
    text = json.dumps({f"M {i}": {"damage_cases": [{"damage_case_id": "c", "damages": [{"damage_id": "d" * 900 + "}{", "type": 'x"y'}]}]} for i in range(60_000)})
    (tmp_path / "big.json").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(4 << 20))
    try:
        pieces = spark.read.option("lineSep", "}").text(str(tmp_path / "big.json"))
        sizes = [r[0] for r in pieces.groupBy(F.spark_partition_id()).agg(F.sum(F.length("value"))).select("sum(length(value))").collect()]
        assert len(sizes) >= 14 and max(sizes) < 6 << 20
        rows = readers.read_damage_register(spark, str(tmp_path / "big.json"))
        assert rows.agg(F.countDistinct("plate_original"), F.min(F.length(F.col("payload.damage_cases")[0]["damages"][0]["damage_id"]))).first()[:] == (60_000, 902)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_pieces_of_a_range_are_looked_at_together():
    pieces = pa.array(['{"a": "x, \\"'] + ['", "b": {"c": 1'] * 9999, pa.string())
    n = len(pieces)
    batch = pa.RecordBatch.from_arrays([pa.array(["f"] * (n - 5) + ["g"] * 5), pa.array([0] * n, pa.int64()), pieces], ["file", "start", "value"])
    got = list(json_parts.runs(batch))
    assert [(file, start, text.count(b"}")) for file, start, text in got] == [("f", 0, n - 5), ("g", 0, 5)]
    assert b"".join(text for _, _, text in got).decode() == "".join(p + "}" for p in pieces.to_pylist())


def test_register_lines_are_written_compressed(spark, tmp_path):
    folder = checkpoint_root(spark)
    before = set(glob.glob(f"{folder}/register-*/*"))
    assert registry.queries()["s03_read_damage_register"](spark, f"{DATA}/sf0.001").count() > 0
    written = [p for p in set(glob.glob(f"{folder}/register-*/*")) - before if "part-" in p]
    assert written and all(p.endswith(".gz") for p in written)


def packed_entries(content, chunk, monkeypatch):
    monkeypatch.setattr(json_parts, "CHUNK", chunk)
    batch = pa.RecordBatch.from_arrays([pa.array(["f"]), pa.array([content], pa.binary())], ["file", "content"])
    found = [r for b in json_parts.cut_packed({"f": 2})([batch]) for r in b.to_pylist()]
    assert [r["pos"] for r in found] == list(range(2 << 44, (2 << 44) + len(found)))
    return [r["entry"] for r in found if r["entry"].strip()]


@pytest.mark.parametrize("chunk", [1, 2, 7, 1 << 20])
def test_packed_documents_are_cut_at_any_chunk(monkeypatch, chunk):
    rnd = random.Random(chunk)
    array, keyed = [value(rnd) for _ in range(12)], {f"{rnd.choice(ODD)}{i}": value(rnd) for i in range(12)}
    text = json.dumps(array, indent=rnd.choice([None, 2]), ensure_ascii=False).encode()
    assert [json.loads(e) for e in packed_entries(gzip.compress(text), chunk, monkeypatch)] == array
    members = gzip.compress(text[:50]) + gzip.compress(text[50:])  # a file of two members is one text
    assert [json.loads(e) for e in packed_entries(members, chunk, monkeypatch)] == array
    got = [json.loads("{" + e + "}") for e in packed_entries(gzip.compress(json.dumps(keyed).encode()), chunk, monkeypatch)]
    assert [next(iter(e.items())) for e in got] == list(keyed.items())
    assert packed_entries(gzip.compress(b" [ ] \n"), chunk, monkeypatch) == []
    with pytest.raises(EOFError):
        packed_entries(gzip.compress(text)[:-20], chunk, monkeypatch)


@pytest.mark.parametrize("limit", [64 << 20, 400])
def test_packed_and_plain_files_together(spark, tmp_path, small_ranges, monkeypatch, limit):
    """Packed files above the limit are read as pieces, like plain ones."""
    monkeypatch.setattr(json_parts, "PACKED", limit)
    rnd, want = random.Random(5), []
    for name, n in {"a.json.gz": 1, "b.json": 30, "c.json.gz": 30, "d.json.gz": 0, "e.json": 2, "f.gz": 2}.items():
        want += (values := [value(rnd) for _ in range(n)])
        with (gzip.open if name.endswith(".gz") else open)(tmp_path / name, "wt") as f:
            json.dump(values, f)
    sizes = [p.stat().st_size for p in tmp_path.glob("*.gz")]
    assert min(sizes) < 400 < max(sizes)
    assert [json.loads(e) for e in entries(spark, tmp_path)] == want


@pytest.mark.parametrize(("row", "most", "lengths"), [(100, 10, [10, 10, 10, 1]), (4, 11, [8, 8, 8, 7]), (5, 10, [10, 10, 10, 1]), (5, 31, [30, 1]), (5, 40, [31]), (5, None, [31])])
def test_documents_of_bounded_length(spark, tmp_path, monkeypatch, row, most, lengths):
    monkeypatch.setattr(sinks, "ROW", row)
    rows = spark.range(0, 93, 1, 3).select(F.concat(F.lit('"k'), "id", F.lit('": {"v": '), "id", F.lit("}")))
    sinks.write_json_documents(rows, str(tmp_path / "out"), "{}", most=most, compression="gzip")
    documents = [json.loads(gzip.open(f).read()) for f in sorted(glob.glob(f"{tmp_path}/out/part-*.gz"))]
    assert list(map(len, documents)) == 3 * lengths
    assert [kv for d in documents for kv in d.items()] == [(f"k{i}", {"v": i}) for i in range(93)]
    assert len(entries(spark, tmp_path / "out")) == 93


def test_whole_register_is_written_compressed_and_once(spark):
    """Neither the documents nor what is cut from them lie on disk as plain text."""
    folder = checkpoint_root(spark)
    before = set(glob.glob(f"{folder}/*"))
    assert registry.queries()["s03_read_whole_register"](spark, f"{DATA}/sf0.001").count() > 0
    made = [p for p in set(glob.glob(f"{folder}/*")) - before if not p.endswith(".crc")]
    written = [f for p in made for f in glob.glob(f"{p}/part-*")]
    assert written and all("/whole-register-" in f and f.endswith(".gz") for f in written)
