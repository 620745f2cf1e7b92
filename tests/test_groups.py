"""Groups without a row on one side, labels outside the vocabulary, and columns that clusters keep."""

import pytest

from fleetlens.operators import detections as DET
from fleetlens.operators import evaluation as E

BOX = "ymin double, xmin double, ymax double, xmax double"


def frame(spark, rows, more=""):
    return spark.createDataFrame(rows, f"image_id long, det_id long, model string, label string, confidence double, {BOX}{more}")


@pytest.fixture(scope="module")
def boxes(spark):
    gold = frame(spark, [(1, i, None, c, None, 0.0, 100.0 * i, 50.0, 100.0 * i + 50) for i, c in enumerate(["dent", "crack", "major"])])
    found = [(1, 10, "a", "dent", 0.9, 0.0, 0.0, 50.0, 50.0)] + [
        (1, 20 + i, "b", c, 0.9, 0.0, 100.0 * i, 50.0, 100.0 * i + 50) for i, c in enumerate(["dent", "crack"])
    ] + [(2, 30, "c", "dent", 0.9, 0.0, 0.0, 50.0, 50.0)]
    return frame(spark, found), gold


def test_classes_never_predicted(boxes):
    found, gold = boxes
    matches = E.match_detections(found, gold)
    ap = E.average_precision(matches, found, gold)
    assert {r.model: (r.map50, r.n_classes) for r in E.mean_average_precision(ap).collect()} == {
        "a": (pytest.approx(1 / 3), 3), "b": (pytest.approx(2 / 3), 3), "c": (0.0, 3)
    }
    rows = {(r.model, r.label): (r.tp, r.fp, r.fn, r.precision, r.recall) for r in E.precision_recall(matches, found, gold).collect()}
    assert len(rows) == 9 and rows[("a", "major")] == (0, 0, 1, None, 0.0) and rows[("c", "dent")] == (0, 1, 1, 0.0, 0.0)


def test_models_that_never_meet(boxes):
    rates = {(r.model, r.other_model): r.rate for r in E.model_agreement(boxes[0]).collect()}
    assert len(rates) == 6 and rates[("a", "c")] == 0 and rates[("a", "b")] == 1 and rates[("b", "a")] == 0.5


def test_models_without_a_box(spark, boxes):
    stored = spark.createDataFrame([(1, "a"), (9, "idle")], "image_id long, model string")
    got = {r.model: (r.n_detections, r.n_images_with_detections) for r in DET.detections_per_model(boxes[0], stored).collect()}
    assert got == {"a": (1, 1), "b": (2, 1), "c": (1, 1), "idle": (0, 0)}


def test_labels_as_they_come(spark):
    rows = spark.createDataFrame([("x", c) for c in ["rust", "rust", "hole", None]], "k string, label string")
    assert DET.label_summary(rows, ["k"], "label").first()[1:] == ("2× rust · 1× ? · 1× hole", 4)


def test_missing_label_and_kept_columns(spark):
    rows = [(1, i, "a", None, 0.5, 0.0, float(i), 10.0, 10.0 + i, "hood") for i in range(6)]
    rows += [(1, 50, "a", "dent", 0.5, 500.0, 500.0, 510.0, 510.0, "door")]
    got = DET.collapse_clusters(frame(spark, rows, ", panel string")).collect()
    assert sorted((r.det_id, r.is_cluster, r.cluster_size, r.panel) for r in got) == [(0, True, 6, None), (50, False, 0, "door")]
