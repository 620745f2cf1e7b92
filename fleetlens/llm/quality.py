"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled text train a generalised additive model (each measure of a text falls into one of a
few bins, each bin has a weight) by the non-negative risk: pi * R+(+) + max(0, Ru(-) - pi * R+(-)). The class
prior pi is estimated first: as the share of positives among the labels, or, where only positives are labelled, by the
best bin: the least ratio of unlabelled to positive texts above a score of a plain positive-against-unlabelled model.
"""

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import by_value

by_value(__name__)

SAMPLE = 10000  # positives, and unlabelled texts, to train on
MARKS = (0.01, 0.03, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.93, 0.95, 0.97, 0.99)  # quantiles that bound the bins
MEASURES = 22


def measures(text: str | None) -> list[float]:
    """Numbers that describe a text; all 0 for an empty one."""
    raw = (text or "").encode()
    w = raw.split()
    if not w:
        return [0.0] * MEASURES
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, size = len(w), len(raw)
    upper, lower, digits = int(counts[65:91].sum()), int(counts[97:123].sum()), int(counts[48:58].sum())
    marks = int(counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum())
    letters = max(1, upper + lower)
    seen = Counter(w)
    lines = raw.split(b"\n")
    pairs = len(set(zip(w, w[1:])))
    same = sum(map(bytes.__eq__, w, w[1:]))
    return [
        np.log1p(n), size / n, len(seen) / n, max(seen.values()) / n, same / n, len(set(lines)) / len(lines), upper / letters,
        digits / size, marks / size, counts[124] / n, counts[33] / n, int(counts[[35, 36, 37, 38, 42, 64]].sum()) / n,
        len(lines) / n, sum(map(bytes.isalpha, w)) / n, pairs / max(1, n - 1), counts[46] / n, counts[44] / n, np.log1p(size / len(lines)),
        sum(map(bytes.istitle, w)) / n, int(counts[128:].sum()) / size, max(map(len, w)) / size, len(max(lines, key=len)) / size,
    ]


def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [[float(x) for x in measures(t.as_py())] for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.float64()))], ["positive", "unlabelled", "x"]
        )


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """One-hot bins of each measure, side by side, and a constant."""
    out = [np.ones((len(x), 1))]
    for i, e in enumerate(edges):
        hot = np.zeros((len(x), len(e) + 1))
        hot[np.arange(len(x)), np.searchsorted(e, x[:, i], side="right")] = 1
        out.append(hot)
    return np.concatenate(out, axis=1, dtype=np.float32)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def descend(gradient, size: int, rounds: int = 1500, rate: float = 0.05) -> np.ndarray:
    """Adam steps on ``gradient`` from zero."""
    w, m, v = (np.zeros(size, np.float32) for _ in range(3))
    for t in range(1, rounds + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w


def plain_model(p: np.ndarray, u: np.ndarray, decay: float = 1e-3) -> np.ndarray:
    return descend(lambda w: -(p.T @ sigmoid(-(p @ w))) / len(p) + (u.T @ sigmoid(u @ w)) / len(u) + decay * w, p.shape[1])


def best_bin_prior(p_scores: np.ndarray, u_scores: np.ndarray, doubt: float = 0.1) -> float:
    """Least upper bound of the share of positives among the unlabelled, over all score thresholds."""
    marks = np.sort(p_scores)[::-1]
    above_p = np.arange(1, len(marks) + 1) / len(marks)
    above_u = 1 - np.searchsorted(np.sort(u_scores), marks, side="left") / len(u_scores)
    slack = np.sqrt(np.log(4 / doubt) / 2 / len(p_scores)) + np.sqrt(np.log(4 / doubt) / 2 / len(u_scores))
    best = int(np.argmin((above_u + slack) / above_p))
    return float(np.clip(above_u[best] / above_p[best], 0.05, 0.98))


def non_negative_model(p: np.ndarray, u: np.ndarray, prior: float, decay: float = 1e-4) -> np.ndarray:
    def gradient(w: np.ndarray) -> np.ndarray:
        zp, zu = p @ w, u @ w
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        of_negative = (u.T @ sigmoid(zu)) / len(u) - prior * (p.T @ sigmoid(zp)) / len(p)
        if negative < 0:  # overfitted: undo the negative part only
            return -of_negative + decay * w
        return -prior * (p.T @ sigmoid(-zp)) / len(p) + of_negative + decay * w

    return descend(gradient, p.shape[1])


def train(p: np.ndarray, u: np.ndarray, prior: float | None = None) -> tuple[list[np.ndarray], np.ndarray, float]:
    """(bin edges, weights, prior) from measures of positives and of unlabelled texts."""
    edges = [np.unique(np.append(np.quantile(u[:, i], MARKS), np.nextafter(u[:, i].min(), np.inf))) for i in range(u.shape[1])]
    hot_p, hot_u = binned(p, edges), binned(u, edges)
    if prior is None:  # fitted on one half, estimated on the other
        w = plain_model(hot_p[::2], hot_u[::2])
        prior = best_bin_prior(hot_p[1::2] @ w, hot_u[1::2] @ w) if len(p) > 1 and len(u) > 1 else 0.5
    return edges, non_negative_model(hot_p, hot_u, prior), prior


def scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, weights, _ = model.value
        for batch in batches:
            x = np.array([measures(t.as_py()) for t in batch.column(2)]).reshape(-1, MEASURES)
            score = np.zeros(len(x))
            for c in range(0, len(x), 4096):
                score[c:c + 4096] = sigmoid(binned(x[c:c + 4096], edges) @ weights)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["id", "held_out", "score", "predicted"]
            )

    return run


def held_out(id_col: str) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(positive, unlabelled, x): measures of about ``size`` positives and ``size`` unlabelled texts, none held out. A row can
    be both: the unlabelled texts are drawn from all, whatever their label.

    Rows are drawn by a hash of their id, as a share of the counts, so the number does not grow with the table.
    """
    draw = F.pmod(F.xxhash64(F.lit(17), F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)
    draw_u = F.pmod(F.xxhash64(F.lit(18), F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)
    positives = labels.where(F.col("quality") == 1).select(F.col(id_col)).where(~held_out(id_col)).distinct()
    n_positive = positives.count()
    n_all = docs.where(~held_out(id_col)).count()
    chosen = positives.where(draw <= size / max(n_positive, 1)).select(F.col(id_col).alias("_chosen"))
    rows = docs.select(id_col, F.col(text_col).cast("string").alias("text")).where(~held_out(id_col)).join(
        F.broadcast(chosen), F.col(id_col) == F.col("_chosen"), "left"  # about ``size`` ids
    ).select(F.col("_chosen").isNotNull().alias("positive"), (draw_u <= size / max(n_all, 1)).alias("unlabelled"), "text")
    return rows.where("positive OR unlabelled").mapInArrow(measured, "positive boolean, unlabelled boolean, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SAMPLE, prior: float | None = None):
    """(bin edges, weights, prior), trained on the samples; a model that scores 0.5 throughout if either is empty."""
    if prior is None:
        share = labels.where("quality IS NOT NULL").where(~held_out(id_col)).agg(F.avg((F.col("quality") == 1).cast("int"))).first()[0]
        prior = None if share in (None, 1.0) else min(max(share, 0.05), 0.98)
    rows = sample(docs, labels, id_col, text_col, size).toArrow()
    x = np.array(rows.column("x").to_pylist(), dtype=np.float64).reshape(-1, MEASURES)
    is_p, is_u = (rows.column(c).to_numpy() for c in ("positive", "unlabelled"))
    if is_p.any() and is_u.any():
        return train(x[is_p], x[is_u], prior)
    return [np.zeros(0)] * MEASURES, np.zeros(1 + MEASURES), 0.5


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SAMPLE, prior: float | None = None
) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score (0 to 1), predicted (score >= 0.5).

    Only the text is measured. Rows whose crc32 of the id's text has remainder 1 modulo 3 are held out: neither their
    labels nor their texts train. ``labels`` (id, quality) names the trusted positives by quality 1; other labels only
    count for the class prior. ``size`` bounds both training samples, which the driver holds as numbers; if either is empty, every
    score is 0.5. Null and empty texts measure 0 throughout and are scored like any other; null ids count as the
    empty text; repeated rows get equal scores; empty input gives empty output; other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, size, prior))
    scored = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return scored.mapInArrow(
        scorer(model), f"id {kind}, held_out boolean, score double, predicted int"
    ).withColumnRenamed("id", id_col)


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that :func:`quality_scores` predicts as 1, with all their columns; nothing is shuffled."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, size))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        edges, weights, _ = model.value
        return pd.Series(sigmoid(binned(np.array([measures(t) for t in texts]).reshape(-1, MEASURES), edges) @ weights))

    return docs.where(score(F.col(text_col).cast("string")) >= 0.5)
