"""Quality classifier: naive Bayes support vectors.

Hashed n-gram indicators (words, word pairs, and one to three word shapes) are scaled by the classes'
log-count ratios, brought to length one, and separated by a linear model with hinge loss, fitted by
dual coordinate descent on a bounded, hash-chosen sample of labelled rows. A logistic curve, fitted
on a part of the sample that the linear model has not seen, turns margins into scores.

Defined cases: null and empty texts have no indicators and score by the bias alone; very long texts and
words are taken whole; without labelled rows, or with one class only, every score is the smoothed share
of label 1; a score of one half is predicted 1; an id labelled more than once has its smallest label;
null ids are never held out and never learnt from; repeated rows each get a row; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm._common import bounded_batches, give_back, text_of
from weft.llm._features import SIZE, class_counts, in_fold, indicators, labelled_sample, pieces


@dataclass
class QualityModel:
    #: Weight of each indicator times its ratio, and the squared ratio, for the length of a row.
    weight: np.ndarray
    square: np.ndarray
    bias: float
    slope: float
    offset: float

    def score(self, ids: np.ndarray) -> float:
        length = np.sqrt(self.square[ids].sum())
        margin = self.bias + (self.weight[ids].sum() / length if length else 0.0)
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30))))


def dual_coordinate_descent(indptr, index, value, y, *, c: float, epochs: int, rows: np.ndarray | None = None, seed: int = 7) -> np.ndarray:
    """Weights of the L2-regularised linear model with hinge loss, of the rows (places; all by default); y is -1 or 1; the last weight is the bias."""
    rows = np.arange(len(y)) if rows is None else rows
    n, w, bias = len(rows), np.zeros(SIZE), 0.0
    alpha = np.zeros(len(y))
    square = np.array([(value[a:b] ** 2).sum() for a, b in zip(indptr, indptr[1:])]) + 1.0
    share = {s: n / (2 * max(1, (y[rows] == s).sum())) for s in (-1, 1)}  # both classes weigh the same
    most = np.array([c * share[s] for s in y])
    rng = np.random.RandomState(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rows[rng.permutation(n)]:
            a, b = indptr[i], indptr[i + 1]
            at, x = index[a:b], value[a:b]
            gradient = y[i] * ((w[at] * x).sum() + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), most[i])
            step = new - alpha[i]
            if step:
                alpha[i] = new
                w[at] += step * y[i] * x
                bias += step * y[i]
                worst = max(worst, abs(step))
        if worst < 1e-3 * c:
            break
    return np.append(w, bias)


def fit(indptr: np.ndarray, index: np.ndarray, label: np.ndarray, *, c: float = 4.0, epochs: int = 30, smooth: float = 1.0, least_rows: int = 3) -> QualityModel:
    n = len(label)
    good = int((label == 1).sum())
    if n == 0 or good in (0, n):
        share = (good + 1) / (n + 2)
        return QualityModel(np.zeros(SIZE), np.zeros(SIZE), 0.0, 0.0, float(np.log(share / (1 - share))))
    first, second = class_counts(indptr, index, label == 1, label != 1)
    p, q = first + smooth, second + smooth
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    ratio[first + second < least_rows] = 0.0
    value = ratio.astype(np.float32)[index]
    for a, b, row in pieces(indptr):
        part = value[indptr[a] : indptr[b]]
        part /= np.maximum(np.sqrt(np.bincount(row, part.astype(np.float64) ** 2, b - a)), 1e-12)[row]
    y = np.where(label == 1, 1, -1)

    learnt = np.arange(n) % 5 != 0  # the rest is for the curve
    w = dual_coordinate_descent(indptr, index, value, y, c=c, epochs=epochs, rows=np.flatnonzero(learnt))
    margin = np.concatenate([np.bincount(row, w[index[indptr[a] : indptr[b]]] * value[indptr[a] : indptr[b]], b - a) for a, b, row in pieces(indptr)]) + w[-1]
    slope, offset = logistic_curve(margin[~learnt], label[~learnt] == 1) if (~learnt).sum() > 20 else (2.0, 0.0)
    return QualityModel(w[:-1] * ratio, ratio**2, float(w[-1]), slope, offset)


def logistic_curve(margin: np.ndarray, is_good: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps on smoothed targets, lightly held to slope 2 and offset 0."""
    pos, neg = is_good.sum(), (~is_good).sum()
    target = np.where(is_good, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margin, np.ones_like(margin)], 1)
    theta, prior = np.array([2.0, 0.0]), np.array([2.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ (p - target) + 0.01 * (theta - prior)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        theta = theta - np.clip(step, -2, 2)
        if abs(step).max() < 1e-6:
            break
    return (float(theta[0]), float(theta[1])) if theta[0] > 0 else (2.0, 0.0)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = 6000) -> QualityModel:
    """The model from at most ``most_rows`` labelled rows outside the held-out fold."""
    model = fit(*labelled_sample(docs, labels, label_col, most=most_rows, id_col=id_col, text_col=text_col, kind="n-grams"))
    give_back(docs.sparkSession)
    return model


def score(model: QualityModel, text_col: str = "text") -> Column:
    """The score of a text column, 0 to 1."""
    weight, square = model.weight.astype(np.float32), model.square.astype(np.float32)
    rest = (model.bias, model.slope, model.offset)

    @F.arrow_udf("double")
    def scored(text: pa.Array) -> pa.Array:
        of, small = indicators("n-grams").of, QualityModel(weight, square, *rest)
        return pa.array([small.score(of(t)) for t in text.cast(pa.binary()).to_pylist()], pa.float64())

    return scored(text_of(text_col))


def classify(docs: DataFrame, model: QualityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for each row."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col), in_fold(id_col, 1).alias("held_out"), score(model, text_col).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )
