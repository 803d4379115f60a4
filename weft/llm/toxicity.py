"""Toxicity severity by cumulative-link ordinal regression.

Grades 0..3 are ordered; one weight vector over hashed words and beginnings of words, at three levels
of how often they come, is shared by all thresholds: P(grade > k) = logistic(w.x - t_k), t_0 < t_1 < t_2.
The expected severity is the sum of the three probabilities.

Labels only say toxic or not, so the grades above 0 of labelled toxic rows come from how densely they
use markers, indicators far more frequent in toxic than in other labelled rows: thirds of the density
are grades 1, 2, 3. The grades are thus made from the features that then predict them; which rows are
toxic is tested on held-out labels, but no data here say how severe a row is, so severity isn't validated.

A row is judged toxic if its probability of grade 1 or more reaches the model's limit; then its grade is
the likeliest of 1 to 3, else 0. The limit is the lowest at which at most ``MOST_FALSE`` of the sample's
clean rows would be judged toxic by models that haven't seen them (``FOLDS`` parts), within ``LIMITS``.

The sample is bounded and chosen by a hash of the id; indicators are screened by the root of their
likelihood ratio, in itself and against the strongest one's, before fitting, so that chance words have
no weight.

Defined cases: null and empty texts have no indicators and the severity of the thresholds alone; very
long texts are taken whole; without labelled rows, or with one class only, the severity is that of the
smoothed share of toxic rows and the limit one half; a probability at the limit is toxic, and of equally
likely grades the smaller is taken; an id labelled more than once has its smallest label; null ids are
never learnt from; repeated rows each get a row; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm._common import bounded_batches, give_back, text_of
from weft.llm._features import SIZE, class_counts, indicators, labelled_sample, pieces

GRADES = 3
#: Share of clean rows that may be judged toxic, parts of the sample, and bounds of the limit. A missed toxic row costs more than a look at a clean one.
MOST_FALSE, FOLDS, LIMITS = 0.005, 4, (0.05, 0.5)


@dataclass
class SeverityModel:
    feature: np.ndarray  # sorted
    weight: np.ndarray
    thresholds: np.ndarray
    limit: float = 0.5

    def probabilities(self, ids: np.ndarray) -> np.ndarray:
        """P(grade > k) for k = 0, 1, 2."""
        total = 0.0
        if len(self.feature):
            at = np.minimum(np.searchsorted(self.feature, ids), len(self.feature) - 1)
            total = self.weight[at][self.feature[at] == ids].sum()
        return 1 / (1 + np.exp(-np.clip(total - self.thresholds, -30, 30)))


def z_scores(indptr: np.ndarray, index: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each indicator the signed root of the likelihood ratio against no link with toxic rows, and the number of rows."""
    a, b = (c.astype(float) for c in class_counts(indptr, index, toxic, clean))
    n, m = float(toxic.sum()), float(clean.sum())
    part = lambda seen, expected: seen * np.log(np.maximum(seen, 1e-300) / np.maximum(expected, 1e-300))
    share = n / (n + m)
    ratio = part(a, (a + b) * share) + part(b, (a + b) * (1 - share))
    ratio += part(n - a, (n + m - a - b) * share) + part(m - b, (n + m - a - b) * (1 - share))
    return np.sign(a / n - b / m) * np.sqrt(np.maximum(2 * ratio, 0)), a + b


def grades(indptr: np.ndarray, index: np.ndarray, toxic: np.ndarray, z: np.ndarray) -> np.ndarray:
    """0 for rows that aren't toxic; 1 to 3 by thirds of the density of markers for those that are."""
    marker, sizes = z > 4.0, np.diff(indptr)
    found = np.concatenate([np.bincount(row, marker[index[indptr[a] : indptr[b]]], b - a) for a, b, row in pieces(indptr)])
    density = found / np.maximum(np.sqrt(sizes), 1)
    cuts = np.quantile(density[toxic], [1 / 3, 2 / 3])
    return np.where(toxic, 1 + np.searchsorted(cuts, density, "left"), 0)


def loss_and_gradient(theta: np.ndarray, r: np.ndarray, f: np.ndarray, grade: np.ndarray, features: int, ridge: float) -> tuple[float, np.ndarray]:
    """The penalised negative log-likelihood and its gradient at (weights, first threshold, logs of the gaps)."""
    n, w, free = len(grade), theta[:features], theta[features:]
    gaps = np.exp(free[1:])
    t = free[0] + np.concatenate([[0.0], np.cumsum(gaps)])
    u = np.bincount(r, w[f], n)
    s = 1 / (1 + np.exp(-np.clip(u[:, None] - t, -30, 30)))  # P(grade > k)
    at = np.arange(n), grade
    low = np.concatenate([np.ones((n, 1)), s], 1)[at]
    high = np.concatenate([s, np.zeros((n, 1))], 1)[at]
    p = np.maximum(low - high, 1e-9)
    slope = s * (1 - s)
    dl = np.concatenate([np.zeros((n, 1)), slope], 1)[at] / p
    dh = np.concatenate([slope, np.zeros((n, 1))], 1)[at] / p
    gt = np.array([dl[grade == k + 1].sum() - dh[grade == k].sum() for k in range(GRADES)])
    gw = np.bincount(f, (dh - dl)[r], features) + ridge * w
    gf = np.concatenate([[gt.sum()], [gaps[k] * gt[k + 1 :].sum() for k in range(GRADES - 1)]])
    return float(-np.log(p).sum() + ridge / 2 * (w @ w)), np.concatenate([gw, gf])


def fit(indptr: np.ndarray, index: np.ndarray, label: np.ndarray, **options) -> SeverityModel:
    """The model of all rows, with a limit from models that haven't seen the rows that they judge."""
    n, toxic = len(label), label == 1
    model = fit_grades(indptr, index, label, np.ones(n, bool), **options)
    if n < 10 * FOLDS or toxic.sum() < FOLDS or (~toxic).sum() < FOLDS:
        return model
    chance = np.empty(n)
    for part in range(FOLDS):
        mine = np.arange(n) % FOLDS == part
        rest = fit_grades(indptr, index, label, ~mine, **options)
        for i in np.flatnonzero(mine):
            chance[i] = rest.probabilities(index[indptr[i] : indptr[i + 1]])[0]
    clean = np.sort(chance[~toxic])[::-1]
    highest = clean[min(int(MOST_FALSE * len(clean)), len(clean) - 1)]  # may not be reached
    model.limit = float(np.clip(np.nextafter(highest, 1), *LIMITS))
    return model


def fit_grades(indptr: np.ndarray, index: np.ndarray, label: np.ndarray, rows: np.ndarray, *, least_z: float = 5.0, least_share: float = 0.3, least_rows: int = 4, most_features: int = 4096, steps: int = 600, ridge: float = 1.0) -> SeverityModel:
    """Thresholds and weights from the rows of a mask."""
    toxic, clean = rows & (label == 1), rows & (label != 1)
    if not toxic.any() or not clean.any():
        share = (toxic.sum() + 1) / (rows.sum() + 2)
        return SeverityModel(np.empty(0, np.int64), np.empty(0), np.array([np.log((1 - share) / share), *[30.0] * (GRADES - 1)]))
    z, seen = z_scores(indptr, index, toxic, clean)
    grade = grades(indptr, index, toxic, z)[rows]
    z[seen < least_rows] = 0
    best = np.argsort(-np.abs(z), kind="stable")[:most_features]
    feature = np.sort(best[np.abs(z[best]) >= max(least_z, least_share * np.abs(z[best[0]]))])
    place = np.full(SIZE, -1, np.int32)
    place[feature] = np.arange(len(feature))
    number = np.cumsum(rows) - 1  # of a row among those of the mask
    found = []
    for a, b, row in pieces(indptr):
        at = place[index[indptr[a] : indptr[b]]]
        used = (at >= 0) & rows[a:b][row]
        found.append((number[a:b][row[used]], at[used]))
    r, f = (np.concatenate(x) for x in zip(*found))

    w = np.zeros(len(feature))
    share = np.array([(grade > k).mean() for k in range(GRADES)])
    t = np.log((1 - share + 1e-3) / (share + 1e-3))
    t = np.maximum.accumulate(t + 1e-3 * np.arange(GRADES))
    free = np.concatenate([[t[0]], np.log(np.maximum(np.diff(t), 1e-3))])  # gaps stay positive
    theta = np.concatenate([w, free])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        g = loss_and_gradient(theta, r, f, grade, len(feature), ridge)[1]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        theta = theta - 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    free = theta[len(w) :]
    return SeverityModel(feature.astype(np.int64), theta[: len(w)], free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))]))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_rows: int = 12_000) -> SeverityModel:
    """The model from at most ``most_rows`` labelled rows outside the held-out fold."""
    model = fit(*labelled_sample(docs, labels, label_col, most=most_rows, id_col=id_col, text_col=text_col, kind="beginnings"))
    give_back(docs.sparkSession)
    return model


def severity(model: SeverityModel, text_col: str = "text") -> Column:
    """struct(severity, grade, toxic) of a text column: expected severity 0 to 3, the grade, and the judgement."""
    parts = (model.feature, model.weight, model.thresholds, model.limit)

    @F.arrow_udf("struct<severity: double, grade: int, toxic: int>")
    def judged(text: pa.Array) -> pa.Array:
        of, small = indicators("beginnings").of, SeverityModel(*parts)
        over = [small.probabilities(of(t)) for t in text.cast(pa.binary()).to_pylist()]
        over = np.array(over).reshape(-1, GRADES)
        toxic = over[:, 0] >= small.limit
        likeliest = 1 + (-np.diff(np.concatenate([over, np.zeros((len(over), 1))], 1), axis=1)).argmax(1)
        return pa.StructArray.from_arrays(
            [pa.array(over.sum(1)), pa.array(np.where(toxic, likeliest, 0), pa.int32()), pa.array(toxic.astype(np.int32))],
            ["severity", "grade", "toxic"],
        )

    return judged(text_of(text_col))


def grade_texts(docs: DataFrame, model: SeverityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, severity, grade, toxic) for each row."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col), severity(model, text_col).alias("s")).select(id_col, "s.*")
