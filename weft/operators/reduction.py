"""Factor analysis of mixed data: numeric columns as z-scores, categories as weighted indicators, then components.

Each indicator is divided by the root of its share and centred, so a rare category weighs as much as a
common one. The covariance of the joined columns has a size that follows the columns only; it is
summed where the rows are and decomposed on the driver by the ML library. A component's sign makes its
largest loading positive.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class MixedComponents:
    id_col: str
    columns: list[Column]
    names: list[str]
    loadings: np.ndarray  # names x components
    eigenvalues: np.ndarray
    explained: np.ndarray

    def transform(self, rows: DataFrame) -> DataFrame:
        """(id, pc0, pc1, ...)."""
        parts = [sum((c * float(w) for c, w in zip(self.columns, self.loadings[:, k])), F.lit(0.0)) for k in range(self.loadings.shape[1])]
        return rows.select(self.id_col, *[p.alias(f"pc{k}") for k, p in enumerate(parts)])

    def summary(self, spark) -> DataFrame:
        """(component, eigenvalue, explained, cumulative)."""
        rows = zip(range(len(self.eigenvalues)), self.eigenvalues.tolist(), self.explained.tolist(), np.cumsum(self.explained).tolist())
        return spark.createDataFrame(list(rows), "component int, eigenvalue double, explained double, cumulative double")


def categories(rows: DataFrame, columns: list[str], most: int) -> dict[str, list[tuple[str, int]]]:
    """(value, rows) of each column, counted in one pass; a column with more than ``most`` values is an error, as the model has a column for each."""
    long = rows.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))).where("value IS NOT NULL")
    found: dict[str, list[tuple[str, int]]] = {}
    for column, value, n in long.groupBy("column", "value").agg(F.count("*").alias("n")).limit(len(columns) * most + 1).collect():
        found.setdefault(column, []).append((value, n))
    for column, values in found.items():
        if len(values) > most:
            raise ValueError(f"{column} has more than {most} categories")
    return found


def fit(rows: DataFrame, id_col: str, numeric: list[str], categorical: list[str], components: int = 2, most_categories: int = 500) -> MixedComponents:
    """Null numbers count as the mean, null categories as no category."""
    facts = rows.agg(
        F.count("*").alias("n"),
        *[F.avg(c).alias(f"m_{c}") for c in numeric],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in numeric],
    ).first()
    n = facts["n"]
    columns, names = [], []
    for c in numeric:
        if facts[f"s_{c}"]:
            columns.append(F.coalesce((F.col(c) - facts[f"m_{c}"]) / facts[f"s_{c}"], F.lit(0.0)))
            names.append(c)
    counted = categories(rows, categorical, most_categories) if categorical else {}
    for c in categorical:
        for value, k in sorted(counted.get(c, [])):
            share = k / n
            columns.append(F.when(F.col(c) == value, 1.0).otherwise(0.0) / float(np.sqrt(share)) - float(np.sqrt(share)))
            names.append(f"{c}={value}")
    d = len(columns)
    if n < 2 or not d:
        return MixedComponents(id_col, columns, names, np.zeros((d, components)), np.zeros(components), np.zeros(components))
    # products are summed in one matrix a task, and the matrices by a tree; columns have mean 0
    vectors = rows.select(F.array(*columns).alias("v"))
    total = vectors.agg(F.avg(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0]
    model = PCA(k=min(components, d), inputCol="v", outputCol="pc").fit(vectors.select(array_to_vector("v").alias("v")))
    loadings, explained = model.pc.toArray(), model.explainedVariance.toArray()
    loadings = loadings * np.where(loadings[np.abs(loadings).argmax(0), np.arange(loadings.shape[1])] < 0, -1, 1)
    return MixedComponents(id_col, columns, names, loadings, explained * total, explained)
