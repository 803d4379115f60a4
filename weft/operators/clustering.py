"""k-Means by Lloyd's steps over array columns, with random and D^2 seeding, and bisecting k-Means.

Points are (id, features array<double>). Centroids are few and travel as one broadcast row, so every
step runs the same compiled plan; a step is one aggregation with partial sums. A cluster that loses its
points keeps its centroid. Seeding is by MD5 hashes of ids, so it does not depend on how rows are
partitioned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.vectors import distances_to, nearest, squared_distance

Centroids = list[list[float]]


def points_of(rows: DataFrame, id_col: str, columns: list[str] | str) -> DataFrame:
    """(id, features) from an array column or from several numeric columns."""
    features = F.transform(columns, lambda x: x.cast("double")) if isinstance(columns, str) else F.array(*[F.col(c).cast("double") for c in columns])
    return rows.select(F.col(id_col).alias("id"), features.alias("features")).where(~F.exists("features", lambda x: x.isNull() | F.isnan(x)))


def with_centroids(points: DataFrame, centroids: Centroids) -> DataFrame:
    """The points with the squared distances from all centroids in ``_d``; the centroids are one broadcast row."""
    row = points.sparkSession.createDataFrame(pa.table({"_centroids": pa.array([centroids], pa.list_(pa.list_(pa.float64())))}))
    return points.crossJoin(F.broadcast(row)).withColumn("_d", distances_to(F.col("features"), F.col("_centroids"))).drop("_centroids")


def assign(points: DataFrame, centroids: Centroids) -> DataFrame:
    """(id, features, cluster, dist2): the nearest centroid, the first of equals."""
    found = with_centroids(points, centroids)
    return found.select(*points.columns, nearest(F.col("_d")).alias("cluster"), F.array_min("_d").alias("dist2"))


def update(assigned: DataFrame, centroids: Centroids) -> tuple[Centroids, float]:
    """The clusters' means, and the inertia of the assignment; one row for each cluster comes back."""
    width = len(centroids[0])
    sums = assigned.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("dist2").alias("inertia"), *[F.avg(F.col("features")[i]).alias(f"f{i}") for i in range(width)])
    out, inertia = [list(c) for c in centroids], 0.0
    for row in sums.collect():
        out[row["cluster"]] = [float(row[f"f{i}"]) for i in range(width)]
        inertia += row["inertia"]
    return out, inertia


def uniform(id_col: str, *salt: int) -> Column:
    """A number in (0, 1) from the first 13 hexadecimal digits of an MD5 hash of the id and the salt, between dashes."""
    digits = F.substring(F.md5(F.concat_ws("-", F.col(id_col).cast("string"), *[F.lit(str(s)) for s in salt])), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / float(1 << 52)


def random_seeds(points: DataFrame, k: int, seed: int) -> Centroids:
    return [list(r["features"]) for r in points.orderBy(uniform("id", seed), "id").limit(k).collect()]


def plus_plus_seeds(points: DataFrame, k: int, seed: int) -> Centroids:
    """Each further seed is drawn with weight of its squared distance from the seeds so far, by exponential races."""
    chosen = random_seeds(points, 1, seed)
    for step in range(1, k):
        race = F.try_divide(-F.log(uniform("id", seed, step)), F.array_min("_d"))
        rows = with_centroids(points, chosen).withColumn("_race", race).where("_race IS NOT NULL").orderBy("_race", "id").limit(1).collect()
        if not rows:
            break
        chosen.append(list(rows[0]["features"]))
    return chosen


@dataclass
class Clustering:
    centroids: Centroids
    inertia: float
    iterations: int

    def predict(self, points: DataFrame) -> DataFrame:
        return assign(points, self.centroids)


def kmeans(points: DataFrame, k: int = 4, *, init: str | Centroids = "random", max_iter: int = 300, tol: float = 1e-4, seed: int = 42) -> Clustering:
    """Lloyd's steps until no coordinate moves by more than ``tol`` (plus 1e-5 of itself)."""
    own = not (points.storageLevel.useMemory or points.storageLevel.useDisk)  # a caller's cache stays
    points = points.persist(StorageLevel.MEMORY_AND_DISK) if own else points
    try:
        centroids = init if isinstance(init, list) else {"random": random_seeds, "k-means++": plus_plus_seeds}[init](points, k, seed)
        if not centroids:
            return Clustering([], 0.0, 0)
        for step in range(1, max_iter + 1):
            moved, _ = update(assign(points, centroids), centroids)
            still = np.allclose(moved, centroids, atol=tol)
            if still:
                break
            centroids = moved
        inertia = assign(points, centroids).agg(F.coalesce(F.sum("dist2"), F.lit(0.0))).first()[0]
        return Clustering(centroids, float(inertia), step)
    finally:
        if own:
            points.unpersist()


@dataclass
class Bisection:
    """A tree of splits: of each inner node its two children, of each leaf its cluster. Node 0 is the root."""

    centroids: Centroids
    inertia: float
    iterations: int
    node_centroids: Centroids
    children: dict[int, tuple[int, int]]
    leaves: list[int]

    def predict(self, points: DataFrame) -> DataFrame:
        """(id, features, cluster, dist2): down the tree, the nearer child each time, the first of equals."""
        at = F.col("_node")
        rows = with_centroids(points, self.node_centroids).withColumn("_node", F.lit(0))
        for _ in self.children:  # no deeper than there are splits
            down = at
            for node, (a, b) in self.children.items():
                down = F.when(at == node, F.when(F.col("_d")[b] < F.col("_d")[a], b).otherwise(a)).otherwise(down)
            rows = rows.withColumn("_node", down)
        cluster = F.array_position(F.array(*[F.lit(x) for x in self.leaves]), at) - 1
        return rows.select(*points.columns, cluster.cast("int").alias("cluster"), F.element_at("_d", at + 1).alias("dist2"))


def bisecting(points: DataFrame, k: int = 4, seed: int = 42, *, max_iter: int = 300, tol: float = 1e-4) -> Bisection:
    """Bisecting k-Means: the cluster with the highest inertia is split in two by k-Means, until there are ``k``.

    A cluster that can't be split (one point, or equal ones) is left as it is.
    """
    width = _width(points)
    first = points.agg(F.count("*").alias("n"), *[F.avg(F.col("features")[i]).alias(f"f{i}") for i in range(width)]).first()
    if not first["n"]:
        return Bisection([], 0.0, 0, [], {}, [])
    tree = Bisection([], 0.0, 0, [[float(first[f"f{i}"]) for i in range(width)]], {}, [0])
    inertia = {0: float(tree.predict(points).agg(F.sum("dist2")).first()[0])}
    while len(tree.leaves) < k and max(inertia.values()) > 0:
        worst = max(tree.leaves, key=lambda x: (inertia[x], -x))
        own = tree.predict(points).where(F.col("cluster") == tree.leaves.index(worst)).select(*points.columns)
        split = kmeans(own, 2, init="k-means++", seed=seed, max_iter=max_iter, tol=tol)
        tree.iterations += split.iterations
        if len(split.centroids) < 2:
            inertia[worst] = 0.0
            continue
        a = len(tree.node_centroids)
        tree.node_centroids += split.centroids
        tree.children[worst] = (a, a + 1)
        at = tree.leaves.index(worst)
        tree.leaves[at : at + 1] = [a, a + 1]
        parts = {r["cluster"]: r["s"] for r in split.predict(own).groupBy("cluster").agg(F.sum("dist2").alias("s")).collect()}
        inertia |= {a: float(parts.get(0, 0.0)), a + 1: float(parts.get(1, 0.0))}
        del inertia[worst]
    tree.centroids = [tree.node_centroids[x] for x in tree.leaves]
    tree.inertia = float(tree.predict(points).agg(F.sum("dist2")).first()[0])
    return tree


def centroid_table(spark, centroids: Centroids) -> DataFrame:
    return spark.createDataFrame([(i, c) for i, c in enumerate(centroids)], "cluster int, centroid array<double>")


# -- quality of a clustering ---------------------------------------------------------------------


def cluster_means(labelled: DataFrame, width: int) -> DataFrame:
    means = F.array(*[F.avg(F.col("features")[i]) for i in range(width)])
    return labelled.groupBy("cluster").agg(F.count("*").alias("n"), means.alias("mean"))


def _width(labelled: DataFrame) -> int:
    row = labelled.select(F.size("features").alias("n")).limit(1).collect()
    return row[0]["n"] if row else 0


def inertia(labelled: DataFrame) -> DataFrame:
    """Sum of squared distances from the clusters' means, as one row; means are few and broadcast."""
    means = cluster_means(labelled, _width(labelled)).select("cluster", "mean")
    return labelled.join(F.broadcast(means), "cluster").agg(F.sum(squared_distance(F.col("features"), F.col("mean"))).alias("inertia"))


def calinski_harabasz(labelled: DataFrame) -> DataFrame:
    """B / W (n - k) / (k - 1), as one row."""
    width = _width(labelled)
    means = cluster_means(labelled, width)
    centre = labelled.agg(F.array(*[F.avg(F.col("features")[i]) for i in range(width)]).alias("centre"), F.count("*").alias("all"))
    between = means.crossJoin(F.broadcast(centre)).agg(
        F.sum(F.col("n") * squared_distance(F.col("mean"), F.col("centre"))).alias("b"), F.count("*").alias("k"), F.first("all").alias("n")
    )
    return inertia(labelled).crossJoin(between).select(
        F.try_divide(F.col("b") * (F.col("n") - F.col("k")), F.col("inertia") * (F.col("k") - 1)).alias("calinski_harabasz")
    )


def silhouette(labelled: DataFrame, sample: int = 10_000, seed: int = 42) -> DataFrame:
    """Mean silhouette over a sample of at most ``sample`` points, those with the smallest MD5 hashes, as one row.

    The sample is bounded, so it is broadcast whole; each task compares its points with all of it in
    blocks. A point alone in its cluster counts 0.
    """
    chosen = labelled.orderBy(F.md5(F.concat_ws("-", F.col("id").cast("string"), F.lit(str(seed)))), "id").limit(sample).select("id", "features", F.col("cluster").cast("int").alias("cluster"))
    got = chosen.toArrow()
    if len(got) < 2:
        return labelled.sparkSession.createDataFrame([(None,)], "silhouette double")
    column = got.column("features").combine_chunks()
    x = column.flatten().to_numpy().reshape(len(got), -1)
    names, label = np.unique(got.column("cluster").to_numpy(), return_inverse=True)
    sent = labelled.sparkSession.sparkContext.broadcast((x, label, names, np.bincount(label)))

    @F.arrow_udf("double")
    def width(features: pa.Array, cluster: pa.Array) -> pa.Array:
        every, label, names, size = sent.value
        p = features.flatten().to_numpy().reshape(len(features), -1)
        own = np.searchsorted(names, cluster.to_numpy())
        out = np.zeros(len(p))
        for s in range(0, len(p), 256):
            q = p[s : s + 256]
            d = np.sqrt(np.maximum((q * q).sum(1)[:, None] + (every * every).sum(1) - 2 * q @ every.T, 0))
            total = np.stack([d[:, label == c].sum(1) for c in range(len(names))], 1)
            at, mine = np.arange(len(q)), own[s : s + 256]
            inside = total[at, mine] / np.maximum(size[mine] - 1, 1)
            mean = total / size
            mean[at, mine] = np.inf
            outside = mean.min(1)
            value = (outside - inside) / np.maximum(np.maximum(inside, outside), 1e-300)
            out[s : s + 256] = np.where((size[mine] < 2) | ~np.isfinite(outside), 0.0, value)
        return pa.array(out)

    rows = labelled.sparkSession.createDataFrame(got)
    return rows.agg(F.avg(width("features", "cluster")).alias("silhouette"))


# -- choice of k ---------------------------------------------------------------------------------


def fits_by_k(points: DataFrame, ks, init: str, seed: int):
    """(k, fit) for each k; seeds are drawn one after another, so those of a smaller k begin those of a larger one."""
    seeds = {"random": random_seeds, "k-means++": plus_plus_seeds}[init](points, max(ks), seed)
    for k in ks:
        yield k, kmeans(points, k, init=seeds[:k])


def inertia_by_k(points: DataFrame, ks=range(2, 11), init: str = "k-means++", seed: int = 42) -> DataFrame:
    """(k, inertia)."""
    return points.sparkSession.createDataFrame([(k, fit.inertia) for k, fit in fits_by_k(points, ks, init, seed)], "k int, inertia double")


def silhouette_by_k(points: DataFrame, ks=range(2, 11), init: str = "k-means++", seed: int = 42, sample: int = 10_000) -> DataFrame:
    """(k, silhouette)."""
    scores = [(k, silhouette(fit.predict(points), sample, seed).first()[0]) for k, fit in fits_by_k(points, ks, init, seed)]
    return points.sparkSession.createDataFrame(scores, "k int, silhouette double")


def knee(curve: DataFrame, x: str = "k", y: str = "inertia") -> DataFrame:
    """The knee of a convex falling curve of a few points: where it is furthest below the line between its ends."""
    every = Window.partitionBy(F.lit(0))
    scaled = curve.select(
        x, ((F.col(x) - F.min(x).over(every)) / (F.max(x).over(every) - F.min(x).over(every))).alias("_x"),
        ((F.col(y) - F.min(y).over(every)) / (F.max(y).over(every) - F.min(y).over(every))).alias("_y"),
    )
    return scaled.select(x, (1 - F.col("_y") - F.col("_x")).alias("below")).orderBy(F.desc("below"), x).limit(1).select(F.col(x).alias("knee"))


def best_k(scores: DataFrame) -> DataFrame:
    return scores.orderBy(F.desc("silhouette"), "k").limit(1).select("k")
