"""Clusterings and their measures against plain loops."""

import numpy as np
import pytest

from weft.operators import clustering, exam, reduction
from weft.streaming.counters import windowed_counters


def points(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, features array<double>")


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.RandomState(0)
    return np.concatenate([rng.normal(c, 0.3, (30, 2)) for c in ((0, 0), (5, 0), (0, 5), (5, 5))])


@pytest.mark.parametrize("init", ["random", "k-means++"])
def test_kmeans_is_a_fixed_point(spark, blobs, init):
    found = clustering.kmeans(points(spark, blobs), 4, init=init)
    c = np.array(found.centroids)
    label = ((blobs[:, None] - c) ** 2).sum(2).argmin(1)
    assert found.inertia == pytest.approx(((blobs - c[label]) ** 2).sum())
    again = np.array([blobs[label == k].mean(0) for k in range(4)])
    assert np.allclose(again, c, atol=1e-3)


def test_inertia_never_rises(spark, blobs):
    p = points(spark, blobs)
    c = clustering.random_seeds(p, 4, 1)
    last = np.inf
    for _ in range(5):
        c, now = clustering.update(clustering.assign(p, c), c)
        assert now <= last + 1e-9
        last = now


def test_empty_clusters_keep_their_centroids(spark):
    p = points(spark, [[0.0], [1.0]])
    moved, _ = clustering.update(clustering.assign(p, [[0.0], [100.0]]), [[0.0], [100.0]])
    assert moved == [[0.5], [100.0]]


def test_equal_points_and_no_points(spark):
    assert clustering.kmeans(points(spark, [[1.0, 1.0]] * 5), 3, init="k-means++").inertia == 0.0
    assert clustering.kmeans(points(spark, np.empty((0, 2))), 3).centroids == []


def test_bisecting(spark, blobs):
    found = clustering.bisecting(points(spark, blobs), 4)
    assert len(found.centroids) == 4 and found.inertia < 60 and found.iterations >= 3
    label = {r.id: (r.cluster, r.dist2) for r in found.predict(points(spark, blobs)).collect()}
    c = np.array(found.centroids)
    assert sum(d for _, d in label.values()) == pytest.approx(found.inertia)
    for i, p in enumerate(blobs):
        assert label[i][1] == pytest.approx(((p - c[label[i][0]]) ** 2).sum())
    # the centroids are the means of their points
    for k in range(4):
        assert np.allclose(blobs[[label[i][0] == k for i in range(len(blobs))]].mean(0), c[k], atol=1e-3)


def test_bisecting_splits_the_highest_inertia(spark):
    """Two far groups, one tight and large, one loose: the loose one is split next, whatever their sizes."""
    x = [[0.0 + i * 0.001] for i in range(50)] + [[100.0], [101.0], [109.0], [110.0]]
    found = clustering.bisecting(points(spark, x), 3)
    assert sorted(round(c[0], 1) for c in found.centroids) == [0.0, 100.5, 109.5]
    assert clustering.bisecting(points(spark, [[1.0]] * 4), 3).centroids == [[1.0]]
    assert clustering.bisecting(points(spark, np.empty((0, 2))), 3).centroids == []


def test_silhouette_with_a_lone_point(spark):
    x, label = [[0.0], [1.0], [10.0], [11.0], [50.0]], [0, 0, 1, 1, 2]
    frame = spark.createDataFrame([(i, v, c) for i, (v, c) in enumerate(zip(x, label))], "id bigint, features array<double>, cluster int")
    d = np.abs(np.array(x) - np.array(x).T)
    expected = []
    for i, c in enumerate(label):
        own = [d[i, j] for j in range(5) if label[j] == c and j != i]
        if not own:
            expected.append(0.0)
            continue
        a = np.mean(own)
        b = min(np.mean([d[i, j] for j in range(5) if label[j] == o]) for o in set(label) - {c})
        expected.append((b - a) / max(a, b))
    assert clustering.silhouette(frame).first()[0] == pytest.approx(np.mean(expected))


def test_knee_and_best_k(spark):
    curve = spark.createDataFrame([(k, v) for k, v in zip(range(2, 9), (100.0, 60.0, 20.0, 18.0, 16.0, 14.0, 12.0))], "k int, inertia double")
    assert clustering.knee(curve).first()[0] == 4
    scores = spark.createDataFrame([(2, 0.5), (3, 0.7), (4, 0.7)], "k int, silhouette double")
    assert clustering.best_k(scores).first()[0] == 3


def test_mixed_components_against_numpy(spark):
    rng = np.random.RandomState(1)
    rows = [(f"u{i}", float(rng.normal()), float(rng.normal()) * 3, rng.choice(["a", "b", "c"])) for i in range(60)]
    frame = spark.createDataFrame(rows, "id string, x double, y double, c string")
    model = reduction.fit(frame, "id", ["x", "y"], ["c"])
    num = np.array([[r[1], r[2]] for r in rows])
    cols = [(num - num.mean(0)) / num.std(0)]
    for v in "abc":
        ind = np.array([float(r[3] == v) for r in rows])
        cols.append(((ind / np.sqrt(ind.mean())) - np.sqrt(ind.mean()))[:, None])
    z = np.concatenate(cols, 1)
    values, vectors = np.linalg.eigh(z.T @ z / len(z))
    assert np.allclose(model.eigenvalues, values[::-1][:2])
    got = {r["id"]: (r.pc0, r.pc1) for r in model.transform(frame).collect()}
    for k in range(2):
        expected = z @ vectors[:, ::-1][:, k]
        mine = np.array([got[r[0]][k] for r in rows])
        assert np.allclose(np.abs(mine), np.abs(expected), atol=1e-8)


def test_mixed_components_refuse_too_many_categories(spark):
    frame = spark.createDataFrame([(str(i), float(i), f"c{i}", "d") for i in range(30)], "id string, x double, c string, d string")
    with pytest.raises(ValueError, match="c has more than 20"):
        reduction.fit(frame, "id", ["x"], ["c", "d"], most_categories=20)
    assert len(reduction.fit(frame, "id", ["x"], ["c", "d"]).names) == 32


def exhaustive(score, marks):
    if not marks:
        return score
    return max(exhaustive(m, [x + score - m for j, x in enumerate(marks) if j != i]) for i, m in enumerate(marks))


def test_exam_closed_form(spark):
    rng = np.random.RandomState(2)
    cases = [(int(rng.randint(0, 40)), [int(x) for x in rng.randint(0, 60, n)]) for n in (0, 1, 2, 3, 4, 5) for _ in range(4)]
    frame = spark.createDataFrame(cases, "score int, marks array<int>").withColumn("best", exam.best_score())
    assert [r.best for r in frame.collect()] == [exhaustive(s, m) for s, m in cases]
    assert exam.examples(spark).select(exam.best_score()).first()[0] == 11
    assert exam.examples(spark).select(exam.greedy_score()).first()[0] == 25


def test_streaming_counters(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("2024-01-01 10:00:00", 5.0, "u"), ("2024-01-01 12:00:00", 7.0, "u"), ("2024-01-02 12:00:00", -1.0, "u"), ("2024-01-05 12:00:00", 1.0, "v")], "datetime string, duration double, user_id string").write.parquet(source)
    stream = spark.readStream.schema("datetime string, duration double, user_id string").parquet(source)
    query = windowed_counters(stream).writeStream.format("memory").queryName("counted").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = [(r.user_id, r.clicks, r.total_time) for r in spark.table("counted").collect()]
    assert got == [("u", 2, 12.0)]  # the last window is still open


def test_exam_expand_has_every_case(spark):
    from weft.plans.catalogue import QUERIES

    by_marks = lambda name: {(r.score, r.marks): r.best for r in QUERIES[name](spark, "").collect()}
    found = by_marks("exam_expand")
    assert len(found) == len(exam.EXAMPLES) and found == by_marks("exam_best_score") and 205 in found.values()
