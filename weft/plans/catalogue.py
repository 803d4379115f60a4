"""The engine's queries over a data folder, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import classify
from weft.operators import clustering, exam, features, minhash, reduction, reports
from weft.operators.cleaning import clean, null_counts
from weft.sources.clicks import raw_clicks, read_click_columns, read_clicks_csv, read_field_unquoted, read_table, write_clicks_csv
from weft.storage import fresh_path, materialise

Query = Callable[[SparkSession, str], DataFrame]
EXAMPLE_USER = "u000007"


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(raw_clicks(spark, sf_dir))


def csv_log(spark: SparkSession, sf_dir: str) -> str:
    """The raw log written as CSV; its path."""
    path = fresh_path(spark, "clicks-csv")
    write_clicks_csv(raw_clicks(spark, sf_dir), path)
    return path


def csv_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_clicks_csv(spark, csv_log(spark, sf_dir)).withColumn("datetime", F.expr("try_cast(datetime AS timestamp_ntz)"))


def csv_third_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and mean of the third field, durations, between commas of plain lines."""
    value = F.expr("try_cast(value AS double)")
    return rounded(read_field_unquoted(spark, csv_log(spark, sf_dir), 3).agg(F.count("*").alias("clicks"), F.avg(value).alias("avg_duration")))


def csv_fourth_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent fourth field, titles, between commas of plain lines."""
    return reports.most_watched_title(read_field_unquoted(spark, csv_log(spark, sf_dir), 4).withColumnRenamed("value", "title"))


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.summary(clicks(spark, sf_dir))


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's most clicked titles, written once, as the recommender reads them several times."""
    return materialise(features.top_titles(clicks(spark, sf_dir)), "titles")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c).cast("bigint").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in df.dtypes])


def joined(c: str, sep: str = ",") -> Column:
    return F.concat_ws(sep, F.transform(c, lambda x: x.cast("string"))).alias(c)


def _total(feature: str) -> Query:
    return lambda spark, d: rounded(features.totals(summary(spark, d)).select("user_id", feature))


def _class(feature: str) -> Query:
    return lambda spark, d: features.dominant_classes(summary(spark, d), feature).where(F.col(feature).isNotNull())


def user_features(spark: SparkSession, d: str) -> DataFrame:
    return features.user_features(clicks(spark, d))


def imputed(spark: SparkSession, d: str) -> DataFrame:
    return features.impute(user_features(spark, d))


def _profile(column: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = imputed(spark, d).withColumn("cluster", F.substring("user_id", 2, 6).cast("int") % 4)
        return rounded(features.cluster_profile(rows, column))

    return run


def user_genres(spark: SparkSession, d: str) -> DataFrame:
    return minhash.user_genres(titles(spark, d)).select("user_id", joined("genres"))


def characteristic_matrix(spark: SparkSession, d: str) -> DataFrame:
    return minhash.characteristic_matrix(titles(spark, d)).select("user_id", joined("genres", ""))


def minhash_signature(spark: SparkSession, d: str) -> DataFrame:
    return rounded(minhash.signatures(titles(spark, d)).select("user_id", F.posexplode("signature").alias("hash", "value")))


def embedding_points(spark: SparkSession, d: str) -> DataFrame:
    return clustering.points_of(read_table(spark, d, "embeddings"), "vec_id", "embedding")


def first_centroids(points: DataFrame, k: int = 4) -> clustering.Centroids:
    return [list(r["features"]) for r in points.orderBy("id").limit(k).collect()]


def kmeans_assign_step(spark: SparkSession, d: str) -> DataFrame:
    points = embedding_points(spark, d)
    return rounded(clustering.assign(points, first_centroids(points)).select(F.col("id").alias("vec_id"), "cluster", "dist2"))


def kmeans_update_step(spark: SparkSession, d: str) -> DataFrame:
    points = embedding_points(spark, d)
    centroids = first_centroids(points)
    moved, _ = clustering.update(clustering.assign(points, centroids), centroids)
    return rounded(clustering.centroid_table(spark, moved).select("cluster", F.posexplode("centroid").alias("dim", "value")))


def _embedding_fit(init: str) -> Query:
    """Seeding and five of Lloyd's steps on the embeddings, which SQL can follow."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        points = embedding_points(spark, d)
        found = clustering.kmeans(points, init=init, max_iter=5, tol=0.0)
        return rounded(found.predict(points).select(F.col("id").alias("vec_id"), "cluster", "dist2"))

    return run


def famd_model(spark: SparkSession, d: str) -> tuple[reduction.MixedComponents, DataFrame]:
    rows = materialise(imputed(spark, d), "features")
    categorical = ["favourite_genre", *features.CLASSES]
    numeric = [c for c in features.FEATURES if c not in categorical]
    return reduction.fit(rows, "user_id", numeric, categorical), rows


def famd(spark: SparkSession, d: str) -> DataFrame:
    model, rows = famd_model(spark, d)
    return model.transform(rows)


def famd_eigenvalues(spark: SparkSession, d: str) -> DataFrame:
    model, _ = famd_model(spark, d)
    return rounded(model.summary(spark))


def user_points(spark: SparkSession, d: str) -> DataFrame:
    return materialise(clustering.points_of(famd(spark, d), "user_id", ["pc0", "pc1"]), "points")


def _fit(init: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        points = user_points(spark, d)
        found = clustering.bisecting(points) if init == "bisecting" else clustering.kmeans(points, init=init)
        return rounded(found.predict(points).select(F.col("id").alias("user_id"), "cluster", "dist2"))

    return run


def component_scatter(spark: SparkSession, d: str) -> DataFrame:
    """The plane of the two components with the categories that it is coloured by."""
    model, rows = famd_model(spark, d)
    kinds = rows.select("user_id", "most_active_time_day", "most_common_click_length")
    return rounded(model.transform(rows).join(kinds, "user_id"))


def centroid_scatter(spark: SparkSession, d: str) -> DataFrame:
    """The users in the plane with their clusters, and the centroids among them."""
    points = user_points(spark, d)
    found = clustering.kmeans(points, init="k-means++")
    plane = lambda rows, v: rows.select("cluster", F.col(v)[0].alias("pc0"), F.col(v)[1].alias("pc1"), F.lit(v == "centroid").alias("is_centroid"))
    return rounded(plane(found.predict(points), "features").unionByName(plane(clustering.centroid_table(spark, found.centroids), "centroid")))


def sample_users(spark: SparkSession, d: str) -> DataFrame:
    """Ten users without replacement, the same whatever the partitions."""
    users = features.user_features(clicks(spark, d)).select("user_id", "favourite_genre")
    return users.orderBy(clustering.uniform("user_id", 42), "user_id").limit(10)


def labelled_embeddings(spark: SparkSession, d: str) -> DataFrame:
    points = embedding_points(spark, d)
    labels = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"))
    return points.join(labels, "id")


def clustering_report(spark: SparkSession, d: str) -> DataFrame:
    """(algorithm, iterations, inertia): how the three algorithms converge on the same points."""
    points = user_points(spark, d)
    fits = {"k-means": clustering.kmeans(points), "k-means++": clustering.kmeans(points, init="k-means++"), "bisecting": clustering.bisecting(points)}
    return rounded(spark.createDataFrame([(name, f.iterations, f.inertia) for name, f in fits.items()], "algorithm string, iterations int, inertia double"))


def elbow(spark: SparkSession, d: str) -> DataFrame:
    curve = clustering.inertia_by_k(user_points(spark, d))
    return rounded(curve.crossJoin(clustering.knee(curve)))


def best_silhouette_k(spark: SparkSession, d: str) -> DataFrame:
    return rounded(clustering.best_k(clustering.silhouette_by_k(user_points(spark, d))))


def exam_rows(found: DataFrame) -> DataFrame:
    return found.select(F.col("score").cast("bigint").alias("score"), joined("marks"), "best")


QUERIES: dict[str, Query] = {
    "raw_clicks": raw_clicks,
    "csv_clicks": csv_clicks,
    "csv_third_field": csv_third_field,
    "csv_fourth_field": csv_fourth_field,
    "csv_heaviest_user": lambda s, d: rounded(reports.heaviest_user(read_click_columns(s, csv_log(s, d), "duration", "user_id")), 4),
    "clean_clicks": clicks,
    "clean_null_counts": lambda s, d: null_counts(clicks(s, d)).select("column", "non_null"),
    "most_watched_title": lambda s, d: reports.most_watched_title(raw_clicks(s, d)),
    "avg_raw_duration": lambda s, d: rounded(reports.average_duration(raw_clicks(s, d))),
    "heaviest_user": lambda s, d: rounded(reports.heaviest_user(raw_clicks(s, d)), 4),
    "user_title_clicks": lambda s, d: features.user_title_clicks(clicks(s, d)),
    "top10_titles": lambda s, d: features.top_titles(clicks(s, d)),
    "favourite_genre": lambda s, d: features.genre_features(summary(s, d)).select("user_id", "favourite_genre"),
    "genre_diversity": lambda s, d: rounded(features.genre_features(summary(s, d)).select("user_id", "genre_diversity")),
    **{f: _total(f) for f in features.TOTALS},
    **{f: _class(f) for f in features.CLASSES},
    "ft_probability_class": lambda s, d: features.totals(summary(s, d)).select("user_id", classify.follow_through_class(F.col("ft_probability")).alias("ft_probability_class")),
    "user_features": lambda s, d: rounded(user_features(s, d)),
    "user_features_imputed": lambda s, d: rounded(imputed(s, d)),
    "pivot_time_day": _profile("most_active_time_day"),
    "pivot_click_length": _profile("most_common_click_length"),
    "pivot_ft": _profile("ft_probability"),
    "user_genres": user_genres,
    "vocabulary": lambda s, d: rounded(minhash.vocabulary(titles(s, d))),
    "user_index": lambda s, d: rounded(minhash.user_index(titles(s, d))),
    "characteristic_matrix": characteristic_matrix,
    "minhash_signature": minhash_signature,
    "lsh_buckets": lambda s, d: rounded(minhash.buckets(titles(s, d))),
    "similar_users": lambda s, d: rounded(minhash.similar_users(titles(s, d))),
    "jaccard_pairs": lambda s, d: rounded(minhash.jaccard_pairs(titles(s, d))),
    "recommend_all": lambda s, d: rounded(minhash.recommend_all(titles(s, d))),
    "recommend_user": lambda s, d: rounded(minhash.recommend(titles(s, d), EXAMPLE_USER)),
    "recommend_user_labelled": lambda s, d: rounded(minhash.labelled(minhash.recommend(titles(s, d), EXAMPLE_USER), EXAMPLE_USER)),
    "recommend_random": lambda s, d: rounded(minhash.recommend(titles(s, d))),
    "lsh_s_curve": lambda s, d: rounded(minhash.s_curve(s)),
    "kmeans_assign_step": kmeans_assign_step,
    "kmeans_update_step": kmeans_update_step,
    "kmeans_embeddings": _embedding_fit("random"),
    "kmeanspp_embeddings": _embedding_fit("k-means++"),
    "kmeans_fit": _fit("random"),
    "kmeanspp_fit": _fit("k-means++"),
    "bisecting_fit": _fit("bisecting"),
    "inertia": lambda s, d: rounded(clustering.inertia(labelled_embeddings(s, d))),
    "calinski_harabasz": lambda s, d: rounded(clustering.calinski_harabasz(labelled_embeddings(s, d))),
    "silhouette_sampled": lambda s, d: rounded(clustering.silhouette(labelled_embeddings(s, d))),
    "clustering_report": clustering_report,
    "elbow": elbow,
    "best_silhouette_k": best_silhouette_k,
    "famd": lambda s, d: rounded(famd(s, d)),
    "component_scatter": component_scatter,
    "centroid_scatter": centroid_scatter,
    "sample_users": sample_users,
    "famd_eigenvalues": famd_eigenvalues,
    "exam_best_score": lambda s, d: exam_rows(exam.examples(s).withColumn("best", exam.best_score())),
    "exam_greedy": lambda s, d: exam_rows(exam.examples(s).withColumn("best", exam.greedy_score())),
    "exam_expand": lambda s, d: exam_rows(exam.expand(exam.examples(s))),
}
