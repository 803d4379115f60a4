"""Boundaries of the classes, nulls in the cleaning, and small cases of the features."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from weft.functions import classify, vectors
from weft.operators import features, minhash
from weft.operators.cleaning import clean, mode_by, null_counts

RAW = "datetime string, duration double, title string, genres string, release_date string, movie_id string, user_id string"


def raw(spark, *rows):
    return spark.createDataFrame(list(rows), RAW)


def classes(spark, expression, values, kind):
    frame = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r[0] for r in frame.select(expression(F.col("v"))).collect()]


def at(hour, day=1, month=1, year=2024):
    return dt.datetime(year, month, day, hour)


def test_hours(spark):
    hours = [3, 4, 11, 12, 19, 20, 23]
    assert classes(spark, classify.time_of_day, [at(h) for h in hours] + [None], "timestamp_ntz") == ["Night", "Morning", "Morning", "Afternoon", "Afternoon", "Night", "Night", "Night"]
    assert classes(spark, classify.daytime, [at(h) for h in (5, 6, 17, 18)] + [None], "timestamp_ntz") == ["Nighttime", "Daytime", "Daytime", "Nighttime", "Nighttime"]
    assert classes(spark, classify.is_peak_hour, [at(h) for h in (17, 18, 23, 0)] + [None], "timestamp_ntz") == [0, 1, 1, 0, 0]


def test_days_seasons_years(spark):
    assert classes(spark, classify.part_of_week, [at(1, d) for d in (4, 5, 7, 8)] + [None], "timestamp_ntz") == ["Weekday", "Weekend", "Weekend", "Weekday", "Weekday"]
    months = [2, 3, 5, 6, 8, 9, 11, 12]
    assert classes(spark, classify.season, [at(1, 1, m) for m in months] + [None], "timestamp_ntz") == ["Winter", "Spring", "Spring", "Summer", "Summer", "Autumn", "Autumn", "Winter", "Autumn"]
    assert classes(spark, classify.old_film, [at(1, year=2010), at(1, year=2011), None], "timestamp_ntz") == ["True", "False", None]


def test_lengths_and_probabilities(spark):
    assert classes(spark, classify.click_length, [0.0, 600.0, 601.0, 3600.0, 3601.0], "double") == ["Short", "Short", "Medium", "Medium", "Long"]
    assert classes(spark, classify.follow_through_class, [0.29, 0.3, 0.6, 0.61, None], "double") == ["Low", "Medium", "Medium", "High", "High"]


def test_clean_keeps_zero_and_drops_negative_and_nan(spark):
    rows = [("2024-01-01 00:00:00", d, "t", "A", "2000-01-01", "m", "u") for d in (-1.0, 0.0, float("nan"), None, 5.0)]
    assert sorted(r.duration for r in clean(raw(spark, *rows)).collect()) == [0.0, 5.0]


def test_clean_coerces_and_imputes_per_title(spark):
    found = clean(
        raw(
            spark,
            ("not a time", 1.0, "t", "NOT AVAILABLE", "NOT AVAILABLE", "m", "u1"),
            ("2024-01-01 10:00:00", 1.0, "t", "B", "2001-01-01", "m", "u2"),
            ("2024-01-01 10:00:00", 1.0, "t", "A", "2000-01-01", "m", "u3"),
            ("2024-01-01 10:00:00", 1.0, "none", "NOT AVAILABLE", "NOT AVAILABLE", "m", "u4"),
            ("2024-01-01 10:00:00", 1.0, None, "C", "2002-01-01", "m", "u5"),
        )
    )
    got = {r.user_id: (r.datetime, r.genres, r.release_date) for r in found.collect()}
    assert got["u1"] == (None, "A", dt.datetime(2000, 1, 1))  # the smaller of tied values
    assert got["u2"][1] == "B"  # values that are there stay
    assert got["u4"][1:] == (None, None)
    assert got["u5"][1:] == (None, None)  # no title, no group
    counts = {r["column"]: r.non_null for r in null_counts(found).collect()}
    assert counts["genres"] == 3 and counts["user_id"] == 5


def test_mode_by_ignores_nulls(spark):
    frame = spark.createDataFrame([("a", None), ("a", "x"), (None, "y"), ("b", None)], "k string, v string")
    assert [tuple(r) for r in mode_by(frame, "k", "v").collect()] == [("a", "x")]


def test_empty_log(spark):
    empty = clean(raw(spark))
    assert features.user_features(empty).count() == 0
    assert features.top_titles(empty).count() == 0
    assert features.impute(features.user_features(empty)).count() == 0


def test_features_of_one_user(spark):
    found = features.user_features(
        clean(
            raw(
                spark,
                ("2024-01-05 20:00:00", 600.0, "t", "A, B", "2000-01-01", "m1", "u"),
                ("2024-01-05 21:00:00", 100.0, "t", "A, B", "2000-01-01", "m1", "u"),
                ("2024-01-08 09:00:00", 5000.0, "s", "NOT AVAILABLE", "NOT AVAILABLE", "m2", "u"),
            )
        )
    ).collect()[0]
    assert found.favourite_genre is None and found.genre_diversity == 1.0  # time without a genre competes
    assert found.avg_time_per_day == (700.0 + 5000.0) / 2
    assert found.ft_probability == pytest.approx(2 / 3) and found.most_common_click_length == "Short"
    assert found.mean_duration_peak_hour == 350.0 and found.avg_click_per_movie == 1.5 and found.consistency_ratio == 1.0
    assert found.most_active_time_week == "Weekday" and found.is_old_movie_lover == "True"


def test_profile_checks_its_columns(spark):
    frame = spark.createDataFrame([(0, "Night", "A"), (0, "Morning", None), (1, "Night", "B")], "cluster int, most_active_time_day string, favourite_genre string")
    got = {r.cluster: r.asDict() for r in features.cluster_profile(frame, "most_active_time_day").collect()}
    assert got[0]["night"] == 100.0 and got[0]["morning"] == 0.0 and got[0]["afternoon"] is None
    for name in ("nope", "favourite_genre"):
        with pytest.raises(ValueError):
            features.cluster_profile(frame, name)


def test_vectors(spark):
    row = spark.range(1).select(
        vectors.jaccard(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3))),
        vectors.jaccard(F.array().cast("array<int>"), F.array().cast("array<int>")),
        vectors.nearest(F.array(F.lit(2.0), F.lit(1.0), F.lit(1.0))),
        vectors.all_close(F.array(F.lit(1.0)), F.array(F.lit(1.00001)), 1e-4),
    ).first()
    assert row[0] == pytest.approx(1 / 3) and row[1] is None and row[2] == 1 and row[3]


TITLES = "user_id string, title string, genres string, clicks bigint"


def test_recommender_small(spark):
    titles = spark.createDataFrame(
        [("a", "t1", "X, Y", 3), ("b", "t2", "x, y", 2), ("b", "t3", "X", 5), ("c", "t2", "X, Y", 1), ("d", "t9", "Z", 9)], TITLES
    )
    similar = {(r.user_id, r["rank"]): (r.similar_user, r.matches) for r in minhash.similar_users(titles).collect()}
    assert similar[("a", 1)] == ("b", 20) and similar[("a", 2)] == ("c", 20)  # the same genres, whatever their case
    got = [r.title for r in minhash.recommend(titles, "a").orderBy("rank").collect()]
    assert got == ["t2", "t3"]  # the common title first
    with pytest.raises(ValueError):
        minhash.recommend(titles, "nobody")


def test_recommender_of_empty_and_one_genre_logs(spark):
    none = spark.createDataFrame([], TITLES)
    assert minhash.signatures(none).count() == 0 and minhash.recommend_all(none).count() == 0
    one = spark.createDataFrame([("a", "t1", "X", 1), ("b", "t2", "X", 1)], TITLES)
    assert sorted((r.user_id, r.title) for r in minhash.recommend_all(one).collect()) == [("a", "t2"), ("b", "t1")]


def test_labelled_recommendations(spark):
    found = minhash.labelled(spark.createDataFrame([("a", 1, "t"), ("b", 1, "s")], "user_id string, rank int, title string"), "a")
    assert found.columns == ["rank", "Recommended Movies for User a"] and [tuple(r) for r in found.collect()] == [(1, "t")]


def test_the_log_is_read_once_for_the_features(spark):
    """The feature table's plan reads the written summary; writing that takes the log once, and once more for usual values."""
    from weft.plans.catalogue import QUERIES

    plan = QUERIES["user_features_imputed"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "event_type" not in plan and "props" not in plan
    cleaned = clean(raw(spark, ("2024-01-05 20:00:00", 600.0, "t", "A", "2000-01-01", "m1", "u")))
    assert features.summary(cleaned)._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") + features.summary(cleaned)._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation") <= 2


def test_signatures_against_a_loop(spark):
    titles = spark.createDataFrame([(f"u{i}", "t", ", ".join(g for k, g in enumerate("abcdefgh") if (i >> k) & 1), 1) for i in range(1, 40)], TITLES)
    known = minhash.genre_list(titles)
    a, b = minhash.coefficients(len(known) - 1)
    for r in minhash.signatures(titles).collect():
        expected = [min((p * known.index(g) + q) % 29 for g in r.genres) for p, q in zip(a, b)]
        assert r.signature == expected


def test_strict_buckets_tell_digits_apart(spark):
    one, two = ([1, 11, 1, 1, 1], [11, 1, 1, 1, 1])
    frame = spark.createDataFrame([(1, one * 20), (2, two * 20)], "id int, signature array<int>")
    loose = {r.id: r.x[0].bucket for r in frame.select("id", minhash.bands().alias("x")).collect()}
    strict = {r.id: r.x[0].bucket for r in frame.select("id", minhash.bands(strict=True).alias("x")).collect()}
    assert loose[1] == loose[2] and strict[1] != strict[2]


def test_equal_totals_tie_whatever_the_order_of_clicks(spark):
    """0.1 + 0.2 + 0.3 and 0.6 are equal seconds, but not as sums of doubles; infinite durations stay what they are."""
    rows = []
    for user, parts in (("a", (0.1, 0.2, 0.3)), ("b", (0.3, 0.2, 0.1)), ("c", (0.2, 0.7, 0.1))):
        # the alphabetically first class and genre gets one click, the other one several of the same total
        rows += [("2024-01-08 09:00:00", d, "t", "zinc", "2000-01-01", "m1", user) for d in parts]
        rows += [("2024-03-08 13:00:00", {"a": 0.6, "b": 0.6, "c": 1.0}[user], "s", "iron", "2020-01-01", "m2", user)]
        rows += [("2024-07-13 13:00:00", 0.0, "r", "NOT AVAILABLE", "NOT AVAILABLE", "m3", user)]
    rows += [("2024-01-08 09:00:00", d, "t", "zinc", "2000-01-01", "m1", "d") for d in (float("inf"), 1.0)]
    for given in (rows, rows[::-1]):
        found = {r.user_id: r for r in features.user_features(clean(raw(spark, *given)).repartition(3, "datetime")).collect()}
        for user, total in (("a", 1.2), ("b", 1.2), ("c", 2.0)):
            r = found[user]
            assert (r.favourite_genre, r.most_active_time_day, r.most_active_season, r.is_old_movie_lover) == ("iron", "Afternoon", "Spring", "False")
            assert r.total_time_spent == total and r.avg_click_duration == total / 5 and r.mean_duration_peak_hour is None
        assert found["d"].total_time_spent == float("inf") and found["d"].favourite_genre == "zinc" and found["d"].most_active_season == "Winter"
