"""SQL counterparts of the catalogue, for DuckDB over the same tables."""

from __future__ import annotations

from weft.config import DEFAULT
from weft.operators.exam import EXAMPLES
from weft.operators.features import CLASSES, FEATURES, TOTALS
from weft.operators.minhash import coefficients
from weft.plans import oracle_models
from weft.plans.catalogue import EXAMPLE_USER

RAW = """
raw AS (
  SELECT e.ts + INTERVAL 30 DAY * (e.event_id % 12) AS datetime,
    CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN -1.0 ELSE value * 60 END AS duration,
    p_name AS title,
    CASE WHEN event_id % 7 = 0 OR p_size % 10 = 0 THEN 'NOT AVAILABLE'
      ELSE concat_ws(', ', p_type, split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)) END AS genres,
    CASE WHEN event_id % 11 = 0 OR p_size % 10 = 0 THEN 'NOT AVAILABLE' ELSE concat(CAST(1975 + p_size AS VARCHAR), '-06-15') END AS release_date,
    concat('m', k) AS movie_id, concat('u', lpad(CAST(user_id AS VARCHAR), 6, '0')) AS user_id
  FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events) e JOIN part p ON p.p_partkey = CAST(k AS BIGINT)
)"""
CLEAN = f"""{RAW},
kept AS (
  SELECT datetime, duration, title, nullif(genres, 'NOT AVAILABLE') AS genres, TRY_CAST(release_date AS TIMESTAMP) AS release_date, movie_id, user_id
  FROM raw WHERE duration >= 0 AND NOT isnan(duration)
),
gm AS (SELECT title AS t, genres AS g FROM (SELECT title, genres, row_number() OVER (PARTITION BY title ORDER BY count(*) DESC, genres) AS n FROM kept WHERE title IS NOT NULL AND genres IS NOT NULL GROUP BY title, genres) WHERE n = 1),
dm AS (SELECT title AS t, release_date AS r FROM (SELECT title, release_date, row_number() OVER (PARTITION BY title ORDER BY count(*) DESC, release_date) AS n FROM kept WHERE title IS NOT NULL AND release_date IS NOT NULL GROUP BY title, release_date) WHERE n = 1),
clicks AS (
  SELECT datetime, duration, title, CASE WHEN title IS NOT NULL THEN coalesce(genres, g) END AS genres, CASE WHEN title IS NOT NULL THEN coalesce(release_date, r) END AS release_date, movie_id, user_id
  FROM kept LEFT JOIN gm ON kept.title = gm.t LEFT JOIN dm ON kept.title = dm.t
)"""
TOP = f"""{CLEAN},
utc AS (SELECT user_id, title, genres, count(*) AS clicks FROM clicks WHERE user_id IS NOT NULL AND title IS NOT NULL AND genres IS NOT NULL GROUP BY ALL),
top AS (SELECT user_id, title, genres, clicks FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY clicks DESC, title, genres) AS n FROM utc) WHERE n <= 10)"""

_TOTAL = {
    "avg_click_duration": "avg(duration)",
    "avg_time_per_day": "sum(CASE WHEN datetime IS NOT NULL THEN duration END) / count(DISTINCT CAST(datetime AS DATE))",
    "ft_probability": "count(*) FILTER (duration >= 600) / nullif(count(title), 0)",
    "mean_duration_peak_hour": "avg(duration) FILTER (hour(datetime) BETWEEN 18 AND 23)",
    "total_time_spent": "sum(duration)",
    "consistency_ratio": "count(DISTINCT CAST(datetime AS DATE)) / (SELECT count(DISTINCT CAST(datetime AS DATE)) FROM clicks)",
    "avg_click_per_movie": "count(movie_id) / count(DISTINCT movie_id)",
}
_CLASS = {
    "most_active_time_day": "CASE WHEN hour(datetime) BETWEEN 4 AND 11 THEN 'Morning' WHEN hour(datetime) BETWEEN 12 AND 19 THEN 'Afternoon' ELSE 'Night' END",
    "is_old_movie_lover": "CASE WHEN year(release_date) <= 2010 THEN 'True' WHEN year(release_date) > 2010 THEN 'False' END",
    "most_active_time_week": "CASE WHEN isodow(datetime) >= 5 THEN 'Weekend' ELSE 'Weekday' END",
    "most_active_season": "CASE WHEN month(datetime) IN (12, 1, 2) THEN 'Winter' WHEN month(datetime) BETWEEN 3 AND 5 THEN 'Spring' WHEN month(datetime) BETWEEN 6 AND 8 THEN 'Summer' ELSE 'Autumn' END",
    "most_common_click_length": "CASE WHEN duration <= 600 THEN 'Short' WHEN duration <= 3600 THEN 'Medium' ELSE 'Long' END",
    "most_active_daytime": "CASE WHEN hour(datetime) BETWEEN 6 AND 17 THEN 'Daytime' ELSE 'Nighttime' END",
}
assert set(_TOTAL) == set(TOTALS) and set(_CLASS) == set(CLASSES)


def _class_table(feature: str) -> str:
    weight = "count(*)" if feature == "most_common_click_length" else "sum(duration)"
    return f"""(SELECT user_id, c AS {feature} FROM (SELECT user_id, c, row_number() OVER (PARTITION BY user_id ORDER BY w DESC, c) AS n
  FROM (SELECT user_id, {_CLASS[feature]} AS c, {weight} AS w FROM clicks WHERE user_id IS NOT NULL GROUP BY ALL) WHERE c IS NOT NULL) WHERE n = 1)"""


_GENRE = """(SELECT user_id, nullif(genre, 'NaN') AS favourite_genre FROM (SELECT user_id, genre, row_number() OVER (PARTITION BY user_id ORDER BY sum(duration) DESC, genre) AS n
  FROM (SELECT user_id, duration, unnest(string_split(coalesce(genres, 'NaN'), ', ')) AS genre FROM clicks WHERE user_id IS NOT NULL) GROUP BY user_id, genre) WHERE n = 1)"""
_DIVERSITY = """(SELECT user_id, nullif(count(DISTINCT nullif(genre, 'NaN')), 0) / (SELECT count(DISTINCT x) FROM (SELECT unnest(string_split(genres, ', ')) AS x FROM clicks WHERE genres IS NOT NULL)) AS genre_diversity
  FROM (SELECT user_id, unnest(string_split(coalesce(genres, 'NaN'), ', ')) AS genre FROM clicks WHERE user_id IS NOT NULL) GROUP BY user_id)"""
_TABLES = {
    "favourite_genre": _GENRE,
    "genre_diversity": _DIVERSITY,
    **{f: f"(SELECT user_id, {x} AS {f} FROM clicks WHERE user_id IS NOT NULL GROUP BY user_id)" for f, x in _TOTAL.items()},
    **{f: _class_table(f) for f in _CLASS},
}
_NUMERIC = ("genre_diversity", *TOTALS)


def _shown(f: str) -> str:
    return f"round({f}, 6) AS {f}" if f in _NUMERIC else f


FEATURE_TABLE = f"{CLEAN},\nfeatures AS (SELECT favourite_genre.user_id, {', '.join(FEATURES)} FROM {_GENRE} favourite_genre" + "".join(
    f"\n  LEFT JOIN {_TABLES[f]} {f} ON favourite_genre.user_id = {f}.user_id" for f in FEATURES[1:]
) + ")"
_FILLED = {
    **{c: f"coalesce({c}, (SELECT avg({c}) FROM features))" for c in ("mean_duration_peak_hour", "genre_diversity")},
    **{c: f"coalesce({c}, (SELECT {c} FROM features WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1))" for c in ("is_old_movie_lover", "favourite_genre")},
}
IMPUTED = f"{FEATURE_TABLE},\nfilled AS (SELECT user_id, {', '.join(f'{_FILLED.get(f, f)} AS {f}' for f in FEATURES)} FROM features)"
_FT_CLASS = "CASE WHEN ft_probability < 0.3 THEN 'Low' WHEN ft_probability <= 0.6 THEN 'Medium' ELSE 'High' END"


def _pivot(kind: str, values: tuple[str, ...]) -> str:
    cells = ", ".join(
        f"round(CASE WHEN count(*) FILTER (kind = '{v}') > 0 THEN 100.0 * count(favourite_genre) FILTER (kind = '{v}') / nullif(count(favourite_genre), 0) END, 6) AS {v.lower()}" for v in values
    )
    return f"WITH {IMPUTED} SELECT CAST(cluster AS BIGINT) AS cluster, {cells} FROM (SELECT CAST(substr(user_id, 2, 6) AS INTEGER) % 4 AS cluster, {kind} AS kind, favourite_genre FROM filled) GROUP BY cluster"


# The hashes for the 20 genres of the adaptor's log.
_A, _B = coefficients(19)
SIGNATURES = f"""{TOP},
ug AS (SELECT DISTINCT user_id, unnest(string_split(lower(genres), ', ')) AS genre FROM top),
vocab AS (SELECT genre, row_number() OVER (ORDER BY genre) - 1 AS index FROM (SELECT DISTINCT genre FROM ug)),
h AS (SELECT * FROM (VALUES {', '.join(f'({i}, {a}, {b})' for i, (a, b) in enumerate(zip(_A, _B)))}) v(hash, a, b)),
sig AS (SELECT user_id, hash, min((a * index + b) % {DEFAULT.prime}) AS value FROM ug JOIN vocab USING (genre) CROSS JOIN h GROUP BY user_id, hash),
buckets AS (SELECT CAST(hash // 5 AS BIGINT) AS band, user_id, CAST(string_agg(CAST(value AS VARCHAR), '' ORDER BY hash) AS BIGINT) AS bucket FROM sig GROUP BY hash // 5, user_id),
pairs AS (SELECT a.user_id, b.user_id AS similar_user, count(*) AS matches FROM buckets a JOIN buckets b ON a.band = b.band AND a.bucket = b.bucket AND a.user_id <> b.user_id GROUP BY ALL),
alike AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY matches DESC, similar_user) AS rank FROM pairs) WHERE rank <= 2),
sets AS (SELECT user_id, list(genre) AS g FROM ug GROUP BY user_id),
jac AS (SELECT s.user_id, s.similar_user, len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))) AS jaccard FROM alike s JOIN sets a ON s.user_id = a.user_id JOIN sets b ON s.similar_user = b.user_id),
rec AS (
  SELECT user_id, title, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, j DESC, c DESC, title) AS rank
  FROM (SELECT jac.user_id, title, count(*) AS n, max(jaccard) AS j, sum(clicks) AS c FROM jac JOIN top ON top.user_id = jac.similar_user GROUP BY ALL)
)"""

_POINTS = """
p AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x, label FROM embeddings),
c AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS cluster, x AS y FROM (SELECT * FROM p ORDER BY vec_id LIMIT 4)),
d AS (SELECT vec_id, x, cluster, list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dist2 FROM p CROSS JOIN c),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist2, cluster) AS n FROM d) WHERE n = 1),
flat AS (SELECT vec_id, label, unnest(x) AS v, unnest(range(0, len(x))) AS dim FROM p),
mean AS (SELECT label, dim, avg(v) AS m, count(*) AS n FROM flat GROUP BY label, dim),
within AS (SELECT sum((v - m) * (v - m)) AS w FROM flat JOIN mean USING (label, dim))"""
_EMBEDDED = "p AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings)"
_KINDS = ["favourite_genre", *CLASSES]
_COMPONENTS = f"{IMPUTED}, {oracle_models.components([c for c in FEATURES if c not in _KINDS], _KINDS)}"
_USERS = f"{_COMPONENTS}, p AS (SELECT user_id AS id, [pc0, pc1] AS x FROM pc)"


def _labelled(points: str, id_col: str, plus_plus: bool, steps: int, tol: float) -> str:
    return f"WITH {oracle_models.kmeans(points, plus_plus, steps, tol=tol)} SELECT id AS {id_col}, CAST(cluster AS BIGINT) AS cluster, round(dist2, 6) AS dist2 FROM labelled"


_EXAMS = "e(score, marks) AS (SELECT * FROM (VALUES " + ", ".join(f"({s}, {m}::BIGINT[])" for s, m in EXAMPLES) + "))"
_MARKS = "CAST(score AS BIGINT) AS score, array_to_string(marks, ',') AS marks"

_RUNS = ("ba_", "pp_", "b0_", "b1_", "b2_")
_TAKEN = {t: oracle_models.iterations(t, 40, 1e-4) for t in _RUNS}
_REPORT = ", ".join(
    [
        oracle_models.bisecting(_USERS, 40),
        *[oracle_models.kmeans(f"{t}p AS MATERIALIZED (SELECT * FROM p)", t == "pp_", 40, tol=1e-4, t=t) for t in _RUNS[:2]],
    ]
)

ORACLE_SQL: dict[str, str] = {
    "raw_clicks": f"WITH {RAW} SELECT * FROM raw",
    "csv_clicks": f"WITH {RAW} SELECT * FROM raw",
    "csv_third_field": f"WITH {RAW} SELECT count(*) AS clicks, round(avg(duration), 6) AS avg_duration FROM raw",
    "csv_fourth_field": f"WITH {RAW} SELECT title, count(*) AS clicks FROM raw GROUP BY title ORDER BY clicks DESC, title DESC LIMIT 1",
    "csv_heaviest_user": f"WITH {RAW} SELECT user_id, round(sum(duration), 4) AS total FROM raw GROUP BY user_id ORDER BY sum(duration) DESC, user_id DESC LIMIT 1",
    "clean_clicks": f"WITH {CLEAN} SELECT * FROM clicks",
    "clean_null_counts": f"WITH {CLEAN} "
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS non_null FROM clicks" for c in ("datetime", "duration", "title", "genres", "release_date", "movie_id", "user_id")),
    "most_watched_title": f"WITH {RAW} SELECT title, count(*) AS clicks FROM raw GROUP BY title ORDER BY clicks DESC, title DESC LIMIT 1",
    "avg_raw_duration": f"WITH {RAW} SELECT round(avg(duration), 6) AS avg_duration FROM raw",
    "heaviest_user": f"WITH {RAW} SELECT user_id, round(sum(duration), 4) AS total FROM raw GROUP BY user_id ORDER BY sum(duration) DESC, user_id DESC LIMIT 1",
    "user_title_clicks": f"WITH {TOP} SELECT * FROM utc",
    "top10_titles": f"WITH {TOP} SELECT * FROM top",
    **{f: f"WITH {CLEAN} SELECT user_id, {_shown(f)} FROM {_TABLES[f]}" for f in FEATURES},
    "ft_probability_class": f"WITH {CLEAN} SELECT user_id, {_FT_CLASS} AS ft_probability_class FROM {_TABLES['ft_probability']}",
    "user_features": f"WITH {FEATURE_TABLE} SELECT user_id, {', '.join(map(_shown, FEATURES))} FROM features",
    "user_features_imputed": f"WITH {IMPUTED} SELECT user_id, {', '.join(map(_shown, FEATURES))} FROM filled",
    "pivot_time_day": _pivot("most_active_time_day", ("Afternoon", "Morning", "Night")),
    "pivot_click_length": _pivot("most_common_click_length", ("Long", "Medium", "Short")),
    "pivot_ft": _pivot(_FT_CLASS, ("High", "Low", "Medium")),
    "user_genres": f"WITH {SIGNATURES} SELECT user_id, string_agg(genre, ',' ORDER BY genre) AS genres FROM ug GROUP BY user_id",
    "vocabulary": f"WITH {SIGNATURES} SELECT genre, CAST(index AS BIGINT) AS index FROM vocab",
    "user_index": f"WITH {TOP} SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS index FROM (SELECT DISTINCT user_id FROM top)",
    "characteristic_matrix": f"WITH {SIGNATURES} SELECT u.user_id, string_agg(CASE WHEN ug.genre IS NULL THEN '0' ELSE '1' END, '' ORDER BY v.genre) AS genres FROM (SELECT DISTINCT user_id FROM ug) u CROSS JOIN vocab v LEFT JOIN ug ON ug.user_id = u.user_id AND ug.genre = v.genre GROUP BY u.user_id",
    "minhash_signature": f"WITH {SIGNATURES} SELECT user_id, CAST(hash AS BIGINT) AS hash, CAST(value AS BIGINT) AS value FROM sig",
    "lsh_buckets": f"WITH {SIGNATURES} SELECT band, bucket, user_id FROM buckets",
    "similar_users": f"WITH {SIGNATURES} SELECT user_id, similar_user, matches, rank FROM alike",
    "jaccard_pairs": f"WITH {SIGNATURES} SELECT user_id, similar_user, round(jaccard, 6) AS jaccard FROM jac",
    "recommend_all": f"WITH {SIGNATURES} SELECT user_id, rank, title FROM rec WHERE rank <= 5",
    "recommend_user": f"WITH {SIGNATURES} SELECT user_id, rank, title FROM rec WHERE rank <= 5 AND user_id = '{EXAMPLE_USER}'",
    "recommend_user_labelled": f"WITH {SIGNATURES} SELECT rank, title AS \"Recommended Movies for User {EXAMPLE_USER}\" FROM rec WHERE rank <= 5 AND user_id = '{EXAMPLE_USER}'",
    "recommend_random": f"WITH {SIGNATURES} SELECT user_id, rank, title FROM rec WHERE rank <= 5 AND user_id = (SELECT user_id FROM (SELECT DISTINCT user_id FROM top) ORDER BY md5(concat(user_id, '-{DEFAULT.hash_seed}')), user_id LIMIT 1)",
    "sample_users": f"WITH {CLEAN} SELECT user_id, favourite_genre FROM {_GENRE} ORDER BY substr(md5(concat(user_id, '-42')), 1, 13), user_id LIMIT 10",
    "lsh_s_curve": "SELECT CAST(b AS BIGINT) AS bands, round(i / 99.0::DOUBLE, 6) AS similarity, round(1 - pow(1 - pow(i / 99.0::DOUBLE, 100.0 / b), b), 6) AS probability FROM range(100) r(i) CROSS JOIN (VALUES (5), (20), (25), (50)) v(b)",
    "kmeans_assign_step": f"WITH {_POINTS} SELECT vec_id, CAST(cluster AS BIGINT) AS cluster, round(dist2, 6) AS dist2 FROM a",
    "kmeans_update_step": f"WITH {_POINTS} SELECT CAST(cluster AS BIGINT) AS cluster, CAST(dim AS BIGINT) AS dim, round(avg(v), 6) AS value FROM (SELECT cluster, unnest(x) AS v, unnest(range(0, len(x))) AS dim FROM a) GROUP BY cluster, dim",
    "kmeans_embeddings": _labelled(_EMBEDDED, "vec_id", False, 5, 0.0),
    "kmeanspp_embeddings": _labelled(_EMBEDDED, "vec_id", True, 5, 0.0),
    "kmeans_fit": _labelled(_USERS, "user_id", False, 60, 1e-4),
    "kmeanspp_fit": _labelled(_USERS, "user_id", True, 60, 1e-4),
    "bisecting_fit": f"WITH {oracle_models.bisecting(_USERS, 60)} SELECT id AS user_id, CAST(dense_rank() OVER (ORDER BY path) - 1 AS BIGINT) AS cluster, round(dist2, 6) AS dist2 FROM tree3",
    "centroid_scatter": f"WITH {oracle_models.kmeans(_USERS, True, 60, tol=1e-4)} SELECT CAST(cluster AS BIGINT) AS cluster, round(x[1], 6) AS pc0, round(x[2], 6) AS pc1, false AS is_centroid FROM labelled UNION ALL SELECT CAST(cluster AS BIGINT), round(y[1], 6), round(y[2], 6), true FROM c60",
    "clustering_report": f"WITH {_REPORT} SELECT 'k-means' AS algorithm, {_TAKEN['ba_']} AS iterations, (SELECT round(sum(dist2), 6) FROM ba_labelled) AS inertia UNION ALL SELECT 'k-means++', {_TAKEN['pp_']}, (SELECT round(sum(dist2), 6) FROM pp_labelled) UNION ALL SELECT 'bisecting', {_TAKEN['b0_']} + {_TAKEN['b1_']} + {_TAKEN['b2_']}, (SELECT round(sum(dist2), 6) FROM tree3)",
    "elbow": f"WITH RECURSIVE {oracle_models.kmeans_by_k(_USERS, 60)}, {oracle_models.ELBOW} SELECT CAST(k AS BIGINT) AS k, round(inertia, 6) AS inertia, CAST(knee AS BIGINT) AS knee FROM curve CROSS JOIN knee",
    "best_silhouette_k": f"WITH RECURSIVE {oracle_models.kmeans_by_k(_USERS, 60)}, {oracle_models.SILHOUETTES} SELECT CAST(k AS BIGINT) AS k FROM scores ORDER BY silhouette DESC, k LIMIT 1",
    "famd": f"WITH {_COMPONENTS} SELECT user_id, round(pc0, 6) AS pc0, round(pc1, 6) AS pc1 FROM pc",
    "famd_eigenvalues": f"WITH {_COMPONENTS} {oracle_models.EIGENVALUES}",
    "component_scatter": f"WITH {_COMPONENTS} SELECT user_id, round(pc0, 6) AS pc0, round(pc1, 6) AS pc1, most_active_time_day, most_common_click_length FROM pc JOIN filled USING (user_id)",
    "inertia": f"WITH {_POINTS} SELECT round(w, 6) AS inertia FROM within",
    "calinski_harabasz": f"""WITH {_POINTS}, g AS (SELECT dim, avg(v) AS gm FROM flat GROUP BY dim),
b AS (SELECT sum(n * (m - gm) * (m - gm)) AS b, count(DISTINCT label) AS k FROM mean JOIN g USING (dim))
SELECT round(b * ((SELECT count(*) FROM p) - k) / (w * (k - 1)), 6) AS calinski_harabasz FROM b, within""",
    "silhouette_sampled": f"""WITH {_POINTS}, sampled AS (SELECT * FROM p ORDER BY md5(concat(vec_id, '-42')), vec_id LIMIT 10000), dist AS (SELECT q.vec_id, q.label AS own, r.label AS other, sum(sqrt(list_sum(list_transform(list_zip(q.x, r.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))) AS s, count(*) AS n FROM sampled q CROSS JOIN sampled r GROUP BY ALL),
ab AS (SELECT vec_id, max(CASE WHEN own = other THEN s / nullif(n - 1, 0) END) AS a, min(CASE WHEN own <> other THEN s / n END) AS b FROM dist GROUP BY vec_id)
SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM ab""",
    "exam_best_score": f"WITH {_EXAMS} SELECT {_MARKS}, CAST(CASE WHEN len(marks) % 2 = 0 THEN score ELSE 0 END + coalesce(list_sum(list_reverse_sort(marks)[1 : (len(marks) + 1) // 2]), 0) - coalesce(list_sum(list_sort(marks)[1 : len(marks) // 2]), 0) AS BIGINT) AS best FROM e",
    "exam_greedy": f"WITH {_EXAMS} SELECT {_MARKS}, CAST(list_reduce(list_concat([score], list_reverse_sort(marks)), lambda a, m: 2 * a - m) AS BIGINT) AS best FROM e",
    "exam_expand": f"""WITH RECURSIVE {_EXAMS}, st AS (
  SELECT score, marks, CAST(score AS BIGINT) AS s, list_sort(list_transform(marks, lambda m: CAST(m AS BIGINT))) AS rest FROM e
  UNION -- the rest stays sorted, so equal states merge
  SELECT score, marks, rest[i] AS s, list_transform(list_concat(rest[1 : i - 1], rest[i + 1 :]), lambda x: x + s - rest[i]) AS rest
  FROM (SELECT *, unnest(range(1, len(rest) + 1)) AS i FROM st WHERE len(rest) > 0)
) SELECT {_MARKS}, max(s) AS best FROM st WHERE len(rest) = 0 GROUP BY ALL""",
}
