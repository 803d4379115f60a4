"""Title recommendations through banded MinHash over users' genre sets.

Genres are lower-cased here. Signatures use hashes (a x + b) mod 29 with seeded coefficients below the
largest genre number; a band's bucket is its five values written one behind the other. Users with
equal signatures share all buckets, so candidates are counted between distinct signatures, and each
signature lends only as many of its users as an answer can need.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.config import DEFAULT, Config
from weft.functions.vectors import jaccard, multi_hot
from weft.storage import materialise


def genre_array(config: Config = DEFAULT) -> Column:
    return F.split(F.lower("genres"), config.genre_separator)


def user_genres(titles: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(user_id, genres): each user's sorted set of genres."""
    return titles.groupBy("user_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(genre_array(config))))).alias("genres"))


def vocabulary(titles: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(genre, index): all genres in order, numbered from 0. A vocabulary is small, so one window numbers it."""
    found = titles.select(F.explode(genre_array(config)).alias("genre")).where("genre IS NOT NULL").distinct()
    return found.select("genre", (F.row_number().over(Window.orderBy("genre")) - 1).cast("int").alias("index"))


def genre_list(titles: DataFrame, config: Config = DEFAULT) -> list[str]:
    return [r["genre"] for r in vocabulary(titles, config).orderBy("index").collect()]


def user_index(titles: DataFrame) -> DataFrame:
    """(user_id, index): users in order, numbered from 0; by first letters, whose counts are few, and then within them."""
    users = titles.select("user_id").where("user_id IS NOT NULL").distinct().withColumn("head", F.substring("user_id", 1, 4))
    sizes = users.groupBy("head").agg(F.count("*").alias("n"))
    before = sizes.select("head", (F.sum("n").over(Window.orderBy("head")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("head").orderBy("user_id"))
    return users.withColumn("within", within).join(before, "head").select("user_id", (F.col("before") + F.col("within") - 1).cast("int").alias("index"))


def characteristic_matrix(titles: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(user_id, genres): 0 or 1 for each genre of the vocabulary."""
    known = genre_list(titles, config)
    return user_genres(titles, config).select("user_id", multi_hot(F.col("genres"), known).alias("genres"))


def coefficients(largest_index: int, config: Config = DEFAULT) -> tuple[list[int], list[int]]:
    """The hashes' a and b, below the largest index; zeros where there is one genre or none."""
    if largest_index < 1:
        return [0] * config.hashes, [0] * config.hashes
    random = np.random.RandomState(config.hash_seed)
    return tuple(random.randint(0, largest_index, size=config.hashes).tolist() for _ in range(2))


def signatures(titles: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(user_id, genres, signature)."""
    known = genre_list(titles, config)
    a, b = coefficients(len(known) - 1, config)
    number = F.create_map(*[F.lit(x) for i, g in enumerate(known) for x in (g, i)]) if known else F.create_map().cast("map<string,int>")
    hashes = F.array(*[F.struct(F.lit(p).alias("a"), F.lit(q).alias("b")) for p, q in zip(a, b)])
    indexes = F.transform("genres", lambda g: F.element_at(number, g))
    signed = user_genres(titles, config).withColumn("indexes", indexes)
    signature = F.transform(hashes, lambda h: F.array_min(F.transform("indexes", lambda x: (h["a"] * x + h["b"]) % config.prime)))
    return signed.select("user_id", "genres", signature.alias("signature"))


def bands(config: Config = DEFAULT, strict: bool = False) -> Column:
    """The buckets of a signature: its bands' digits as one number, or with ``strict`` apart by commas."""
    n = config.rows_per_band
    number = lambda k: F.concat_ws("," if strict else "", F.transform(F.slice("signature", k * n + 1, n), lambda x: x.cast("string")))
    return F.array(*[F.struct(F.lit(k).alias("band"), (number(k) if strict else number(k).cast("bigint")).alias("bucket")) for k in range(config.bands)])


def buckets(titles: DataFrame, config: Config = DEFAULT, strict: bool = False) -> DataFrame:
    """(band, bucket, user_id)."""
    return signatures(titles, config).select("user_id", F.inline(bands(config, strict))).select("band", "bucket", "user_id")


def similar_users(titles: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(user_id, similar_user, matches, rank): for each user the users that share most buckets, smaller ids first."""
    signed = signatures(titles, config).select("user_id", F.col("signature"))
    kinds = signed.select("signature").distinct().select(F.xxhash64("signature").alias("kind"), "signature")
    entries = kinds.select("kind", F.inline(bands(config)))
    other = entries.withColumnRenamed("kind", "other")
    shared = entries.join(other, ["band", "bucket"]).groupBy("kind", "other").agg(F.count("*").alias("matches"))
    users = signed.select("user_id", F.xxhash64("signature").alias("kind"))
    # an answer takes at most similar_users of one signature, besides the user itself
    first = Window.partitionBy("kind").orderBy("user_id")
    lent = users.withColumn("n", F.row_number().over(first)).where(F.col("n") <= config.similar_users + 1)
    best_kinds = Window.partitionBy("kind").orderBy(F.desc("matches"), "similar_user")
    offers = (
        shared.join(lent.select(F.col("kind").alias("other"), F.col("user_id").alias("similar_user")), "other")
        .withColumn("n", F.row_number().over(best_kinds))
        .where(F.col("n") <= config.similar_users + 1)
    )
    # few rows for each signature, written so that Spark can split the users of a signature that very many share
    offers = materialise(offers.select("kind", "similar_user", "matches"), "offers")
    order = Window.partitionBy("user_id").orderBy(F.desc("matches"), "similar_user")
    return (
        users.join(offers, "kind")
        .where("user_id <> similar_user")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= config.similar_users)
        .select("user_id", "similar_user", "matches", "rank")
    )


def jaccard_pairs(titles: DataFrame, config: Config = DEFAULT, similar: DataFrame | None = None) -> DataFrame:
    """(user_id, similar_user, jaccard): of each user and its similar users; sets are written, as one user may be similar to very many."""
    sets = materialise(user_genres(titles, config), "sets")
    similar = similar_users(titles, config) if similar is None else similar
    mine = sets.withColumnRenamed("genres", "a")
    theirs = sets.select(F.col("user_id").alias("similar_user"), F.col("genres").alias("b"))
    return similar.join(mine, "user_id").join(theirs, "similar_user").select("user_id", "similar_user", jaccard(F.col("a"), F.col("b")).alias("jaccard"))


def recommend_all(titles: DataFrame, config: Config = DEFAULT, similar: DataFrame | None = None) -> DataFrame:
    """(user_id, rank, title): common titles of the similar users first, then by similarity, clicks and title."""
    pairs = jaccard_pairs(titles, config, similar)
    offered = pairs.join(titles.select(F.col("user_id").alias("similar_user"), "title", "clicks"), "similar_user")
    scored = offered.groupBy("user_id", "title").agg(F.sum("clicks").alias("clicks"), F.count("*").alias("n"), F.max("jaccard").alias("jaccard"))
    order = Window.partitionBy("user_id").orderBy(F.desc("n"), F.desc("jaccard"), F.desc("clicks"), "title")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= config.recommendations).select("user_id", "rank", "title")


def recommend(titles: DataFrame, user_id: str | None = None, seed: int | None = None, config: Config = DEFAULT) -> DataFrame:
    """Recommendations for one user; without an id for one chosen by a seeded hash."""
    users = titles.select("user_id").where("user_id IS NOT NULL")
    if user_id is None:
        chosen = users.distinct().orderBy(F.md5(F.concat_ws("-", "user_id", F.lit(str(config.hash_seed if seed is None else seed)))), "user_id").limit(1).collect()
        if not chosen:
            raise ValueError("no users")
        user_id = chosen[0]["user_id"]
    elif users.where(F.col("user_id") == user_id).isEmpty():
        raise ValueError(f"unknown user {user_id}")
    similar = similar_users(titles, config).where(F.col("user_id") == user_id)
    return recommend_all(titles, config, similar)


def labelled(recommendations: DataFrame, user_id: str) -> DataFrame:
    """(rank, title) of one user's recommendations, the titles under a heading that names the user."""
    return recommendations.where(F.col("user_id") == user_id).select("rank", F.col("title").alias(f"Recommended Movies for User {user_id}"))


def s_curve(spark, hashes: int = 100, band_counts: tuple[int, ...] = (5, 20, 25, 50), points: int = 100) -> DataFrame:
    """(bands, similarity, probability) of the collision curves."""
    from weft.functions.vectors import collision_probability

    similarity = F.col("id") / F.lit(float(points - 1))
    return spark.range(points).select(similarity.alias("similarity"), F.explode(F.array(*[F.lit(b) for b in band_counts])).alias("bands")).select(
        "bands", "similarity", collision_probability(F.col("similarity"), hashes, F.col("bands").cast("double")).alias("probability")
    )
