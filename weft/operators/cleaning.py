"""Cleaning of the click log: filter, coercion, missing tokens, and per-title imputation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.config import DEFAULT, Config


def modes_by(rows: DataFrame, key: str, values: tuple[str, ...]) -> DataFrame:
    """(key, usual_<value>, ...): each key's most frequent value of each column, the smallest on ties; nulls don't count.

    One pass over the rows: counts by (key, column, value) first, so no key's rows meet in one task.
    """
    known = reduce(Column.__or__, [F.col(v).isNotNull() for v in values])
    each = F.array(*[F.struct(F.lit(k).alias("_k"), *[(F.col(v) if v == w else F.lit(None).cast(t)).alias(v) for v, t in rows.select(*values).dtypes]) for k, w in enumerate(values)])
    long = rows.where(F.col(key).isNotNull()).select(key, F.inline(each)).where(known)
    counts = long.groupBy(key, "_k", *values).agg(F.count("*").alias("_n"))
    best = lambda k, v: F.min(F.when(F.col("_k") == k, F.struct((-F.col("_n")).alias("_n"), F.col(v))))[v].alias(f"usual_{v}")
    return counts.groupBy(key).agg(*[best(k, v) for k, v in enumerate(values)])


def mode_by(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): each key's most frequent value, where it has one."""
    return modes_by(rows, key, (value,)).withColumnRenamed(f"usual_{value}", value)


def clean(raw: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Rows with a duration of at least 0, coerced; null genres and release dates take their title's mode.

    Rows without a title keep neither, as their title group can't be known.
    """
    rows = raw.where((F.col("duration").cast("double") >= 0) & ~F.isnan(F.col("duration").cast("double"))).select(
        F.expr("try_cast(datetime AS timestamp_ntz)").alias("datetime"),
        F.col("duration").cast("double").alias("duration"),
        "title",
        F.nullif(F.col("genres"), F.lit(config.missing_token)).alias("genres"),
        F.expr("try_cast(release_date AS timestamp_ntz)").alias("release_date"),
        "movie_id",
        "user_id",
    )
    usual = modes_by(rows, "title", ("genres", "release_date"))
    known = F.col("title").isNotNull()
    return rows.join(usual, "title", "left").select(
        "datetime",
        "duration",
        "title",
        F.when(known, F.coalesce("genres", "usual_genres")).alias("genres"),
        F.when(known, F.coalesce("release_date", "usual_release_date")).alias("release_date"),
        "movie_id",
        "user_id",
    )


def null_counts(rows: DataFrame) -> DataFrame:
    """(column, dtype, non_null): a summary of a table in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.col(f"n{i}").alias("non_null")) for i, (c, t) in enumerate(rows.dtypes)])
    return rows.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(rows.columns)]).select(F.inline(pairs))
