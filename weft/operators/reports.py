"""One-row answers over the raw log, negative durations included."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def most_watched_title(raw: DataFrame) -> DataFrame:
    """The title with most rows; the greatest of equals."""
    return raw.groupBy("title").agg(F.count("*").alias("clicks")).orderBy(F.desc("clicks"), F.desc("title")).limit(1)


def average_duration(raw: DataFrame) -> DataFrame:
    return raw.agg(F.avg("duration").alias("avg_duration"))


def heaviest_user(raw: DataFrame) -> DataFrame:
    """The user with the largest total duration; the greatest of equals."""
    return raw.groupBy("user_id").agg(F.sum("duration").alias("total")).orderBy(F.desc("total"), F.desc("user_id")).limit(1)
