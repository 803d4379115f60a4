"""The raw click log: CSV files, a plain text projection of them, and an adaptor over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.config import DEFAULT, Config

RAW_SCHEMA = T.StructType(
    [
        T.StructField("_row", T.LongType()),
        T.StructField("datetime", T.StringType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("title", T.StringType()),
        T.StructField("genres", T.StringType()),
        T.StructField("release_date", T.StringType()),
        T.StructField("movie_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
    ]
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_clicks_csv(spark: SparkSession, path: str) -> DataFrame:
    """The click log with its header and quoted fields; the unnamed row number is dropped."""
    return spark.read.csv(path, header=True, schema=RAW_SCHEMA, quote='"', escape='"', enforceSchema=True).drop("_row")


def read_click_columns(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Some columns of the click log, found by name with quoted fields minded; the scan parses these only."""
    return read_clicks_csv(spark, path).select(*columns)


def read_field_unquoted(spark: SparkSession, path: str, number: int) -> DataFrame:
    """The ``number``-th (from 1) piece of each line between commas, quotes not minded, without each file's first line."""
    # a separator that no text holds, and no quotes: a row is a whole line, and the reader skips first lines itself
    lines = spark.read.csv(path, schema="value string", sep="\x01", quote="", header=True, enforceSchema=True)
    return lines.select(F.try_element_at(F.split("value", ","), F.lit(number)).alias("value"))


def write_clicks_csv(clicks: DataFrame, path: str) -> None:
    """The raw log as CSV with a header, a row number first and quoted fields, as ``read_clicks_csv`` takes it."""
    columns = [F.col(c).cast("string").alias(c) if c in ("datetime", "release_date") else F.col(c) for c in RAW_SCHEMA.names[1:]]
    clicks.select(F.monotonically_increasing_id().alias("_row"), *columns).write.csv(path, header=True, quote='"', escape='"')


def raw_clicks(spark: SparkSession, sf_dir: str, config: Config = DEFAULT) -> DataFrame:
    """A click log with the raw schema from ``events`` and ``part``: times spread over 12 months of 30 days, with
    negative durations and missing tokens mixed in."""
    events, part = read_table(spark, sf_dir, "events"), read_table(spark, sf_dir, "part")
    key = F.get_json_object("props", "$.k")
    words = F.split("p_name", " ")
    absent = F.lit(config.missing_token)
    return events.join(part, key.cast("bigint") == F.col("p_partkey")).select(
        (F.col("ts") + F.make_dt_interval(((F.col("event_id") % 12) * 30).cast("int"))).alias("datetime"),
        F.when((F.col("event_type") == "error") & (F.col("event_id") % 3 == 0), F.lit(-1.0)).otherwise(F.col("value") * 60).alias("duration"),
        F.col("p_name").alias("title"),
        F.when((F.col("event_id") % 7 == 0) | (F.col("p_size") % 10 == 0), absent)
        .otherwise(F.concat_ws(config.genre_separator, "p_type", words[0], words[1]))
        .alias("genres"),
        F.when((F.col("event_id") % 11 == 0) | (F.col("p_size") % 10 == 0), absent)
        .otherwise(F.concat((F.lit(1975) + F.col("p_size")).cast("string"), F.lit("-06-15")))
        .alias("release_date"),
        F.concat(F.lit("m"), key).alias("movie_id"),
        F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("user_id"),
    )
