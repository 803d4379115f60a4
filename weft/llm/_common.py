"""Helpers shared by the training-data operators: the shared folder, materialised steps, text columns."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.storage import Scratch, fresh_path, materialise, remove, shared_root

__all__ = ["Scratch", "bounded_batches", "fresh_path", "give_back", "hash_sample", "kept_by_worker", "materialise", "remove", "shared_root", "table", "text_of"]

#: Bytes of a batch between Spark and Python: a batch of long rows is held several times over on either side.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's bound on the bytes of a batch where it is above ``BATCH_BYTES``."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if now is None or not now.rstrip("b").isdigit() or not 0 < int(now.rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


_kept: dict[str, object] = {}


def kept_by_worker(name: str, make):
    """What a Python worker keeps between batches and tasks: the last such object only, as workers serve one stage after another."""
    if name not in _kept:
        if _kept:
            _kept.clear()
            give_back()
        _kept[name] = make()
    return _kept[name]


def give_back(spark: SparkSession | None = None) -> None:
    """Return freed memory to the system, where the C library can; with a session, the driver's JVM does so too."""
    if spark is not None:
        spark.sparkContext._jvm.System.gc()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def hash_sample(rows: DataFrame, most: int, *by: str) -> DataFrame:
    """The ``most`` rows with the smallest hashes of the columns ``by`` (then the columns themselves).

    A bound on the hash leaves about twice as many rows before they are ordered, whatever the number
    of tasks, so little more than ``most`` rows travel; where it leaves too few, it is given up.
    """
    span = 1 << 62
    rows = rows.withColumn("_hash", F.pmod(F.xxhash64(*by), F.lit(span)))
    total = rows.count()
    if total > 4 * most:
        few = rows.where(F.col("_hash") < F.lit(int(2 * most / total * span)))
        if few.count() >= most:
            rows = few
    return rows.orderBy("_hash", *by).limit(most).drop("_hash")


def text_of(name: str) -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
