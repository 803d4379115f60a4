"""The shared folder, and steps that are written to it, so that lineage is cut and lost executors cost a retry only."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """Folder that the driver and every executor can reach.

    It is the one that the cluster names in ``spark.checkpoint.dir``. Where that is unset a temporary
    folder is taken, in local mode only (one machine, as in tests); elsewhere that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="weft-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/weft-{spark.sparkContext.applicationId}"


#: The open scopes, the innermost last.
_scopes: list[Scratch] = []


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].paths.add(path)
    return path


class Scratch:
    """A scope that deletes what was written to the shared folder inside it, but for tables that it is told to keep.

    Results are read lazily, so compute or write them before the scope ends, or keep what they read.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, set()

    def __enter__(self) -> Scratch:
        _scopes.append(self)
        return self

    def keep(self, *tables: DataFrame) -> None:
        """Leaves the files of the tables; they belong to the scope around this one."""
        for path in {f.rsplit("/", 1)[0] for t in tables for f in t.inputFiles()}:
            kept = {p for p in self.paths if path.endswith(p.split("://", 1)[-1].lstrip("/"))}
            self.paths -= kept
            if len(_scopes) > 1:
                _scopes[-2].paths |= kept

    def __exit__(self, *error) -> None:
        _scopes.remove(self)
        for path in self.paths:
            remove(path, self.spark)


#: Spark's own setting: the shuffle files of a query go when it ends. Nothing reads them later where the result is a written table.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and a lost executor loses nothing.

    The shuffle files of the write go with its end; the session's setting for other queries stays as it is.
    """
    spark = df.sparkSession
    path, before = fresh_path(spark, label), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def remove(df_or_path, spark: SparkSession) -> None:
    """Delete a materialised step once nothing reads it any more."""
    paths = [df_or_path] if isinstance(df_or_path, str) else sorted({f.rsplit("/", 1)[0] for f in df_or_path.inputFiles()})
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
