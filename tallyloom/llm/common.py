"""Shared helpers: word splitting, scratch tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words, as a regex class and as characters.
SPACE = "[\\x20\\x09-\\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where
    that is unset and Spark runs in one process, a temporary folder of our own."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tallyloom-"))
    return sc.getCheckpointDir()


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_PATH = "_tallyloom_path"


def written(df: DataFrame) -> DataFrame:
    """Write df to a Parquet table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation. The
    shuffles behind the table are of no more use then, so Spark is told to drop
    their files as the write ends. The table goes with dropped(), or when the
    driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    setattr(out, _PATH, path)
    return out


def dropped(*tables: DataFrame) -> None:
    """Remove tables that written() gave and that nothing reads any more."""
    for t in tables:
        _remove(t.sparkSession, getattr(t, _PATH))


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may be gone, and its folder with it
        pass


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session: they may not have it on their path."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="tallyloom-")) / "tallyloom.zip"
    with zipfile.ZipFile(to, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    sc.addPyFile(str(to))


def partitions(spark: SparkSession, *tables: DataFrame, size: int = 32 << 20) -> int:
    """Number of partitions for what is made of the tables: the session's, or more, one for each `size` bytes that they store.

    A task's share so stays the same as the input grows. Tables without known
    size (not read from files) count as none.
    """
    stored = 0
    for t in tables:
        n = int(str(t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        stored += n if n < 1 << 60 else 0
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-stored // size))


def consecutive(batches, key: str, alone=None):
    """(key, rows) of each run of rows with one key; partitions sorted by key have one run a key, and one is held at a time.

    Rows whose key is `alone` come one by one.
    """
    at, rows = None, []
    for batch in batches:
        k = batch.schema.get_field_index(key)
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and (row[k] != at or at == alone):
                yield at, rows
                rows = []
            at = row[k]
            rows.append(row)
    if rows:
        yield at, rows


def words(text: Column) -> Column:
    """Array of the maximal runs of characters outside SPACE; null text has none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    none = F.array().cast("array<string>")
    return F.when(bare == "", none).otherwise(F.split(bare, SPACE, -1))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under internal names, so that no extra column can clash."""
    ship(df.sparkSession)
    return df.select(*(F.col(f"`{name}`").alias(to) for to, name in columns.items()))
