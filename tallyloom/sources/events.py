"""Event streams: newline-delimited protocol lines, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.events import envelope, is_object


def read_lines(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return reader.text(path)


def runtime_events(lines: DataFrame, line: str = "value", now=None) -> DataFrame:
    """Envelope of each protocol line; ordinary log lines are left out."""
    now = F.current_timestamp() if now is None else now
    keep = [c for c in lines.columns if c != line]
    made = lines.where(is_object(F.col(line))).select(*keep, envelope(F.col(line), now).alias(line))
    return made.select(*keep, *(F.col(line)[c].alias(c) for c in ("event", "ts", "usage", "payload", "raw")))


def marker_rows(lines: DataFrame, marker: str, line: str = "value") -> DataFrame:
    """Tab-separated rows behind a marker in remote shell output: (kind, path)."""
    parts = F.split(F.col(line), "\t", 3)
    return lines.withColumn("_p", parts).where((F.size("_p") == 3) & (F.get("_p", F.lit(0)) == marker)).select(F.get("_p", F.lit(1)).alias("kind"), F.get("_p", F.lit(2)).alias("path"))


def number_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Whole numbers, one a line, as a command line tool prints them."""
    return lines.select(F.trim(F.col(line)).try_cast("long").alias("number")).where("number IS NOT NULL")
