"""Retries and stalls in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import backoff_ms, due_at


def attempts(outcomes: DataFrame, failed: Column, run: str, order: list[str]) -> DataFrame:
    """Failed outcomes with their attempt number among the failures in a row; a success starts anew."""
    w = Window.partitionBy(run).orderBy(*order)
    d = outcomes.withColumn("_failed", failed).withColumn("_island", F.sum((~F.col("_failed")).cast("int")).over(w))
    n = F.row_number().over(Window.partitionBy(run, "_island", "_failed").orderBy(*order))
    return d.withColumn("attempt", n.cast("long")).where("_failed").drop("_failed", "_island")


def schedule(failures: DataFrame, ts: str = "ts", cap_ms: int = 300_000) -> DataFrame:
    """Adds delay_ms and due_at to failures with their attempt."""
    d = failures.withColumn("delay_ms", backoff_ms(F.col("attempt"), cap_ms))
    return d.withColumn("due_at", due_at(F.col(ts), F.col("delay_ms")))


def stalled(running: DataFrame, now: Column, timeout_ms: int) -> DataFrame:
    """Runs whose last event (or start) is more than the timeout ago; a timeout of 0 or less finds none."""
    idle = F.timestamp_diff("MILLISECOND", F.coalesce("last_ts", "started_at"), now)
    d = running.withColumn("idle_ms", F.greatest(idle, F.lit(0)))
    return d.where(F.lit(timeout_ms > 0) & (F.col("idle_ms") > timeout_ms))


def due(retrying: DataFrame, now_ms: int) -> DataFrame:
    """Retry rows with the time that is left, which is never negative."""
    return retrying.withColumn("due_in_ms", F.greatest(F.col("due_at_ms") - now_ms, F.lit(0)))
