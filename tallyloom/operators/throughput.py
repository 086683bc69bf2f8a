"""Rates over samples(series, ts_ms, total, pos) of a cumulative counter; pos 0 is the newest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW_MS, GRAPH_MS, BUCKETS = 5_000, 600_000, 24


def pruned(samples: DataFrame, now_ms: int, window_ms: int) -> DataFrame:
    return samples.where(F.col("ts_ms") >= now_ms - window_ms)


def rate_now(samples: DataFrame, now_ms: int, current: int, window_ms: int = WINDOW_MS) -> DataFrame:
    """One row: rate from the last listed sample of the window to (now, current); 0 without one, or without time between."""
    kept = pruned(samples, now_ms, window_ms).agg(F.max_by(F.struct("ts_ms", "total"), "pos").alias("s"))
    ms = F.lit(now_ms) - F.col("s.ts_ms")
    rate = F.greatest(F.lit(current) - F.col("s.total"), F.lit(0)) / (ms / 1000)
    return kept.select(F.when(F.col("s").isNull() | (ms <= 0), F.lit(0.0)).otherwise(rate).alias("rate"))


def rolling_rate(samples: DataFrame, window_ms: int = WINDOW_MS, series: str = "series") -> DataFrame:
    """Rate at every sample from the first one within its window; 0 where the counter has fallen."""
    w = Window.partitionBy(series).orderBy("ts_ms").rangeBetween(-window_ms, 0)
    old_ms, old = F.first("ts_ms").over(w), F.first("total").over(w)
    ms = F.col("ts_ms") - old_ms
    return samples.withColumn("rate", F.when(ms > 0, F.greatest(F.col("total") - old, F.lit(0)) / (ms / 1000)).otherwise(F.lit(0.0)))


def pair_rates(samples: DataFrame, series: str = "series") -> DataFrame:
    """Rate between neighbouring samples, at the later one's time."""
    w = Window.partitionBy(series).orderBy("ts_ms", F.desc("pos") if "pos" in samples.columns else "total")
    ms = F.col("ts_ms") - F.lag("ts_ms").over(w)
    rate = F.when(ms > 0, F.greatest(F.col("total") - F.lag("total").over(w), F.lit(0)) / (ms / 1000)).otherwise(F.lit(0.0))
    return samples.withColumn("rate", F.when(ms.isNotNull(), rate)).where(F.col("rate").isNotNull())


def bucket_of(ts_ms: Column, start_ms: Column, width_ms: int, buckets: int) -> Column:
    """Half-open buckets, the last one closed; null outside."""
    i = F.floor((ts_ms - start_ms) / width_ms)
    last = ts_ms == start_ms + width_ms * buckets
    return F.when(last, F.lit(buckets - 1)).when((i >= 0) & (i < buckets), i).cast("int")


def bucket_rates(samples: DataFrame, now_ms: int, window_ms: int = GRAPH_MS, buckets: int = BUCKETS, series: str = "series") -> DataFrame:
    """(series, bucket, rate): unweighted means of neighbours' rates in buckets aligned to their width, 0 where none."""
    width = window_ms // buckets
    start = F.lit((now_ms // width) * width - width * (buckets - 1))
    rates = pair_rates(pruned(samples, now_ms, max(window_ms, 0)), series).withColumn("bucket", bucket_of(F.col("ts_ms"), start, width, buckets))
    means = rates.where(F.col("bucket").isNotNull()).groupBy(series, "bucket").agg(F.avg("rate").alias("rate"))
    grid = samples.select(series).distinct().withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    return grid.join(means, [series, "bucket"], "left").withColumn("rate", F.coalesce("rate", F.lit(0.0)))


def levels(rates: DataFrame, series: str = "series", steps: int = 8) -> DataFrame:
    """Level 0 to steps - 1 of each bucket, on the scale of the series' highest."""
    top = F.max("rate").over(Window.partitionBy(series))
    return rates.withColumn("level", F.when(top > 0, F.round(F.col("rate") / top * (steps - 1))).otherwise(F.lit(0.0)).cast("int"))


def once_a_second(samples: DataFrame, series: str = "series", every_ms: int = 1000) -> DataFrame:
    """First sample of each wall second of a series: at most one recomputation."""
    slot = F.floor(F.col("ts_ms") / every_ms)
    w = Window.partitionBy(series, slot).orderBy("ts_ms", "total")
    return samples.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
