"""Usage counters and latest-by-run state from ordered events(issue_id, seq, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.events import INPUT_NAMES, OUTPUT_NAMES, TOTAL_NAMES, counter, may_limit, rate_limits, token_usage
from ..functions.text import elapsed_seconds

_REPORTED = (("input", INPUT_NAMES), ("output", OUTPUT_NAMES), ("total", TOTAL_NAMES))


def reported(events: DataFrame) -> DataFrame:
    """Adds the cumulative counters that each event reports (null: none)."""
    usage = token_usage(F.col("payload"), F.col("usage")) if "usage" in events.columns else token_usage(F.col("payload"))
    e = events.withColumn("_usage", usage)
    for name, names in _REPORTED:
        e = e.withColumn(f"{name}_reported", counter(F.col("_usage"), names))
    return e.drop("_usage")


def deltas(events: DataFrame, value: str, run: str = "issue_id", order: str = "seq", to: str = "delta") -> DataFrame:
    """Increase of a cumulative counter over the highest that its run has reported; a drop counts as 0."""
    w = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max(value).over(w), F.lit(0))
    return events.withColumn(to, F.greatest(F.coalesce(F.col(value) - before, F.lit(0)), F.lit(0)))


def marks(events: DataFrame, value: str, run: str = "issue_id", order: str = "seq", to: str = "mark") -> DataFrame:
    """High-water mark of a counter up to each event."""
    w = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn(to, F.coalesce(F.max(value).over(w), F.lit(0)))


def totals(events: DataFrame, ended: DataFrame | None = None) -> DataFrame:
    """One row: tokens of all runs, and seconds of ended(started_at, ended_at) runs; none below 0."""
    e = reported(events)
    for name, _ in _REPORTED:
        e = deltas(e, f"{name}_reported", to=f"{name}_delta")
    t = e.agg(*(F.greatest(F.coalesce(F.sum(f"{n}_delta"), F.lit(0)), F.lit(0)).alias(f"{n}_tokens") for n, _ in _REPORTED))
    if ended is None:
        return t.withColumn("seconds_running", F.lit(0).cast("long"))
    return t.crossJoin(run_seconds(ended))  # one row each


def run_seconds(ended: DataFrame, live: DataFrame | None = None, now=None) -> DataFrame:
    """One row: seconds of ended runs, and of live(started_at) ones up to now."""
    rows = ended.select(elapsed_seconds(F.col("started_at"), F.col("ended_at")).alias("s"))
    if live is not None:
        rows = rows.unionByName(live.select(elapsed_seconds(F.col("started_at"), now).alias("s")))
    return rows.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("seconds_running"))


def latest(events: DataFrame, run: str = "issue_id", order: str = "seq") -> DataFrame:
    """Last event, time and payload of each run; session and pid are the last ones known."""
    known = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
    last = lambda c, to: F.max_by(c, order).alias(to)
    return events.groupBy(run).agg(last("event", "last_event"), last("ts", "last_ts"), last("payload", "last_message"), known("session_id"), known("pid"))


def latest_rate_limits(events: DataFrame, order: str = "seq") -> DataFrame:
    """One row: the last rate limits of any run."""
    e = events.where(may_limit(F.col("payload"))).withColumn("rate_limits", rate_limits(F.col("payload"))).where(F.col("rate_limits").isNotNull())
    return e.agg(F.max_by("rate_limits", order).alias("rate_limits"))


def session_count(events: DataFrame, run: str = "issue_id", order: str = "seq", started: str = "session_started") -> DataFrame:
    """Session starts of each run that name another session than the one before."""
    w = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.last("session_id", ignorenulls=True).over(w)
    new = (F.col("event") == started) & F.col("session_id").isNotNull() & ~F.col("session_id").eqNullSafe(before)
    return events.withColumn("_new", new.cast("long")).groupBy(run).agg(F.coalesce(F.sum("_new"), F.lit(0)).alias("turn_count"))
