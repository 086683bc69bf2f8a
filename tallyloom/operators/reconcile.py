"""Joins of state tables with fresh snapshots: what to do with each row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import key_of
from .dispatch import in_states, routable


def reconcile(current: DataFrame, fresh: DataFrame, active, terminal, required=(), key: str = "issue_id") -> DataFrame:
    """Each row of current with an action: terminal, unroutable, active, other or missing.

    Terminal rows stop and clean up, unroutable and other rows stop, active rows
    go on with the fresh state, missing rows stop.
    """
    f = fresh.select(F.col("id").alias(key), F.col("state").alias("fresh_state"), F.col("dispatchable").alias("_d"), F.col("labels").alias("_l"), F.lit(True).alias("_seen"))
    action = (
        F.when(F.col("_seen").isNull(), "missing")
        .when(in_states(F.col("fresh_state"), terminal), "terminal")
        .when(~routable(F.col("_d"), F.col("_l"), required), "unroutable")
        .when(in_states(F.col("fresh_state"), active), "active")
        .otherwise("other")
    )
    return current.join(f, key, "left").withColumn("action", action).drop("_d", "_l", "_seen")


def revalidate(planned: DataFrame, fresh: DataFrame, still_eligible) -> DataFrame:
    """Each planned id with its outcome: ok, changed or missing."""
    f = fresh.select(F.col("id"), still_eligible.alias("_ok"), F.lit(True).alias("_seen"))
    outcome = F.when(F.col("_seen").isNull(), "missing").when(F.col("_ok"), "ok").otherwise("changed")
    return planned.join(f, "id", "left").withColumn("outcome", outcome).drop("_ok", "_seen")


def retry_outcomes(retries: DataFrame, fresh: DataFrame, active, terminal, required=()) -> DataFrame:
    """Due retries: release_and_clean (terminal), retry (eligible) or release."""
    r = reconcile(retries, fresh, active, terminal, required)
    outcome = F.when(F.col("action") == "terminal", "release_and_clean").when(F.col("action") == "active", "retry").otherwise("release")
    return r.withColumn("outcome", outcome)


def in_requested_order(items: DataFrame, requested: DataFrame, key: str = "id", keep_unknown: bool = False) -> DataFrame:
    """Items of requested(pos, key), with their position; with keep_unknown the others come last (null pos)."""
    first = requested.groupBy(key).agg(F.min("pos").alias("pos"))
    return items.join(first, key, "left" if keep_unknown else "inner")


def not_visible(requested: DataFrame, visible: DataFrame, key: str = "id") -> DataFrame:
    return requested.join(visible.select(key), key, "left_anti")


def merged_pages(*pages: DataFrame) -> DataFrame:
    """All pages, with the page each row came from, in place of an order of arrival."""
    out = None
    for i, page in enumerate(pages):
        page = page.withColumn("page", F.lit(i))
        out = page if out is None else out.unionByName(page)
    return out


def by_identifier(running: DataFrame, retrying: DataFrame, blocked: DataFrame) -> DataFrame:
    """One row an identifier over all three tables: status and fields with their precedence.

    Running precedes retrying precedes blocked, but an error is that of the
    blocked row first.
    """
    side = lambda d, n, *cols: d.select("identifier", F.lit(n).alias(f"{n}_status"), *(F.col(c).alias(f"{n}_{c}") for c in cols))
    a = side(running, "running", "issue_id", "worker_host", "state")
    b = side(retrying, "retrying", "issue_id", "worker_host", "error", "attempt")
    c = side(blocked, "blocked", "issue_id", "worker_host", "error", "state")
    d = a.join(b, "identifier", "full").join(c, "identifier", "full")
    first = lambda *cols: F.coalesce(*(F.col(x) for x in cols))
    return d.select(
        "identifier",
        first("running_status", "retrying_status", "blocked_status").alias("status"),
        first("running_issue_id", "retrying_issue_id", "blocked_issue_id").alias("issue_id"),
        first("running_worker_host", "retrying_worker_host", "blocked_worker_host").alias("worker_host"),
        first("running_state", "blocked_state").alias("state"),
        F.greatest(F.coalesce(F.col("retrying_attempt"), F.lit(0)) - 1, F.lit(0)).alias("restart_count"),
        first("blocked_error", "retrying_error").alias("last_error"),
    )


def by_reference(running: DataFrame, refs: DataFrame, ref: str = "ref") -> DataFrame:
    """Reverse lookup: issue id of each monitor reference."""
    return refs.join(running.select(ref, "issue_id"), ref, "left")


def same_scope(a, b):
    return key_of(a) == key_of(b)


def claims_after(claims: DataFrame, claimed: DataFrame, released: DataFrame) -> DataFrame:
    """The set of claimed ids after a round: first the new claims go in, then the completed and released ones out (one column each)."""
    key = claims.columns[0]
    named = lambda d: d.select(F.col(d.columns[0]).alias(key))
    return named(claims).union(named(claimed)).distinct().join(named(released).distinct(), key, "left_anti")


def latest_page_row(items: DataFrame, key: str = "id") -> DataFrame:
    """One row a key where pages overlap: that of the last page."""
    w = Window.partitionBy(key).orderBy(F.desc("page"))
    return items.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
