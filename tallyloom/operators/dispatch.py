"""Dispatch planning: eligibility, order, quotas and hosts, as one relational plan.

The plan equals a sequential fold over the ordered items that takes an item if
its state and the total have room: an item is taken exactly if its rank within
its state is within the state's free slots, and its rank among those is within
the free total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import key_of, non_blank


def normal_set(values) -> list[str]:
    """Trimmed, lower-case values without blanks."""
    return sorted({v.strip().lower() for v in values} - {""})


def in_states(state: Column, states) -> Column:
    return key_of(state).isin(normal_set(states)) if normal_set(states) else F.lit(False)


def routable(dispatchable: Column, labels: Column, required) -> Column:
    """The flag is set and all required labels are there; a blank required label matches nothing."""
    has = F.coalesce(F.transform(labels, key_of), F.array().cast("array<string>"))
    ok = F.coalesce(dispatchable, F.lit(False))
    for label in required:
        name = label.strip().lower()
        ok = ok & (F.array_contains(has, name) if name else F.lit(False))
    return ok


def candidates(items: DataFrame, active, terminal, required=()) -> DataFrame:
    """Items with all four names, routable, in an active state and in no terminal one."""
    named = non_blank(F.col("id")) & non_blank(F.col("identifier")) & non_blank(F.col("title")) & non_blank(F.col("state"))
    return items.where(
        named & routable(F.col("dispatchable"), F.col("labels"), required) & in_states(F.col("state"), active) & ~in_states(F.col("state"), terminal)
    )


def blocked_by_open(blockers: Column, terminal) -> Column:
    """Some blocker is of unknown or non-terminal state."""
    states = normal_set(terminal)
    return F.coalesce(F.exists(blockers, lambda b: ~F.coalesce(key_of(b["state"]).isin(states), F.lit(False))), F.lit(False))


def assigned_to(assignee: Column, worker: str | None) -> Column:
    """True without a worker; else the trimmed assignee is that worker."""
    if worker is None:
        return F.lit(True)
    return F.coalesce(F.trim(assignee) == worker.strip(), F.lit(False))


def not_claimed(items: DataFrame, *claims: DataFrame, key: str = "id") -> DataFrame:
    """Anti join against the ids of all claim tables (one column each)."""
    taken = None
    for c in claims:
        c = c.select(F.col(c.columns[0]).alias(key))
        taken = c if taken is None else taken.union(c)
    return items if taken is None else items.join(taken.distinct(), key, "left_anti")


def priority_rank(priority: Column) -> Column:
    return F.when(priority.between(1, 4), priority).otherwise(5)


def dispatch_order(priority: str = "priority", created: str = "created_at", identifier: str = "identifier", id_col: str = "id") -> list[Column]:
    """Total order of dispatch: priority 1 to 4 then all others, oldest first with unknown ages last, identifier, id."""
    return [
        priority_rank(F.col(priority)).asc(),
        F.col(created).asc_nulls_last(),
        F.coalesce(F.col(identifier), F.col(id_col), F.lit("")).asc(),
        F.col(id_col).asc_nulls_last(),
    ]


def running_by_state(running: DataFrame, state: str = "state") -> DataFrame:
    return running.groupBy(key_of(F.col(state)).alias("state_key")).agg(F.count("*").alias("running"))


def running_by_host(running: DataFrame, host: str = "worker_host") -> DataFrame:
    return running.groupBy(F.col(host).alias("worker_host")).agg(F.count("*").alias("running"))


def free_slots(limit: int, running: DataFrame) -> DataFrame:
    """One row: max(limit - running rows, 0)."""
    return running.agg(F.greatest(F.lit(limit) - F.count("*"), F.lit(0)).cast("long").alias("free"))


def state_room(states: DataFrame, limits: DataFrame, running: DataFrame, default: int) -> DataFrame:
    """(state_key, room): limit of each state, or the default, less what runs in it."""
    limits = limits.select(key_of(F.col("state")).alias("state_key"), F.col("max_running").alias("limit"))
    return (
        states.select(key_of(F.col("state")).alias("state_key")).distinct()
        .join(limits, "state_key", "left").join(running_by_state(running), "state_key", "left")
        .select("state_key", F.greatest(F.coalesce("limit", F.lit(default)) - F.coalesce("running", F.lit(0)), F.lit(0)).alias("room"))
    )


def numbered(items: DataFrame, priority: str = "priority", created: str = "created_at", identifier: str = "identifier", id_col: str = "id") -> DataFrame:
    """items with pos, their place in the whole order of dispatch from 1.

    Items are numbered within their priority and hour of creation, behind the
    counts of the hours before, which are one row each. No task sorts everything.
    """
    d = items.withColumn("_rank", priority_rank(F.col(priority))).withColumn("_hour", F.date_trunc("HOUR", F.col(created).cast("timestamp")))
    counts = d.groupBy("_rank", "_hour").agg(F.count("*").alias("n"))
    before = Window.partitionBy("_rank").orderBy(F.col("_hour").asc_nulls_last())
    ranks = counts.groupBy("_rank").agg(F.sum("n").alias("n_rank"))
    above = Window.partitionBy(F.lit(0)).orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)  # five ranks
    ranks = ranks.select(F.col("_rank").alias("_r"), F.coalesce(F.sum("n_rank").over(above), F.lit(0)).alias("_above"))
    start = counts.join(F.broadcast(ranks), F.col("_rank") == F.col("_r"))
    start = start.select("_r", F.col("_hour").alias("_h"), (F.col("_above") + F.sum("n").over(before) - F.col("n")).alias("_start"))
    pos = F.row_number().over(Window.partitionBy("_rank", "_hour").orderBy(*dispatch_order(priority, created, identifier, id_col)))
    d = d.withColumn("_pos", pos).join(start, (F.col("_rank") == F.col("_r")) & F.col("_hour").eqNullSafe(F.col("_h")))
    return d.withColumn("pos", F.col("_pos") + F.col("_start")).drop("_rank", "_hour", "_r", "_h", "_start", "_pos")


def within_quotas(eligible: DataFrame, room: DataFrame, free: int, order: list[Column], state: str = "state") -> DataFrame:
    """Items taken, with state_rank and dispatch_rank; at most `free`.

    Ranks within a state keep only the rows in its room, by a pruned window; the
    total is an ordered limit, so no task sorts everything. Only the rows that
    the limit keeps, `free` at most, are numbered.
    """
    d = eligible.withColumn("state_key", key_of(F.col(state)))
    d = d.withColumn("state_rank", F.row_number().over(Window.partitionBy("state_key").orderBy(*order))).where(F.col("state_rank") <= free)
    d = d.join(room, "state_key").where(F.col("state_rank") <= F.col("room")).drop("room")
    top = d.orderBy(*order).limit(free)
    return top.withColumn("dispatch_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def host_slots(hosts: DataFrame, running: DataFrame, cap: int | None, free: int) -> DataFrame:
    """(slot, worker_host): free slots of hosts(host_idx, worker_host) in the order of least load, then list position."""
    loads = hosts.join(running_by_host(running), "worker_host", "left").withColumn("running", F.coalesce("running", F.lit(0)))
    most = F.lit(free) if cap is None else F.least(F.lit(cap) - F.col("running"), F.lit(free))
    rows = loads.where(most > 0).withColumn("load", F.explode(F.sequence(F.col("running"), F.col("running") + most - 1)))
    slot = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("load", "host_idx"))  # hosts are a configured list
    return rows.select(slot.alias("slot"), "worker_host")


def dispatch_plan(eligible: DataFrame, room: DataFrame, free: int, order: list[Column], slots: DataFrame | None = None, state: str = "state") -> DataFrame:
    """Items taken and their hosts; without slots every item runs locally (null host)."""
    taken = within_quotas(eligible, room, free, order, state)
    if slots is None:
        return taken.withColumn("worker_host", F.lit(None).cast("string"))
    return taken.join(slots, taken["dispatch_rank"] == slots["slot"]).drop("slot")


def least_loaded(loads: DataFrame, by: list[str], host: str, load: str, position: str) -> DataFrame:
    """The host of least load in each group, ties by position."""
    return loads.groupBy(*by).agg(F.min_by(host, F.struct(load, position)).alias(host), F.min(load).alias(load))
