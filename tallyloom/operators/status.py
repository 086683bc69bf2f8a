"""Status tables and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.events import event_sentence, rate_limits_text
from ..functions.text import cell, compact_id, countdown, duration_with_turns, elapsed_seconds, error_line, grouped, iso_seconds, safe_link


class NotFound(LookupError):
    """No row has the identifier (404)."""


class Unavailable(RuntimeError):
    """The snapshot could not be had in time (503)."""


def running_rows(running: DataFrame, now: Column) -> DataFrame:
    return running.withColumn("runtime_seconds", elapsed_seconds(F.col("started_at"), now)).withColumn("issue_url", safe_link(F.col("issue_url")))


def status_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(status, n) of every table, 0 for empty ones."""
    out = None
    for name, d in tables.items():
        row = d.agg(F.lit(name).alias("status"), F.count("*").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


def snapshot(running: DataFrame, retrying: DataFrame, blocked: DataFrame, totals: DataFrame, now: Column, now_ms: int) -> dict[str, DataFrame]:
    return {
        "running": running_rows(running, now).orderBy("identifier"),
        "retrying": retrying.withColumn("due_in_ms", F.greatest(F.col("due_at_ms") - now_ms, F.lit(0))).orderBy("due_in_ms", "identifier"),
        "blocked": blocked.orderBy("identifier"),
        "totals": totals,
    }


def _running_entry() -> Column:
    message = event_sentence(F.col("last_event"), F.col("last_message"))
    tokens = F.struct("input_tokens", "output_tokens", "total_tokens")
    return F.struct(
        "issue_id", F.col("identifier").alias("issue_identifier"), "issue_url", "state", "worker_host", "workspace_path", "session_id", "turn_count", "last_event",
        message.alias("last_message"), iso_seconds(F.col("started_at")).alias("started_at"), iso_seconds(F.col("last_ts")).alias("last_event_at"), tokens.alias("tokens"),
    )


def _retry_entry(now: Column) -> Column:
    at = F.timestamp_add("SECOND", F.floor(F.col("due_in_ms") / 1000).cast("int"), now)
    return F.struct("issue_id", F.col("identifier").alias("issue_identifier"), "attempt", iso_seconds(at).alias("due_at"), "error", "worker_host", "workspace_path")


def _blocked_entry() -> Column:
    return F.struct("issue_id", F.col("identifier").alias("issue_identifier"), "state", "error", "worker_host", "session_id", iso_seconds(F.col("blocked_at")).alias("blocked_at"))


def _as_list(rows: DataFrame, order: Column, entry: Column, name: str) -> DataFrame:
    held = F.sort_array(F.collect_list(F.struct(order.alias("o"), F.to_json(entry).alias("j"))))
    return rows.agg(F.concat(F.lit("["), F.array_join(F.transform(held, lambda x: x["j"]), ","), F.lit("]")).alias(name))


def state_document(running: DataFrame, retrying: DataFrame, blocked: DataFrame, totals: DataFrame, now: Column, now_ms: int) -> DataFrame:
    """One row: the whole state as a JSON text. What runs at once is bounded by the configured limits."""
    s = snapshot(running, retrying, blocked, totals, now, now_ms)
    parts = [
        status_counts({"running": running, "retrying": retrying, "blocked": blocked}).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("status", "n")))).alias("counts")),
        _as_list(s["running"], F.col("identifier"), _running_entry(), "running"),
        _as_list(s["retrying"], F.col("due_in_ms"), _retry_entry(now), "retrying"),
        _as_list(s["blocked"], F.col("identifier"), _blocked_entry(), "blocked"),
        totals.select(F.to_json(F.struct("*")).alias("totals")),
    ]
    doc = parts[0]
    for p in parts[1:]:
        doc = doc.crossJoin(p)  # one row each
    pair = lambda n: F.concat(F.lit(f'"{n}":'), F.col(n))
    text = F.concat(F.lit('{"generated_at":"'), iso_seconds(now), F.lit('",'), F.concat_ws(",", *(pair(n) for n in ("counts", "running", "retrying", "blocked", "totals"))), F.lit("}"))
    return doc.select(text.alias("document"))


def item_document(lookup: DataFrame, identifier: str) -> DataFrame:
    """One row of reconcile.by_identifier as JSON; NotFound if there is none."""
    row = lookup.where(F.col("identifier") == identifier).select(F.to_json(F.struct("*")).alias("document"))
    if row.isEmpty():
        raise NotFound(identifier)
    return row


def running_lines(running: DataFrame, now: Column) -> DataFrame:
    """Text table row of each run."""
    r = running_rows(running, now)
    line = F.concat_ws(
        " ", cell(F.col("identifier"), 8), cell(F.col("state"), 14), cell(F.col("pid"), 8), cell(duration_with_turns(F.col("runtime_seconds"), F.col("turn_count")), 12),
        cell(grouped(F.col("total_tokens")), 10, right=True), cell(compact_id(F.col("session_id")), 14), event_sentence(F.col("last_event"), F.col("last_message")),
    )
    return r.select("identifier", line.alias("line"))


def retry_lines(retrying: DataFrame) -> DataFrame:
    """Text line of each retry row(identifier, attempt, due_in_ms, error)."""
    line = F.concat(
        F.col("identifier"), F.lit(" attempt="), F.col("attempt").cast("string"), F.lit(" in "), countdown(F.col("due_in_ms")),
        F.coalesce(F.concat(F.lit(" error="), error_line(F.col("error"))), F.lit("")),
    )
    return retrying.select("identifier", "due_in_ms", line.alias("line"))


def frame(running: DataFrame, retrying: DataFrame, totals: DataFrame, rate_limits: DataFrame, now: Column) -> DataFrame:
    """(part, key, line): rows of the text dashboard; order by part and key."""
    t = totals.select(F.lit(0).alias("part"), F.lit("").alias("key"), F.concat(F.lit("Tokens: in "), grouped(F.col("input_tokens")), F.lit(" | out "), grouped(F.col("output_tokens")), F.lit(" | total "), grouped(F.col("total_tokens"))).alias("line"))
    l = rate_limits.select(F.lit(1).alias("part"), F.lit("").alias("key"), F.concat(F.lit("Rate limits: "), rate_limits_text(F.col("rate_limits"))).alias("line"))
    r = running_lines(running, now).select(F.lit(2).alias("part"), F.col("identifier").alias("key"), "line")
    q = retry_lines(retrying).select(F.lit(3).alias("part"), F.format_string("%020d", F.col("due_in_ms")).alias("key"), "line")
    return t.unionByName(l).unionByName(r).unionByName(q)
