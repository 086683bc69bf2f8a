"""Run state over an event stream: counters, last event, stall and retry timers, by run."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.events import INPUT_NAMES, OUTPUT_NAMES, TOTAL_NAMES, counter, needs_operator, token_usage
from ..functions.text import bound

_STATE = "input long, output long, total long, turns long, session string, last_event string, last_ms long, attempt long, retry_at long"
OUTPUT = "issue_id string, kind string, at_ms long, event string, input_tokens long, output_tokens long, total_tokens long, turn_count long, session_id string, attempt long, due_ms long"

ENDED = {"run_completed": "completed", "run_failed": "retry", "turn_input_required": "blocked", "run_released": "released"}


def prepared(events: DataFrame, running: DataFrame | None = None) -> DataFrame:
    """Events with a run, an event name and a time, and the counters they report; with running(issue_id), only of these runs."""
    if running is not None:
        events = events.join(running.select("issue_id").distinct(), "issue_id", "left_semi")
    counts = lambda u: F.struct(counter(u, INPUT_NAMES).alias("input"), counter(u, OUTPUT_NAMES).alias("output"), counter(u, TOTAL_NAMES).alias("total"))
    known = events.where("issue_id IS NOT NULL AND event IS NOT NULL AND ts IS NOT NULL")
    event = F.when(needs_operator(F.col("event"), F.col("payload")), "turn_input_required").otherwise(F.col("event"))
    return known.select("issue_id", event.alias("event"), "ts", "session_id", bound(token_usage(F.col("payload")), counts).alias("counts")).select("issue_id", "event", "ts", "session_id", "counts.*")


class RunProcessor(StatefulProcessor):
    """Keeps one row of state a run; a timer fires when a run stalls or its retry is due.

    State ends with the run: when it is released, when its continuation is due,
    when it stalls, and, as a failed run's number of attempts outlives its retry,
    when nothing has followed the retry for stall_ms.
    """

    def __init__(self, stall_ms: int = 300_000, cap_ms: int = 300_000):
        self.stall_ms, self.cap_ms = stall_ms, cap_ms

    def init(self, handle):
        self.handle = handle
        self.state = handle.getValueState("run", _STATE)

    def _row(self, key, kind, at, event, s, due=None):
        return pd.DataFrame([{
            "issue_id": key[0], "kind": kind, "at_ms": at, "event": event, "input_tokens": s[0], "output_tokens": s[1], "total_tokens": s[2],
            "turn_count": s[3], "session_id": s[4], "attempt": s[7], "due_ms": due,
        }])

    def _clear_timers(self):
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = list(self.state.get()) if self.state.exists() else [0, 0, 0, 0, None, None, 0, 0, None]
        batch = pd.concat(list(rows)).sort_values("ts", kind="stable")
        due = None
        for r in batch.itertuples(index=False):
            for i, name in enumerate(("input", "output", "total")):
                value = getattr(r, name)
                if value == value and value is not None:
                    s[i] = max(s[i], int(value))
            if r.event == "session_started" and isinstance(r.session_id, str) and r.session_id != s[4]:
                s[3] += 1
            s[4] = r.session_id if isinstance(r.session_id, str) else s[4]
            s[5], s[6], due = r.event, int(pd.Timestamp(r.ts).value // 1_000_000), None
            if r.event == "run_failed":
                s[7] += 1
                due = s[6] + min(10_000 * 2 ** min(s[7] - 1, 10), self.cap_ms)
            elif r.event == "run_completed":
                s[7], due = 0, s[6] + 1000
        kind = ENDED.get(s[5], "running")
        s[8] = due
        self._clear_timers()
        if kind == "released":
            self.state.clear()
            yield self._row(key, kind, s[6], s[5], s)
            return
        self.state.update(tuple(s))
        if kind == "running" and self.stall_ms > 0:
            self.handle.registerTimer(s[6] + self.stall_ms)
        elif due is not None:
            self.handle.registerTimer(due)
        yield self._row(key, kind, s[6], s[5], s, due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        if not self.state.exists():
            return
        s = list(self.state.get())
        if s[8] is None:
            self.state.clear()
            if s[5] not in ENDED:
                yield self._row(key, "stalled", at, s[5], s)
            return
        yield self._row(key, "retry_due", at, s[5], s)
        if s[7] == 0:
            self.state.clear()
        else:
            s[8] = None
            self.state.update(tuple(s))
            self.handle.registerTimer(at + max(self.stall_ms, 1))

    def close(self):
        pass


def run_states(events: DataFrame, stall_ms: int = 300_000, delay: str = "0 seconds", running: DataFrame | None = None) -> DataFrame:
    """Stream of run states and fired timers, in event time.

    Rows later than the watermark's delay are dropped, which is what the state's
    order needs; ts must be a timestamp with zone.
    """
    return (
        prepared(events, running).withWatermark("ts", delay).groupBy("issue_id")
        .transformWithStateInPandas(RunProcessor(stall_ms), outputStructType=OUTPUT, outputMode="Update", timeMode="EventTime")
    )


class ChangedOnly:
    """foreachBatch function: hands on a batch's snapshot only if it differs from the last one, or after `most` equal ones."""

    def __init__(self, sink, most: int = 60):
        self.sink, self.most, self.last, self.same = sink, most, None, 0

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        mark = batch.agg(F.bit_xor(F.xxhash64(*batch.columns)).alias("h"), F.count("*").alias("n")).first()
        self.same = self.same + 1 if mark == self.last else 0
        if mark != self.last or self.same >= self.most:
            self.last, self.same = mark, 0
            self.sink(batch, epoch)


class Ticks:
    """Poll ticks with tokens: scheduling one supersedes the one before, whose firing is then ignored."""

    def __init__(self, poll_ms: int):
        self.poll_ms, self.token, self.due_ms, self.polling = poll_ms, 0, None, False

    def schedule(self, now_ms: int, delay_ms: int | None = None) -> int:
        self.token, self.due_ms = self.token + 1, now_ms + (self.poll_ms if delay_ms is None else max(delay_ms, 0))
        return self.token

    def fired(self, token: int) -> bool:
        """True if a poll is to start: the token is the last one given out, and has not fired yet."""
        if token != self.token or self.due_ms is None:
            return False
        self.due_ms, self.polling = None, True
        return True

    def polled(self, now_ms: int) -> int:
        """The poll has ended; token of the next tick."""
        self.polling = False
        return self.schedule(now_ms)


class RenderLimit:
    """At most one rendering an interval: content in between waits, the last of it, for one flush at the interval's end."""

    def __init__(self, interval_ms: int = 16):
        self.interval_ms, self.at_ms, self.shown, self.pending, self.flush_ms = interval_ms, None, None, None, None

    def offer(self, content: str, now_ms: int) -> str | None:
        """The content if it is to be shown now."""
        if content == self.shown:
            return None
        if self.flush_ms is None and (self.at_ms is None or now_ms - self.at_ms >= self.interval_ms):
            return self._show(content, now_ms)
        self.pending = content
        if self.flush_ms is None:
            self.flush_ms = now_ms + max(1, self.interval_ms - (now_ms - self.at_ms))
        return None

    def flush(self, now_ms: int) -> str | None:
        """What has waited, once the interval is over."""
        if self.flush_ms is None or now_ms < self.flush_ms:
            return None
        content, self.pending, self.flush_ms = self.pending, None, None
        return None if content == self.shown else self._show(content, now_ms)

    def _show(self, content: str, now_ms: int) -> str:
        self.shown, self.at_ms = content, now_ms
        return content


class Refresh:
    """Manual refresh requests: those made while one is pending are one."""

    def __init__(self):
        import threading

        self._lock, self._pending = threading.Lock(), False

    def request(self) -> dict:
        with self._lock:
            coalesced, self._pending = self._pending, True
        return {"queued": True, "coalesced": coalesced}

    def take(self) -> bool:
        with self._lock:
            had, self._pending = self._pending, False
        return had
