"""Plans against the sequential rules they stand for."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyloom.functions.text import BLOCKS
from tallyloom.operators import accounting, dispatch, reconcile, retry, status, throughput
from tallyloom.schemas import WORK_ITEM


def item(i, state="Todo", priority=1, created=datetime(2026, 1, 1), **more):
    base = {"id": i, "native_ref": {}, "identifier": i, "title": "t", "description": None, "priority": priority, "state": state, "branch_name": None, "url": None, "assignee_id": None, "blocked_by": [], "labels": [], "dispatchable": True, "created_at": created, "updated_at": None}
    return base | more


def items(spark, rows):
    return spark.createDataFrame(rows, WORK_ITEM)


def test_order(spark):
    d = items(spark, [item("K-8", priority=2, created=datetime(2025, 12, 1)), item("K-9", created=datetime(2026, 1, 2)), item("K-7"), item("K-1", priority=None), item("K-2", priority=9, created=None)])
    assert [r["id"] for r in d.orderBy(*dispatch.dispatch_order()).collect()] == ["K-7", "K-9", "K-8", "K-1", "K-2"]


def test_eligibility(spark):
    rows = [item("a", labels=["backend", "javascript"]), item("b", state="Done", labels=["backend"]), item("c", labels=[]), item(" ", labels=["backend"]), item("e", dispatchable=False, labels=["backend"])]
    ids = lambda req: {r["id"] for r in dispatch.candidates(items(spark, rows), [" todo"], ["done"], req).collect()}
    assert ids([" Backend ", "JAVASCRIPT"]) == {"a"}
    assert ids(["back"]) == ids([" "]) == set()
    assert ids([]) == {"a", "c"}


@pytest.mark.parametrize("seed", range(3))
def test_plan_equals_fold(spark, seed):
    rng = random.Random(seed)
    rows = [item(f"i{n}", state=rng.choice("abc"), priority=rng.choice([1, 2, None])) for n in range(40)]
    limits, default, free, cap = {"a": 4, "b": 0}, 3, rng.randint(1, 12), 2
    busy = [("a", "h1"), ("c", "h0")]
    running = spark.createDataFrame(busy, "state string, worker_host string")
    room = dispatch.state_room(items(spark, rows), spark.createDataFrame(list(limits.items()), "state string, max_running long"), running, default)
    hosts = spark.createDataFrame([("h0", 0), ("h1", 1), ("h2", 2)], "worker_host string, host_idx int")
    slots = dispatch.host_slots(hosts, running, cap, free)
    got = [(r["id"], r["worker_host"]) for r in dispatch.dispatch_plan(items(spark, rows), room, free, dispatch.dispatch_order(), slots).orderBy("dispatch_rank").collect()]
    used, load, expected = {"a": 1, "c": 1}, {"h0": 1, "h1": 1, "h2": 0}, []
    for r in sorted(rows, key=lambda r: (r["priority"] if r["priority"] in (1, 2, 3, 4) else 5, r["created_at"], r["identifier"])):
        host = min((h for h in load if load[h] < cap), key=lambda h: (load[h], h), default=None)
        if len(expected) < free and host and used.get(r["state"], 0) < limits.get(r["state"], default):
            used[r["state"]] = used.get(r["state"], 0) + 1
            load[host] += 1
            expected.append((r["id"], host))
    assert got == expected


def test_reconcile(spark):
    fresh = items(spark, [item("t", state="Done"), item("u", dispatchable=False), item("a"), item("o", state="Other")])
    current = spark.createDataFrame([(x,) for x in "tuaom"], "issue_id string")
    got = {r["issue_id"]: r["action"] for r in reconcile.reconcile(current, fresh, ["Todo"], ["Done"]).collect()}
    assert got == {"t": "terminal", "u": "unroutable", "a": "active", "o": "other", "m": "missing"}


def test_blockers(spark):
    ask = lambda b: spark.createDataFrame([(b,)], "b array<struct<id:string,identifier:string,state:string>>").select(dispatch.blocked_by_open(F.col("b"), ["Done"])).first()[0]
    assert ask([("1", "x", "Todo")]) and ask([("1", "x", None)])
    assert not ask([("1", "x", " done ")]) and not ask([]) and not ask(None)


def test_counters(spark):
    rows = [("r", 1, 8), ("r", 2, None), ("r", 3, 10), ("r", 4, 4), ("r", 5, 12), ("q", 1, 5)]
    d = accounting.deltas(spark.createDataFrame(rows, "issue_id string, seq long, v long"), "v")
    got = [(r["issue_id"], r["seq"], r["delta"]) for r in d.orderBy("issue_id", "seq").collect()]
    assert got == [("q", 1, 5), ("r", 1, 8), ("r", 2, 0), ("r", 3, 2), ("r", 4, 0), ("r", 5, 2)]


def test_sessions(spark):
    rows = [("r", 1, "session_started", "a"), ("r", 2, "session_started", "a"), ("r", 3, "other", "b"), ("r", 4, "session_started", "b"), ("r", 5, "session_started", None)]
    d = spark.createDataFrame(rows, "issue_id string, seq long, event string, session_id string")
    assert accounting.session_count(d).first()["turn_count"] == 1


@pytest.mark.parametrize(("samples", "now", "current", "rate"), [([], 7_000, 5, 0.0), ([(6_500, 30)], 7_000, 36, 12.0), ([(1_900, 3)], 7_000, 90, 0.0), ([(6_800, 10), (6_000, 44), (5_000, 60)], 7_000, 90, 15.0), ([(6_000, 50)], 7_000, 20, 0.0)])
def test_rate(spark, samples, now, current, rate):
    d = spark.createDataFrame([(i, t, v) for i, (t, v) in enumerate(samples)], "pos int, ts_ms long, total long")
    assert throughput.rate_now(d, now, current).first()["rate"] == rate


def test_graphs(spark):
    """Against a plain fold over neighbouring samples."""
    rng, now, width = random.Random(4), 1_234_567, 600_000 // 24
    samples, total = [], 0
    for t in sorted(rng.sample(range(now - 700_000, now), 90)) + [now]:
        total = total + rng.randint(0, 400) if rng.random() < 0.9 else rng.randint(0, 50)
        samples.append((t, total))
    kept = [x for x in samples if x[0] >= now - 600_000]
    start, held = now // width * width - width * 23, [[] for _ in range(24)]
    for (t0, v0), (t1, v1) in zip(kept, kept[1:], strict=False):
        if t1 >= start:
            held[min(23, (t1 - start) // width)].append(max(0, v1 - v0) / ((t1 - t0) / 1000))
    mean = [sum(h) / len(h) if h else 0.0 for h in held]
    expected = "".join(BLOCKS[int(x / max(mean) * 7 + 0.5)] for x in mean)
    d = spark.createDataFrame([("s", t, v, i) for i, (t, v) in enumerate(reversed(samples))], "series string, ts_ms long, total long, pos int")
    got = throughput.levels(throughput.bucket_rates(d, now)).orderBy("bucket").collect()
    assert "".join(BLOCKS[r["level"]] for r in got) == expected and len(set(expected)) > 3


def test_numbered(spark):
    rng = random.Random(2)
    rows = [item(f"n{k}", priority=rng.choice([1, 2, None, 7]), created=rng.choice([None, datetime(2026, 1, 1, rng.randint(0, 5), rng.randint(0, 59))])) for k in range(60)]
    got = [r["id"] for r in dispatch.numbered(items(spark, rows)).orderBy("pos").collect()]
    assert got == [r["id"] for r in items(spark, rows).orderBy(*dispatch.dispatch_order()).collect()]
    assert sorted(r["pos"] for r in dispatch.numbered(items(spark, rows)).collect()) == list(range(1, 61))


def test_attempts_and_stalls(spark):
    rows = [("r", i, x) for i, x in enumerate("efeefff")]
    d = spark.createDataFrame([(r, i, x == "f") for r, i, x in rows], "run string, seq int, bad boolean")
    got = [(r["seq"], r["attempt"]) for r in retry.attempts(d, F.col("bad"), "run", ["seq"]).orderBy("seq").collect()]
    assert got == [(1, 1), (4, 1), (5, 2), (6, 3)]
    r = spark.createDataFrame([("a", datetime(2026, 1, 1), None), ("b", datetime(2026, 1, 1), datetime(2026, 1, 1, 0, 5))], "id string, started_at timestamp, last_ts timestamp")
    now = F.lit(datetime(2026, 1, 1, 0, 5, 1))
    assert [x["id"] for x in retry.stalled(r, now, 300_000).collect()] == ["a"]
    assert retry.stalled(r, now, 0).count() == 0


def test_item_document(spark):
    none = spark.createDataFrame([], "identifier string, issue_id string, worker_host string, error string, attempt long, state string")
    one = spark.createDataFrame([("X-1", "1", "h", "boom", 2, "todo")], none.schema)
    look = reconcile.by_identifier(none, one, none)
    assert '"status":"retrying"' in status.item_document(look, "X-1").first()["document"]
    with pytest.raises(status.NotFound):
        status.item_document(look, "nope")
