"""Requests and answers of tracker clients, id pushdown, raw queries, templates, ticks and render limit."""

from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import reconcile
from tallyloom.sources import clients, config, tracker
from tallyloom.streaming.runs import RenderLimit, Ticks
from tests import fake_trackers as fake


def every(client, scope, states=None):
    out, cursor = [], None
    while True:
        rows, cursor = client.pages(scope, states, cursor)
        out += rows
        if cursor is None:
            return out


def test_scans_and_lookups():
    git = clients.client("github", fake.github)
    assert len(every(git, "o/r")) == 250 and {r["state"] for r in every(git, "o/r", [" Open "])} == {"open"} and every(git, "o/r", ["odd"]) == []
    assert [r["number"] for r in git.by_ids("o/r", ["7", "999", " 3", "7", "x"])] == [7, 3]
    jira = clients.client("jira", fake.jira)
    assert [r["id"] for r in every(jira, "P", ["To Do"])] == [str(i) for i in range(9)]
    got = [r["id"] for r in jira.by_ids("P", map(str, [*range(250, 0, -1), 5, 400]))]
    assert got == [str(i) for i in range(250, 0, -1) if i % 10]
    with pytest.raises(clients.PagingError):
        every(jira, "bad")
    linear = clients.client("linear", fake.linear)
    assert [r["id"] for r in every(linear, "s", ["Todo"])] == ["c0", "c1", "c2"]
    assert [r["id"] for r in linear.by_ids("s", [f"i{k}" for k in range(120)] + ["none"])] == [f"i{k}" for k in range(120)]
    assert clients.assignee("linear", linear, " me ") == "u1" and clients.assignee("jira", jira, "me") == "me" and clients.assignee("jira", jira, " ") is None
    asana = clients.client("asana", fake.asana)
    assert [r["gid"] for r in every(asana, "p", ["Todo"])] == ["1", "3", "5"] and [r["gid"] for r in asana.by_ids("p", ["8", "3", "12", "1"])] == ["3", "1"]
    assert [r["iid"] for r in clients.client("gitlab", fake.gitlab).by_ids("a/b", ["2", "1"])] == [1] and len(every(clients.client("gitlab", fake.gitlab), "a/b", ["opened"])) == 1
    with pytest.raises(clients.TrackerError):
        clients.client("other", fake.github)
    with pytest.raises(clients.TrackerError):
        clients.client("github", lambda r: (500, None)).pages("o/r", None, None)


def test_source_by_kind(spark):
    tracker.register(spark)
    read = lambda: spark.read.format("tracker").options(kind="github", transport="tests.fake_trackers:github", scopes="o/r").load()
    assert read().count() == 250 and read().where("state = 'closed'").count() == 83
    assert sorted(r["id"] for r in read().where(F.col("id").isin("4", "5", "777")).collect()) == ["4", "5"]
    assert [r["id"] for r in read().where("id = '6' AND state = 'closed'").collect()] == ["6"]


def test_raw_queries():
    sent = []
    send = lambda r: (sent.append(r), (200, {}))[1]
    clients.raw_query("jira", send, " get ", "/rest/api/3/myself", {"a": 1})
    assert (sent[0].method, sent[0].path) == ("GET", "/rest/api/3/myself")
    for method, path in (("TRACE", "/rest/api/3/x"), ("GET", "/other"), ("GET", "/rest/api/3/http://x"), ("GET", "/rest/api/3/../x"), (None, "/rest/api/3/x"), ("GET", "/rest/api/3/a\nb")):
        with pytest.raises(ValueError):
            clients.raw_query("jira", send, method, path)


def test_templates_and_config():
    values = {"issue": {"title": " a b ", "labels": ["x", "y"], "created": datetime(2026, 1, 2, 3, 4, tzinfo=timezone.utc), "day": date(2026, 1, 2), "none": None, "ok": True}}
    show = lambda t: config.rendered(t, values)
    assert show("{{ issue.title | strip | upcase }}|{{ issue.labels | join: ', ' }}|{{issue.none | default: \"-\"}}|{{ issue.ok }}") == "A B|x, y|-|true"
    assert show("{{ issue.created }} {{ issue.day }} {{ issue.labels | size }}") == "2026-01-02T03:04:00Z 2026-01-02 2"
    for bad in ("{{ issue.title | shout }}", "{{ issue.absent }}"):
        with pytest.raises(config.ConfigError):
            show(bad)
    c, _ = config.parse("---\nmax_turns: '7'\nport: 0\n---\n")
    assert (c.max_turns, c.port) == (7, 0)
    with pytest.raises(config.ConfigError, match="max_turns must be positive; stall_timeout_ms must be 0 or more; refresh_ms must be a whole number; tracker_kind"):
        config.parse("---\nmax_turns: 0\nstall_timeout_ms: -1\nrefresh_ms: soon\ntracker_kind: paper\n---\n")


def test_ticks_and_rendering():
    t = Ticks(30_000)
    old, new = t.schedule(0), t.schedule(5, 0)
    assert not t.fired(old) and t.fired(new) and not t.fired(new) and t.polling
    assert t.fired(t.polled(100)) and t.due_ms is None
    r = RenderLimit(16)
    assert [r.offer("a", 0), r.offer("a", 1), r.offer("b", 3), r.offer("c", 5)] == ["a", None, None, None]
    assert (r.flush_ms, r.flush(10), r.flush(16), r.flush(17)) == (16, None, "c", None)
    assert r.offer("d", 40) == "d"


def test_claims(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert sorted(r["id"] for r in reconcile.claims_after(ids("a", "b"), ids("b", "c", "d"), ids("a", "d", "z")).collect()) == ["b", "c"]
