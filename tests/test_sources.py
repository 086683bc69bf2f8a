"""Normalizers, paged sources, event lines, workflow files and streams."""

import json
from datetime import datetime, timezone

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tallyloom import schemas
from tallyloom.sources import config, events, providers, tracker


def landed(spark, schema, *rows):
    return spark.createDataFrame([(json.dumps(r),) for r in rows], "j string").select(F.from_json("j", schema).alias("r")).select("r.*")


def test_linear(spark):
    link = lambda kind, state: {"type": kind, "issue": {"id": "9", "identifier": "MT-9", "state": {"name": state}}}
    raw = {"id": "1", "identifier": "MT-1", "title": "t", "state": {"name": "Todo"}, "labels": {"nodes": [{"name": "Backend"}, {"name": " backend "}, {"name": " "}]},
           "inverseRelations": {"nodes": [link("blocks", "In Progress"), link("relatesTo", "Todo")]}, "createdAt": "2026-01-01T00:00:00Z"}
    r = providers.linear(landed(spark, schemas.LINEAR, raw)).first()
    assert (r["labels"], len(r["blocked_by"]), r["dispatchable"]) == (["backend"], 1, False)
    raw["inverseRelations"]["nodes"][0] = link("blocks", "Done")
    assert providers.linear(landed(spark, schemas.LINEAR, raw)).first()["dispatchable"]
    assert not providers.linear(landed(spark, schemas.LINEAR, raw), worker="me").first()["dispatchable"]


def test_github_scan_and_lookup(spark):
    rows = [{"number": i, "id": 100 + i, "title": "t" if i != 3 else " ", "state": "open" if i != 4 else "closed", "labels": [{"name": " Bug "}]} for i in range(1, 7)]
    rows[4]["pull_request"] = {"url": "u"}
    items = providers.github(landed(spark, schemas.GITHUB, *rows))
    seen = Observation("scan")
    got = providers.scan(items, ["open"], seen).collect()
    assert {r["id"]: r["dispatchable"] for r in got} == {"1": True, "2": True, "5": False, "6": True}
    assert seen.get["malformed"] == 1 and got[0]["identifier"].startswith("GH-")
    assert providers.scan(items, [" "]).count() == 0
    asked = spark.createDataFrame([(0, "6"), (1, "2"), (2, "404"), (3, "6")], "pos int, id string")
    assert [r["id"] for r in providers.lookup(items, asked).orderBy("pos").collect()] == ["6", "2"]
    with pytest.raises(PySparkException):
        providers.lookup(items, spark.createDataFrame([(0, "3")], "pos int, id string")).collect()


def test_other_trackers(spark):
    g = providers.gitlab(landed(spark, schemas.GITLAB, {"iid": 5, "id": 50, "title": "t", "state": "opened", "assignees": [], "assignee": {"id": 7}, "labels": ["A"]})).first()
    assert (g["id"], g["identifier"], g["assignee_id"], g["labels"], "project_id" in g["native_ref"]) == ("5", "GL-5", "7", ["a"], False)
    para = lambda *c: {"type": "paragraph", "content": list(c)}
    doc = {"type": "doc", "content": [para({"type": "text", "text": "First line"}, {"type": "hardBreak"}, {"type": "text", "text": "Second line"})]}
    blocker = {"type": {"name": "Blocks"}, "inwardIssue": {"id": "2", "key": "P-2", "fields": {"status": {"name": "To Do"}}}}
    raw = {"id": "1", "key": "P 1", "fields": {"summary": "s", "description": json.dumps(doc), "status": {"name": "To Do", "statusCategory": {"key": "new"}}, "issuelinks": [blocker], "created": "2026-01-01T00:00:00.000+0000"}}
    j = providers.jira(landed(spark, schemas.JIRA, raw), "https://jira.example.com/").first()
    assert (j["description"], j["url"], j["dispatchable"], len(j["blocked_by"])) == ("First line\nSecond line", "https://jira.example.com/browse/P%201", False, 1)
    assert j["created_at"] is not None
    task = {"gid": "1", "name": "n", "completed": False, "memberships": [{"project": {"gid": "other"}, "section": {"gid": "0", "name": "No"}}, {"project": {"gid": "p"}, "section": {"gid": "s", "name": "Todo"}}]}
    a = providers.asana(landed(spark, schemas.ASANA, task, task | {"gid": "2", "resource_subtype": "section"}), "p").orderBy("id").collect()
    assert [(r["state"], r["dispatchable"]) for r in a] == [("Todo", True), ("Todo", False)]


def test_paged_source(spark):
    tracker.register(spark)
    read = lambda name: spark.read.format("tracker").options(client=f"tests.paged_client:{name}", scopes="x,y").load()
    assert read("Client").count() == 7
    assert sorted(json.loads(r["record"])["id"] for r in read("Client").where("state = 'open'").collect()) == ["1", "3", "5"]
    assert read("Counted").where(F.col("state").isin("closed")).count() == 4
    with pytest.raises(PySparkException):
        read("Broken").count()
    assert tracker.memory(spark, [{"id": "1"}, "junk", None], "id string").count() == 1


def test_event_lines(spark):
    lines = spark.createDataFrame([('{"method":"turn/completed","usage":{"total_tokens":5}}',), ("hello",), ("{broken",)], "value string")
    got = {r["event"]: r for r in events.runtime_events(lines, now=F.lit(datetime(2026, 1, 1))).collect()}
    assert set(got) == {"turn_completed", "malformed"} and got["malformed"]["raw"] == "{broken" and "5" in got["turn_completed"]["usage"]
    shell = spark.createDataFrame([("M\tdir\t/a b",), ("noise",)], "value string")
    assert [tuple(r) for r in events.marker_rows(shell, "M").collect()] == [("dir", "/a b")]
    assert [r[0] for r in events.number_lines(spark.createDataFrame([("12",), ("x",)], "value string")).collect()] == [12]


def test_workflow_file(tmp_path):
    file = tmp_path / "w.md"
    file.write_text("---\nmax_concurrent_agents: 3\nactive_states: [Todo]\nassignee: $WHO\ntoken: $NONE\n---\nHello {{ issue.title }}\n")
    c, body = config.parse(file.read_text(), {"WHO": "me"})
    assert (c.max_concurrent_agents, c.active_states, c.assignee, body) == (3, ("Todo",), "me", "Hello {{ issue.title }}")
    assert config.rendered(body, {"issue": {"title": "x"}}) == "Hello x"
    with pytest.raises(config.ConfigError):
        config.rendered(body, {"issue": {}})
    store = config.Store(str(file))
    file.write_text("---\nmax_concurrent_agents: -1\n---\n")
    assert store.current()[0].max_concurrent_agents == 3 and isinstance(store.error, config.ConfigError)
    file.write_text("---\nmax_concurrent_agents: 7\n---\n")
    assert store.current()[0].max_concurrent_agents == 7 and store.error is None


def test_run_stream(spark, tmp_path):
    from tallyloom.streaming.runs import Refresh, run_states

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    at = lambda s: datetime.fromtimestamp(1_700_000_000 + s, timezone.utc).isoformat()
    use = lambda n: json.dumps({"params": {"tokenUsage": {"total": {"total_tokens": n}}}})
    batches = [
        [("a", "session_started", at(0), "s1", use(5)), ("b", "notification", at(1), None, use(9)), (None, "x", at(1), None, None)],
        [("a", "notification", at(5), None, use(3)), ("b", "run_failed", at(6), None, None)],
        [("c", "notification", at(900), None, None)],
        [("c", "notification", at(901), None, None)],
    ]
    (tmp_path / "in").mkdir()
    schema = "issue_id string, event string, ts timestamp, session_id string, payload string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    rows = []
    q = run_states(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(lambda d, _: rows.extend(d.collect())).start()
    try:
        for i, b in enumerate(batches):
            part = tmp_path / f"{i}.json"
            part.write_text("\n".join(json.dumps(dict(zip(("issue_id", "event", "ts", "session_id", "payload"), r, strict=True))) for r in b))
            part.rename(tmp_path / "in" / part.name)
            q.processAllAvailable()
    finally:
        q.stop()
    kinds = {(r["issue_id"], r["kind"]): r for r in rows}
    assert kinds["a", "running"]["total_tokens"] == 5 and kinds["a", "running"]["turn_count"] == 1
    assert kinds["b", "retry"]["due_ms"] == 1_700_000_016_000 and ("b", "retry_due") in kinds
    assert kinds["a", "stalled"]["at_ms"] == 1_700_000_305_000
    r = Refresh()
    assert [r.request()["coalesced"], r.request()["coalesced"], r.take(), r.take()] == [False, True, True, False]
