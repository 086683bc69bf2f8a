"""Golden values of text, time and event expressions."""

import json

from pyspark.sql import functions as F

from tallyloom.functions import events as ev
from tallyloom.functions import text as tx


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def _cases():
    return [
        (tx.key_of(F.lit("  In Progress\t")), "in progress"),
        (tx.clean_labels(F.array(F.lit(" Bug "), F.lit("bug"), F.lit("Platform"), F.lit(" "), F.lit(None))), ["bug", "platform"]),
        (tx.backoff_ms(F.lit(3)), 40_000),
        (tx.backoff_ms(F.lit(1)), 10_000),
        (tx.backoff_ms(F.lit(99)), 300_000),
        (tx.retry_delay_ms(F.lit(1), F.lit(True)), 1000),
        (tx.lenient_integer(F.lit("12abc")), 12),
        (tx.lenient_integer(F.lit("-3")), None),
        (tx.strict_integer(F.lit("12abc")), None),
        (tx.strict_integer(F.lit(" 12 ")), 12),
        (tx.grouped(F.lit(268500)), "268,500"),
        (tx.duration_with_turns(F.lit(785), F.lit(11)), "13m 5s / 11"),
        (tx.duration_words(F.lit(4321)), "72m 1s"),
        (tx.countdown(F.lit(1250)), "1.250s"),
        (tx.compact_id(F.lit("0123456789abcdef")), "0123...abcdef"),
        (tx.cell(F.lit("abcdefghij"), 8), "abcde..."),
        (tx.truncated(F.lit("abcdef"), 3), "abc..."),
        (tx.without_control(F.lit("\x1b[31mred\x1b[0m\x07!")), "red!"),
        (tx.error_line(F.lit("a\\nb\nc")), "a b c"),
        (tx.spaced_words(F.lit("commandExecution/some_part")), "command execution some part"),
        (tx.safe_key(F.lit("team_a-1")), "team_a-1"),
        (F.char_length(tx.safe_key(F.lit("team/a-1"))), len("team_a-1--") + 16),
        (tx.path_segment(F.lit("a b~c")), "a%20b~c"),
        (tx.jql_quoted(F.lit('say "x"')), '"say \\"x\\""'),
        (tx.spark_block(F.lit(7)), "█"),
        (tx.safe_link(F.lit("javascript:alert(1)")), None),
        (tx.safe_link(F.lit("https://example.com/x")), "https://example.com/x"),
        (F.date_format(tx.parse_time(F.lit("2026-01-02T03:04:05+0000")), "yyyy-MM-dd HH:mm:ss"), "2026-01-02 03:04:05"),
        (tx.parse_time(F.lit("yesterday")), None),
        (tx.log_severity(F.lit("An ERROR occurred")), "warning"),
        (tx.state_badge(F.lit("In Progress")), "active"),
    ]


def test_text(spark):
    cases = _cases()
    row = spark.range(1).select(*(c.alias(f"c{i}") for i, (c, _) in enumerate(cases))).first()
    assert list(row) == [x for _, x in cases]


SENTENCES = [
    ("turn/started", {"turn": {"id": "turn-1"}}, "turn started (turn-1)"),
    ("turn/completed", {"turn": {"status": "completed"}}, "turn completed (completed)"),
    ("turn/diff/updated", {"diff": "line1\nline2"}, "turn diff updated (2 lines)"),
    ("turn/plan/updated", {"plan": [{"step": "a"}, {"step": "b"}]}, "plan updated (2 steps)"),
    ("thread/tokenUsage/updated", {"tokenUsage": {"total": {"input_tokens": 8, "output_tokens": 3, "total_tokens": 11}}}, "thread token usage updated (in 8, out 3, total 11)"),
    ("item/started", {"item": {"id": "item-1234567890abcdef", "type": "commandExecution", "status": "running"}}, "item started: command execution (item-1234567, running)"),
    ("item/completed", {"item": {"type": "fileChange", "status": "completed"}}, "item completed: file change (completed)"),
    ("item/agentMessage/delta", {"delta": "hello"}, "agent message streaming: hello"),
    ("item/reasoning/textDelta", {"textDelta": "reason"}, "reasoning text streaming: reason"),
    ("item/commandExecution/outputDelta", {"outputDelta": "ok"}, "command output streaming: ok"),
    ("item/commandExecution/requestApproval", {"parsedCmd": "git status"}, "command approval requested (git status)"),
    ("item/commandExecution/requestApproval", {"command": ["git", "status"]}, "command approval requested (git status)"),
    ("item/fileChange/requestApproval", {"fileChangeCount": 2}, "file change approval requested (2 files)"),
    ("item/tool/call", {"tool": "some_tool"}, "dynamic tool call requested (some_tool)"),
    ("item/tool/requestUserInput", {"question": "Continue?"}, "tool requires user input: Continue?"),
    ("codex/event/task_started", {}, "task started"),
    ("something/else", {"msg": {"type": "x"}}, "something/else (x)"),
]


def test_sentences(spark):
    rows = [(i, json.dumps({"method": m, "params": p})) for i, (m, p, _) in enumerate(SENTENCES)]
    got = spark.createDataFrame(rows, "i int, payload string").select("i", ev.event_sentence(F.lit("notification"), F.col("payload")).alias("s")).collect()
    assert {r["i"]: r["s"] for r in got} == {i: s for i, (_, _, s) in enumerate(SENTENCES)}


def test_usage_precedence(spark):
    both = json.dumps({"method": "turn/completed", "usage": {"total_tokens": 3}, "params": {"tokenUsage": {"total": {"inputTokens": "200", "total_tokens": 300}}}})
    turn = json.dumps({"method": "turn/completed", "usage": {"total_tokens": 3}})
    for payload, total in ((both, 300), (turn, 3), ("{}", None), (None, None)):
        assert one(spark, ev.counter(ev.token_usage(F.lit(payload).cast("string")), ev.TOTAL_NAMES)) == total


def test_routes(spark):
    lines = {'{"method":"turn/completed"}': "completed", '{"method":"x"}': "notification", '{"id":1}': "response", "{broken": "malformed", "plain": "log"}
    got = spark.createDataFrame([(x,) for x in lines], "x string").select("x", ev.route(F.col("x")).alias("k")).collect()
    assert {r["x"]: r["k"] for r in got} == lines


def test_rate_limits(spark):
    limits = {"limit_id": "gpt", "primary": {"remaining": 10, "limit": 20, "reset_in_seconds": 30}, "credits": {"unlimited": True}}
    payload = json.dumps({"params": {"rateLimits": limits}})
    assert one(spark, ev.rate_limits_text(ev.rate_limits(F.lit(payload)))) == "gpt | primary 10/20 reset 30s | credits unlimited"

    deep = json.dumps({"a": [{"b": {"c": limits}}]})
    assert json.loads(one(spark, ev.rate_limits(F.lit(deep)))) == limits


def _evaluations(spark, column, what="get_json_object"):
    """How often the plan of a text's expression holds what."""
    plan = spark.range(1).select(F.col("id").cast("string").alias("x")).select(column(F.col("x")).alias("y"))
    return plan._jdf.queryExecution().optimizedPlan().toString().count(what)


def test_limit_texts_read_each_member_once(spark):
    """Was 156: every use of a number or a bucket took it out of the JSON text again."""
    assert _evaluations(spark, ev.rate_limits_text) <= 16


def test_limit_texts_of_odd_parts(spark):
    cases = {
        None: "unavailable", "{}": "unavailable", "[]": "unavailable",
        '{"primary":{"remaining":"-0","limit":"+8 a"}}': "primary 0/8", '{"primary":{"remaining":-3,"limit":2},"secondary":"x"}': "primary n/a | secondary n/a",
        '{"credits":{"has_credits":false,"balance":3}}': "credits none", '{"credits":{"has_credits":true}}': "credits available",
    }
    got = spark.createDataFrame([(x,) for x in cases], "x string").select("x", ev.rate_limits_text(F.col("x")).alias("t")).collect()
    assert {r["x"]: r["t"] for r in got} == cases


def test_lenient_integers(spark):
    cases = {"-0": 0, "-00x": 0, "-007": None, "+8": 8, "  5 ": 5, "- 1": None, "9223372036854775808": None, "": None}
    got = spark.createDataFrame([(x,) for x in cases], "x string").select("x", tx.lenient_integer(F.col("x")).alias("n")).collect()
    assert {r["x"]: r["n"] for r in got} == cases


def test_sentences_find_the_method_once(spark):
    """Was 50: every case of a method took it out of the JSON text again."""
    assert _evaluations(spark, lambda x: ev.event_sentence(F.lit("notification"), x), "$.method)") == 1
    assert _evaluations(spark, ev.route, "$.method)") == 1


def test_names_spelled_by_escapes(spark):
    """Texts without a name aren't parsed, those that may spell it are."""
    cases = {'{"m\\u0065thod":"x"}': "x", '{"method":"y"}': "y", '{"methods":"z"}': None, '{"a":"\\n"}': None, "method": None, "{}": None, None: None}
    got = spark.createDataFrame([(x,) for x in cases], "x string").select("x", ev.at(F.col("x"), "method").alias("m")).collect()
    assert {r["x"]: r["m"] for r in got} == cases


def test_envelopes_find_each_total_once(spark):
    """The usage of a line was taken out of it again by every counter and check."""
    from tallyloom.sources.events import runtime_events

    e = runtime_events(spark.range(1).select(F.col("id").cast("string").alias("value")), now=F.lit("now"))
    assert e.columns == ["event", "ts", "usage", "payload", "raw"]
    plan = e._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count("$.params.tokenUsage.total)"), plan.count("$.method)")] == [1, 2]


def test_stream_counters_find_each_total_once(spark):
    from tallyloom.streaming.runs import prepared

    rows = [("r", "e", None, json.dumps({"tokenUsage": {"total": {"input": 1, "outputTokens": "7x", "total": 9}}}))]
    events = spark.createDataFrame(rows, "issue_id string, event string, session_id string, payload string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    p = prepared(events)
    assert p._jdf.queryExecution().optimizedPlan().toString().count("$.params.tokenUsage.total)") == 1
    assert [p.columns, *(list(r)[4:] for r in p.collect())] == [["issue_id", "event", "ts", "session_id", "input", "output", "total"], [1, 7, 9]]
