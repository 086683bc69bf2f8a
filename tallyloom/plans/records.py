"""Registered queries over tracker records, protocol lines, state tables and the smaller expressions, with their SQL.

Records of each tracker are built as JSON from stand-in tables and read with the
tracker's schema, as landed responses are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import events as ev
from ..functions import text as tx
from ..operators import accounting, dispatch, reconcile, status, throughput
from ..sources import events as lines
from ..sources import providers
from .queries import _t, query


def _landed(df: DataFrame, record, schema: str) -> DataFrame:
    """Rows of JSON text, read with the schema of a tracker's records."""
    return df.select(F.from_json(F.to_json(record), schema).alias("r")).select("r.*")


def _named(**columns) -> F.Column:
    return F.struct(*(c.alias(n) for n, c in columns.items()))


def _text(c) -> F.Column:
    return F.col(c).cast("string")


def _iso(c: str) -> F.Column:
    return F.concat(F.date_format(c, "yyyy-MM-dd"), F.lit("T08:30:00.000+0000"))


def _linear(spark, d) -> DataFrame:
    links = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.collect_list(_named(type=F.lit(" Blocks"), issue=_named(id=_text("l_partkey"), identifier=F.concat(F.lit("P-"), _text("l_partkey")), state=_named(name=F.col("l_linestatus"))))).alias("links")
    )
    o = _t(spark, d, "orders").join(links, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    state = F.when(F.col("o_orderstatus") == "O", " Todo ").otherwise(F.col("o_orderstatus"))
    return _landed(o, _named(
        id=_text("o_orderkey"), identifier=F.concat(F.lit("O-"), _text("o_orderkey")), title=F.col("o_orderpriority"), priority=F.substring("o_orderpriority", 1, 1).cast("long"), state=_named(name=state),
        assignee=_named(id=_text("o_custkey")), labels=_named(nodes=F.array(_named(name=F.upper("o_orderpriority")), _named(name=F.lit(" ")))), inverseRelations=_named(nodes=F.col("links")), createdAt=_iso("o_orderdate"),
    ), schemas.LINEAR)


@query("""SELECT o_orderkey::VARCHAR AS id, 'O-' || o_orderkey AS identifier, substr(o_orderpriority, 1, 1)::BIGINT AS priority, CASE WHEN o_orderstatus = 'O' THEN ' Todo ' ELSE o_orderstatus END AS state,
 o_custkey::VARCHAR AS assignee_id, lower(o_orderpriority) AS labels, NOT (o_orderstatus = 'O' AND coalesce(open, false)) AS dispatchable, coalesce(n, 0)::INT AS n_blockers, epoch(o_orderdate)::BIGINT + 30600 AS created
 FROM orders LEFT JOIN (SELECT l_orderkey, bool_or(l_linestatus <> 'F') AS open, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def linear_items(spark, d):
    """A to-do item with an open blocker isn't dispatchable."""
    i = providers.linear(_linear(spark, d), terminal=["f"])
    return i.select("id", "identifier", "priority", "state", "assignee_id", F.array_join("labels", "|").alias("labels"), "dispatchable", F.size("blocked_by").alias("n_blockers"), F.unix_timestamp("created_at").alias("created"))


@query("SELECT o_orderkey::VARCHAR AS id FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority <> '3-MEDIUM'")
def scanned_items(spark, d):
    """A scan of one state; records without a title are malformed, and dropped."""
    i = providers.linear(_linear(spark, d)).withColumn("title", F.when(F.col("title") != "3-MEDIUM", F.col("title")))
    return providers.scan(i, [" p ", "P"]).select("id")


@query("""WITH a AS (SELECT l_orderkey::VARCHAR AS id, min(l_suppkey) AS pos FROM lineitem GROUP BY 1) SELECT id, pos FROM a""")
def looked_up_items(spark, d):
    """A strict lookup of the ids that lines name, in the order of their least supplier."""
    asked = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("pos"), F.concat(F.lit(" "), _text("l_orderkey")).alias("id"))
    return providers.lookup(providers.linear(_linear(spark, d)), asked).select("id", "pos")


@query("""SELECT c_custkey::VARCHAR AS id, 'GH-' || c_custkey AS identifier, c_name AS title, CASE WHEN c_acctbal < 0 THEN 'closed' ELSE 'open' END AS state, c_nationkey::VARCHAR AS assignee_id, lower(c_mktsegment) AS labels,
 c_acctbal <= 5000 AND c_nationkey = 7 AS dispatchable, 'https://git.example.com/i/' || c_custkey AS url FROM customer""")
def github_items(spark, d):
    """Pull requests, and items of others, aren't dispatchable."""
    c = _t(spark, d, "customer")
    raw = _landed(c, _named(
        number=F.col("c_custkey"), id=F.col("c_custkey") + 1000, title=F.col("c_name"), state=F.when(F.col("c_acctbal") < 0, "closed").otherwise("open"), html_url=F.concat(F.lit("https://git.example.com/i/"), _text("c_custkey")),
        assignee=_named(login=_text("c_nationkey")), labels=F.array(_named(name=F.col("c_mktsegment")), _named(name=F.lower("c_mktsegment"))), pull_request=F.when(F.col("c_acctbal") > 5000, _named(url=F.lit("u"))),
    ), schemas.GITHUB)
    return providers.github(raw, "7").select("id", "identifier", "title", "state", "assignee_id", F.array_join("labels", "|").alias("labels"), "dispatchable", "url")


@query("""SELECT s_suppkey::VARCHAR AS id, 'GL-' || s_suppkey AS identifier, CASE WHEN s_acctbal < 2000 THEN 'user' || s_nationkey WHEN s_acctbal < 5000 THEN s_nationkey::VARCHAR END AS assignee_id,
 coalesce(CASE WHEN s_acctbal < 2000 THEN 'user' || s_nationkey WHEN s_acctbal < 5000 THEN s_nationkey::VARCHAR END = 'user3', false) AS dispatchable, s_suppkey + 5 AS native_id FROM supplier""")
def gitlab_items(spark, d):
    """The first of several assignees counts, else the single one, by name, else by number."""
    s = _t(spark, d, "supplier")
    first = F.when(F.col("s_acctbal") < 2000, F.array(_named(id=F.col("s_nationkey"), username=F.concat(F.lit("user"), _text("s_nationkey")))))
    single = F.when(F.col("s_acctbal").between(2000, 4999.99), _named(id=F.col("s_nationkey")))
    raw = _landed(s, _named(iid=F.col("s_suppkey"), id=F.col("s_suppkey") + 5, title=F.col("s_name"), state=F.lit("opened"), assignees=first, assignee=single), schemas.GITLAB)
    return providers.gitlab(raw, " user3").select("id", "identifier", "assignee_id", "dispatchable", F.element_at("native_ref", "id").cast("long").alias("native_id"))


@query("""SELECT p_partkey::VARCHAR AS id, 'P ' || p_partkey AS identifier, p_name || chr(10) || p_type AS description, p_brand AS state, NOT (p_size < 20 AND p_retailprice > 1200) AS dispatchable,
 'https://jira.example.com/browse/P%20' || p_partkey AS url FROM part""")
def jira_items(spark, d):
    """Rich text as plain text; a new item waits for its open blockers."""
    p = _t(spark, d, "part")
    para = lambda c: _named(type=F.lit("paragraph"), content=F.array(_named(type=F.lit("text"), text=F.col(c))))
    body = F.to_json(_named(type=F.lit("doc"), content=F.array(para("p_name"), para("p_type"))))
    done = F.when(F.col("p_retailprice") > 1200, "To Do").otherwise("Done")
    link = _named(type=_named(name=F.lit("Blocks")), inwardIssue=_named(id=F.lit("9"), key=F.lit("P-9"), fields=_named(status=_named(name=done))))
    category = F.when(F.col("p_size") < 20, "new").otherwise("indeterminate")
    raw = _landed(p, _named(id=_text("p_partkey"), key=F.concat(F.lit("P "), _text("p_partkey")), fields=_named(
        summary=F.col("p_name"), description=body, status=_named(name=F.col("p_brand"), statusCategory=_named(key=category)), issuelinks=F.array(link))), schemas.JIRA)
    return providers.jira(raw, "https://jira.example.com/").select("id", "identifier", "description", "state", "dispatchable", "url")


@query("""SELECT p_partkey::VARCHAR AS id, 'ASANA-' || p_partkey AS identifier, p_type AS state, p_size < 25 AND p_brand <> 'Brand#11' AS dispatchable FROM part""")
def asana_items(spark, d):
    """The section of the project's own membership is the state; done tasks and sections aren't dispatchable."""
    p = _t(spark, d, "part")
    member = lambda project, c: _named(project=_named(gid=F.lit(project)), section=_named(gid=F.lit("s"), name=c))
    kind = F.when(F.col("p_brand") == "Brand#11", "section").otherwise("default_task")
    raw = _landed(p, _named(gid=_text("p_partkey"), name=F.col("p_name"), completed=F.col("p_size") >= 25, resource_subtype=kind, memberships=F.array(member("x", F.lit("No")), member("p", F.col("p_type")))), schemas.ASANA)
    return providers.asana(raw, "p").select("id", "identifier", "state", "dispatchable")


def _lines(spark, d) -> DataFrame:
    """A protocol line for every event."""
    e = _t(spark, d, "events")
    method = F.when(F.col("event_type") == "error", "turn/failed").when(F.col("event_type") == "click", "turn/completed").otherwise(F.col("event_type"))
    message = F.to_json(_named(method=method, usage=_named(total_tokens=F.col("event_id")), params=_named(error=_named(message=F.concat(F.lit("at "), _text("user_id"))), turn=_named(status=F.lit("done")))))
    broken = F.concat(F.lit("{"), _text("event_id"))
    line = F.when(F.col("event_type") == "view", broken).when(F.col("value") < 2, F.lit("plain text")).otherwise(message)
    return e.select("event_id", "event_type", line.alias("value"))


_KIND = "CASE WHEN event_type = 'view' THEN 'malformed' WHEN value < 2 THEN 'log' WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'click' THEN 'completed' ELSE 'notification' END"


@query(f"SELECT event_id, {_KIND} AS kind FROM events")
def routed_lines(spark, d):
    return _lines(spark, d).select("event_id", ev.route(F.col("value")).alias("kind"))


@query(f"""WITH k AS (SELECT *, {_KIND} AS kind FROM events) SELECT event_id, CASE kind WHEN 'failed' THEN 'turn_failed' WHEN 'completed' THEN 'turn_completed' ELSE kind END AS event,
 CASE WHEN kind = 'completed' THEN event_id ELSE 0 END AS tokens, CASE WHEN kind = 'malformed' THEN '{{' || event_id END AS raw FROM k WHERE kind <> 'log'""")
def line_envelopes(spark, d):
    """Events of all lines but the plain ones."""
    e = lines.runtime_events(_lines(spark, d), now=F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return e.select("event_id", "event", F.coalesce(ev.counter(F.col("usage"), ev.TOTAL_NAMES), F.lit(0)).alias("tokens"), "raw")


@query(f"""WITH k AS (SELECT *, {_KIND} AS kind FROM events) SELECT event_id, CASE kind WHEN 'failed' THEN 'turn failed: at ' || user_id WHEN 'completed' THEN 'turn completed (done) (total ' || format('{{:,}}', event_id) || ')' ELSE event_type END AS sentence
 FROM k WHERE kind NOT IN ('log', 'malformed')""")
def event_sentences(spark, d):
    """A sentence for every message."""
    m = _lines(spark, d).where(~ev.route(F.col("value")).isin("log", "malformed"))
    return m.select("event_id", ev.event_sentence(F.lit("notification"), F.col("value")).alias("sentence"))


@query("""SELECT event_id, event_type = 'error' OR value > 90 OR user_id > 100 AS waits FROM events""")
def operator_waits(spark, d):
    """Events that wait for an operator: by their name, their method or their outcome."""
    e = _t(spark, d, "events")
    event = F.when(F.col("event_type") == "error", "approval_required").otherwise("notification")
    method = F.when(F.col("value") > 90, ev.INPUT_METHODS[-1]).otherwise("x")
    outcome = F.when(F.col("user_id") > 100, F.element_at(F.lit(list(ev.OPERATOR_OUTCOMES)), (F.col("user_id") % 3 + 1).cast("int"))).otherwise("done")
    return e.select("event_id", ev.needs_operator(event, F.to_json(_named(method=method, outcome=outcome))).alias("waits"))


@query("SELECT p_type AS worker_host, count(*) AS running FROM part GROUP BY 1")
def host_counts(spark, d):
    return dispatch.running_by_host(_t(spark, d, "part"), "p_type")


@query("SELECT o_orderkey, c_name AS issue_id FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey")
def issues_by_reference(spark, d):
    """Reverse lookup; references to nothing that runs have no issue."""
    run = _t(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("ref"), F.col("c_name").alias("issue_id"))
    return reconcile.by_reference(run, _t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("ref"))).select("o_orderkey", "issue_id")


@query("SELECT l_partkey AS id, max(l_suppkey) AS page FROM lineitem GROUP BY 1")
def latest_pages(spark, d):
    """Where pages overlap, the last one's row stays."""
    l = _t(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("page"))
    return reconcile.latest_page_row(l)


@query("SELECT DISTINCT o_custkey FROM (SELECT o_custkey FROM orders WHERE o_orderstatus IN ('O', 'P')) WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def claim_sets(spark, d):
    """Claims after a round: new ones in, completed ones out."""
    by = lambda s: _t(spark, d, "orders").where(F.col("o_orderstatus") == s).select("o_custkey")
    return reconcile.claims_after(by("O"), by("P"), by("F"))


@query("""SELECT page_id, url_encode(url) AS segment, '"' || replace(replace(url, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"' AS quoted,
 CASE WHEN length(url) > 10 THEN substr(url, 1, 4) || '...' || right(url, 6) ELSE url END AS compact, substr(url, 1, 12) AS short FROM pages""")
def url_forms(spark, d):
    """URLs as path segments, query texts and short ids."""
    u = F.col("url")
    return _t(spark, d, "pages").select("page_id", tx.path_segment(u).alias("segment"), tx.jql_quoted(u).alias("quoted"), tx.compact_id(u).alias("compact"), tx.short_id(u).alias("short"))


@query("""SELECT event_id, printf('%d.%03ds', ms // 1000, ms % 1000) AS left_ms, ceil(ms / 1000)::BIGINT || 's' AS left_s, ts + to_seconds(ms // 1000) AS due_at, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso,
 CASE WHEN user_id > 0 THEN printf('%dm %ds', event_id // 60, event_id % 60) || ' / ' || user_id ELSE printf('%dm %ds', event_id // 60, event_id % 60) END AS duration,
 least(10000 * (1::BIGINT << least(greatest(user_id % 9 - 1, 0), 10)::INT), 300000)::BIGINT AS delay, format('{:,}', floor(value)::BIGINT) AS rate, floor(value * 10)::BIGINT AS lenient
 FROM (SELECT *, event_id * 37 AS ms FROM events)""")
def time_forms(spark, d):
    """Countdowns, due times, durations and delays of every event."""
    ms = F.col("event_id") * 37
    return _t(spark, d, "events").select(
        "event_id", tx.countdown(ms).alias("left_ms"), tx.countdown_seconds(ms).alias("left_s"), tx.due_at(F.col("ts"), ms).alias("due_at"), tx.iso_seconds(F.col("ts")).alias("iso"),
        tx.duration_with_turns(F.col("event_id"), F.col("user_id")).alias("duration"), tx.backoff_ms(F.col("user_id") % 9).alias("delay"), tx.rate_text(F.col("value")).alias("rate"),
        tx.lenient_integer(F.concat(F.lit(" "), F.floor(F.col("value") * 10).cast("string"), F.lit("abc"))).alias("lenient"),
    )


@query("""SELECT doc_id, CASE WHEN regexp_matches(t, '(?i)\\b(error|warn|warning|failed|fatal|panic|exception)\\b') THEN 'warning' ELSE 'debug' END AS severity,
 CASE WHEN octet_length(encode(s)) > 96 THEN left_grapheme(s, 96) || '...' ELSE s END AS error FROM (SELECT doc_id, t, trim(regexp_replace(t, '[\\s\\x0B]+', ' ', 'g')) AS s FROM (SELECT doc_id, CASE WHEN lang = 'en' THEN 'Failed: ' ELSE 'unfailed ' END || text AS t FROM documents))""")
def log_lines(spark, d):
    """Severity of texts as log lines, and the texts as one-line errors."""
    t = F.concat(F.when(F.col("lang") == "en", "Failed: ").otherwise("unfailed "), F.col("text"))
    return _t(spark, d, "documents").select("doc_id", tx.log_severity(t).alias("severity"), tx.error_line(t).alias("error"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'P' THEN 'warning' ELSE 'danger' END AS badge, CASE WHEN o_orderstatus <> 'F' THEN 'x ' || o_orderkey END AS kept FROM orders")
def state_badges(spark, d):
    o = _t(spark, d, "orders")
    state = F.when(F.col("o_orderstatus") == "O", "In Progress").when(F.col("o_orderstatus") == "P", "Queued").otherwise("Failed twice")
    blank = F.when(F.col("o_orderstatus") != "F", F.concat(F.lit(" x "), _text("o_orderkey"))).otherwise("\t ")
    return o.select("o_orderkey", tx.state_badge(state).alias("badge"), tx.blank_to_null(blank).alias("kept"))


def _seats(spark, d):
    """Suppliers as running, retrying and blocked items, by nation."""
    s = _t(spark, d, "supplier").select(
        _text("s_suppkey").alias("issue_id"), F.col("s_name").alias("identifier"), F.lit("https://t.example.com/i").alias("issue_url"), F.lit("Todo").alias("state"), F.concat(F.lit("h"), _text("s_nationkey")).alias("worker_host"),
        F.lit(None).cast("string").alias("workspace_path"), F.lit(None).cast("string").alias("session_id"), F.col("s_suppkey").alias("n"), "s_nationkey",
    )
    at = F.lit("2024-01-25 00:00:00").cast("timestamp")
    run = s.where("s_nationkey < 10").withColumns({"pid": F.lit("7"), "input_tokens": F.col("n"), "output_tokens": F.col("n") * 2, "total_tokens": F.col("n") * 3, "turn_count": F.lit(2), "started_at": at, "last_ts": at, "last_event": F.lit("turn_cancelled"), "last_message": F.lit(None).cast("string")})
    again = s.where("s_nationkey BETWEEN 10 AND 17").withColumns({"attempt": F.lit(2), "due_at_ms": F.lit(1_706_140_800_000) + F.col("n") * 1000, "error": F.lit("boom\nagain")})
    return run, again, s.where("s_nationkey > 17").withColumns({"error": F.lit("asks"), "blocked_at": at, "last_ts": at})


_RUN = """'{"issue_id":"' || s_suppkey || '","issue_identifier":"' || s_name || '","issue_url":"https://t.example.com/i","state":"Todo","worker_host":"h' || s_nationkey || '","turn_count":2,"last_event":"turn_cancelled","last_message":"turn cancelled","started_at":"2024-01-25T00:00:00Z","last_event_at":"2024-01-25T00:00:00Z","tokens":{"input_tokens":' || s_suppkey || ',"output_tokens":' || s_suppkey * 2 || ',"total_tokens":' || s_suppkey * 3 || '}}'"""
_RETRY = """'{"issue_id":"' || s_suppkey || '","issue_identifier":"' || s_name || '","attempt":2,"due_at":"' || strftime(TIMESTAMP '2024-01-25 00:00:00' + to_seconds(s_suppkey), '%Y-%m-%dT%H:%M:%SZ') || '","error":"boom\\nagain","worker_host":"h' || s_nationkey || '"}'"""
_STUCK = """'{"issue_id":"' || s_suppkey || '","issue_identifier":"' || s_name || '","state":"Todo","error":"asks","worker_host":"h' || s_nationkey || '","blocked_at":"2024-01-25T00:00:00Z"}'"""


@query(f"""SELECT '{{"generated_at":"2024-01-25T00:00:00Z","running":[' || coalesce(string_agg({_RUN}, ',' ORDER BY s_name) FILTER (WHERE s_nationkey < 10), '')
 || '],"retrying":[' || coalesce(string_agg({_RETRY}, ',' ORDER BY s_suppkey) FILTER (WHERE s_nationkey BETWEEN 10 AND 17), '')
 || '],"blocked":[' || coalesce(string_agg({_STUCK}, ',' ORDER BY s_name) FILTER (WHERE s_nationkey > 17), '')
 || '],"totals":{{"total_tokens":' || sum(s_suppkey * 3) FILTER (WHERE s_nationkey < 10) || '}}}}' AS document, count(*) FILTER (WHERE s_nationkey < 10) AS n_running FROM supplier""")
def state_document(spark, d):
    """The whole state, of all suppliers as items, as one JSON text; its counts, whose order is open, apart."""
    run, again, stuck = _seats(spark, d)
    totals = run.agg(F.sum("total_tokens").alias("total_tokens"))
    doc = status.state_document(run, again, stuck, totals, F.lit("2024-01-25 00:00:00").cast("timestamp"), 1_706_140_800_000)
    n = F.get_json_object("document", "$.counts.running").cast("long")
    return doc.select(F.regexp_replace("document", '"counts":\\{[^}]*\\},', "").alias("document"), n.alias("n_running"))


@query("""SELECT s_name AS identifier, rpad(CASE WHEN length(s_name) > 8 THEN substr(s_name, 1, 5) || '...' ELSE s_name END, 8, ' ') || ' Todo           7        0m 0s / 2    ' || lpad(format('{:,}', s_suppkey * 3), 10, ' ') || '                turn cancelled' AS line
 FROM supplier WHERE s_nationkey < 10 UNION ALL SELECT s_name, s_name || ' attempt=2 in ' || s_suppkey || '.000s error=boom again' FROM supplier WHERE s_nationkey BETWEEN 10 AND 17""")
def dashboard_lines(spark, d):
    """Text rows of running and retrying items."""
    run, again, _ = _seats(spark, d)
    run = status.running_lines(run.withColumn("session_id", F.lit("")), F.lit("2024-01-25 00:00:00").cast("timestamp"))
    again = status.retry_lines(again.withColumn("due_in_ms", F.col("due_at_ms") - 1_706_140_800_000))
    return run.unionByName(again.select("identifier", "line"))


@query("""SELECT event_id, 'u' || user_id || ' | primary ' || format('{:,}', event_id) || '/20,000 reset 30s | ' || CASE WHEN event_type = 'error' THEN 'credits unlimited' ELSE 'credits ' || printf('%.2f', user_id * 0.5) END AS limits FROM events""")
def limit_texts(spark, d):
    e = _t(spark, d, "events")
    credits = F.when(F.col("event_type") == "error", '{"unlimited":true}').otherwise(F.concat(F.lit('{"balance":'), (F.col("user_id") * 0.5).cast("string"), F.lit("}")))
    bucket = F.to_json(_named(remaining=F.col("event_id"), limit=F.lit(20000), resetInSeconds=F.lit("30s")))
    limits = F.concat(F.lit('{"limit_name":"u'), _text("user_id"), F.lit('","primary":'), bucket, F.lit(',"credits":'), credits, F.lit("}"))
    return e.select("event_id", ev.rate_limits_text(limits).alias("limits"))


@query("""SELECT user_id AS series, sum(n)::BIGINT AS kept FROM (SELECT user_id, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1) GROUP BY 1""")
def pruned_samples(spark, d):
    """Samples that a window still holds, by series."""
    e = _t(spark, d, "events").select(F.col("user_id").alias("series"), F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), "ts").alias("ts_ms"))
    now = 1_706_140_800_000  # 2024-01-25
    return throughput.pruned(e, now, 5 * 86_400_000).groupBy("series").agg(F.count("*").alias("kept"))


@query("SELECT (date_sub('second', min(ts), TIMESTAMP '2024-02-01 00:00:00') + (SELECT sum(date_sub('second', a, b)) FROM (SELECT min(ts) AS a, max(ts) AS b FROM events GROUP BY user_id)))::BIGINT AS seconds_running FROM events")
def live_seconds(spark, d):
    """Seconds of ended runs, and of one that still runs."""
    e = _t(spark, d, "events")
    ended = e.groupBy("user_id").agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"))
    return accounting.run_seconds(ended, e.agg(F.min("ts").alias("started_at")), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'dir' ELSE 'file' END AS kind, '/w/' || c_name AS path FROM customer WHERE c_nationkey < 20""")
def shell_markers(spark, d):
    """Marked rows of shell output; other lines are noise."""
    c = _t(spark, d, "customer")
    line = F.concat_ws("\t", F.when(F.col("c_nationkey") < 20, "MARK").otherwise("note"), F.when(F.col("c_acctbal") < 0, "dir").otherwise("file"), F.concat(F.lit("/w/"), "c_name"))
    return lines.marker_rows(c.select(line.alias("value"), "c_custkey", "c_name"), "MARK").join(c.select("c_custkey", F.concat(F.lit("/w/"), "c_name").alias("path")), "path").select("c_custkey", "kind", "path")


def _last(spark, d) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return _t(spark, d, "events").withColumn("_n", F.row_number().over(w)).where("_n = 1")


@query("SELECT user_id, event_type AS event, coalesce(props, 'none') AS message FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def last_messages(spark, d):
    m = ev.last_message(F.col("event_type"), F.col("props"), F.lit("none"), F.col("ts"))
    return _last(spark, d).select("user_id", m.alias("m")).select("user_id", "m.event", "m.message")
