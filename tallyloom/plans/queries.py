"""Registered queries: each operator over stand-in tables, with the same query in SQL.

orders stand in for work items (status: state, priority digit: priority, date:
creation time, key: identifier), events for run telemetry (user: run), lineitem
for links and running work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import events as ev
from ..functions import text as tx
from ..operators import accounting, dispatch, reconcile, retry, status, throughput

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _ms(ts):
    """Milliseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.floor(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts) / 1000).cast("long")


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _items(spark, d) -> DataFrame:
    o = _t(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("O-"), F.col("o_orderkey").cast("string")).alias("identifier"),
        F.col("o_orderpriority").alias("title"), F.substring("o_orderpriority", 1, 1).cast("long").alias("priority"), F.col("o_orderstatus").alias("state"),
        F.col("o_orderdate").alias("created_at"), F.lit(True).alias("dispatchable"), F.array(F.lower(F.substring("o_orderpriority", 3, 20))).alias("labels"), "o_custkey", "o_orderkey", "o_totalprice",
    )


_ITEMS = """items AS (SELECT o_orderkey::VARCHAR AS id, 'O-' || o_orderkey AS identifier, o_orderpriority AS title,
 CASE WHEN substr(o_orderpriority, 1, 1)::BIGINT BETWEEN 1 AND 4 THEN substr(o_orderpriority, 1, 1)::BIGINT ELSE 5 END AS prio,
 lower(trim(o_orderstatus)) AS state_key, o_orderdate AS created_at, o_custkey, o_orderkey, o_totalprice FROM orders)"""
_ORDER = "prio, created_at NULLS LAST, identifier, id"


@query(f"WITH {_ITEMS} SELECT id, identifier, prio::BIGINT AS priority_rank, row_number() OVER (ORDER BY {_ORDER})::BIGINT AS pos FROM items WHERE state_key = 'o'")
def dispatch_order(spark, d):
    """All open items with their place in the total order of dispatch."""
    out = dispatch.numbered(dispatch.candidates(_items(spark, d), ["O"], ["F"]))
    return out.select("id", "identifier", dispatch.priority_rank(F.col("priority")).cast("long").alias("priority_rank"), F.col("pos").cast("long").alias("pos"))


_PLAN = f"""WITH {_ITEMS}, e AS (SELECT * FROM items WHERE state_key IN ('o', 'p') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')),
r AS (SELECT *, row_number() OVER (PARTITION BY state_key ORDER BY {_ORDER}) AS state_rank FROM e),
k AS (SELECT *, row_number() OVER (ORDER BY {_ORDER}) AS dispatch_rank FROM r WHERE state_rank <= CASE state_key WHEN 'o' THEN 40 ELSE 25 END),
h AS (SELECT s_name AS worker_host, row_number() OVER (ORDER BY s_suppkey) - 1 AS host_idx FROM (SELECT * FROM supplier ORDER BY s_suppkey LIMIT 10)),
slots AS (SELECT worker_host, row_number() OVER (ORDER BY load, host_idx) AS slot FROM h, range(0, 5) t(load))"""


@query(_PLAN + " SELECT id, state_key, state_rank::BIGINT AS state_rank, dispatch_rank::BIGINT AS dispatch_rank, worker_host FROM k JOIN slots ON slot = dispatch_rank WHERE dispatch_rank <= 50")
def dispatch_plan(spark, d):
    """Quota-bounded dispatch with hosts: 40 open and 25 other items at most, 50 in all, five a host."""
    e = dispatch.candidates(_items(spark, d), ["O", "P"], ["F"])
    e = dispatch.not_claimed(e, _t(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").cast("string")))
    none = spark.createDataFrame([], "state string, worker_host string")
    limits = spark.createDataFrame([("o ", 40)], "state string, max_running long")
    room = dispatch.state_room(spark.createDataFrame([("O",), ("P",)], "state string"), limits, none, 25)
    h = _t(spark, d, "supplier").orderBy("s_suppkey").limit(10)
    h = h.select(F.col("s_name").alias("worker_host"), (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("s_suppkey")) - 1).alias("host_idx"))
    out = dispatch.dispatch_plan(e, room, 50, dispatch.dispatch_order(), dispatch.host_slots(h, none, 5, 50))
    return out.select("id", "state_key", F.col("state_rank").cast("long"), F.col("dispatch_rank").cast("long"), "worker_host")


@query("SELECT o_orderkey FROM orders WHERE lower(trim(o_orderstatus)) = 'o' AND lower(substr(o_orderpriority, 3)) = 'high'")
def routable_items(spark, d):
    """Candidates that carry a required label."""
    return dispatch.candidates(_items(spark, d), [" o ", ""], ["F"], [" HIGH "]).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def eligible_antijoin(spark, d):
    claimed = _t(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey")
    return dispatch.not_claimed(_t(spark, d, "orders"), claimed, key="o_orderkey").select("o_orderkey")


def _with_blockers(spark, d):
    links = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linestatus").alias("state"))).alias("blocked_by"))
    o = _t(spark, d, "orders").join(links, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.withColumn("blocked", dispatch.blocked_by_open(F.col("blocked_by"), ["F"]))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus <> 'F')")
def blocked_items(spark, d):
    return _with_blockers(spark, d).where("blocked").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus <> 'F')")
def unblocked_items(spark, d):
    return _with_blockers(spark, d).where("NOT blocked").select("o_orderkey")


_FRESH = "SELECT o_orderkey::VARCHAR AS id, o_orderstatus AS state, o_orderpriority <> '5-LOW' AS ok FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED'"


def _fresh(spark, d):
    o = _items(spark, d).where("title <> '4-NOT SPECIFIED'")  # these are no longer listed
    return o.withColumn("dispatchable", F.col("title") != "5-LOW")


@query(f"""SELECT o_orderkey::VARCHAR AS issue_id, f.state AS fresh_state, CASE WHEN f.id IS NULL THEN 'missing' WHEN f.state = 'F' THEN 'terminal' WHEN NOT f.ok THEN 'unroutable'
 WHEN f.state = 'O' THEN 'active' ELSE 'other' END AS action FROM orders LEFT JOIN ({_FRESH}) f ON f.id = o_orderkey::VARCHAR""")
def reconcile_actions(spark, d):
    current = _items(spark, d).select(F.col("id").alias("issue_id"))
    return reconcile.reconcile(current, _fresh(spark, d), ["O"], ["F"]).select("issue_id", "fresh_state", "action")


@query(f"""SELECT o_orderkey::VARCHAR AS id, CASE WHEN f.id IS NULL THEN 'missing' WHEN f.ok AND f.state = 'O' THEN 'ok' ELSE 'changed' END AS outcome
 FROM orders LEFT JOIN ({_FRESH}) f ON f.id = o_orderkey::VARCHAR""")
def revalidated_items(spark, d):
    planned = _items(spark, d).select("id")
    ok = F.col("dispatchable") & dispatch.in_states(F.col("state"), ["O"])
    return reconcile.revalidate(planned, _fresh(spark, d), ok).select("id", "outcome")


@query(f"""SELECT o_orderkey::VARCHAR AS issue_id, CASE WHEN f.state = 'F' THEN 'release_and_clean' WHEN f.ok AND f.state = 'O' THEN 'retry' ELSE 'release' END AS outcome
 FROM orders LEFT JOIN ({_FRESH}) f ON f.id = o_orderkey::VARCHAR""")
def retry_lookups(spark, d):
    due = _items(spark, d).select(F.col("id").alias("issue_id"))
    return reconcile.retry_outcomes(due, _fresh(spark, d), ["O"], ["F"]).select("issue_id", "outcome")


@query("""SELECT identifier, CASE WHEN a.k IS NOT NULL THEN 'running' WHEN b.k IS NOT NULL THEN 'retrying' ELSE 'blocked' END AS status,
 coalesce(a.h, b.h, c.h) AS worker_host, coalesce(c.e, b.e) AS last_error, greatest(coalesce(b.n, 0) - 1, 0)::BIGINT AS restart_count FROM
 (SELECT DISTINCT 'O-' || o_orderkey AS identifier FROM orders WHERE o_orderstatus = 'O' OR o_orderpriority < '3' OR o_orderpriority > '4')
 LEFT JOIN (SELECT 'O-' || o_orderkey AS k, 'h' || o_custkey % 7 AS h FROM orders WHERE o_orderstatus = 'O') a ON a.k = identifier
 LEFT JOIN (SELECT 'O-' || o_orderkey AS k, 'r' || o_custkey % 7 AS h, 'retry ' || o_orderstatus AS e, o_custkey % 4 AS n FROM orders WHERE o_orderpriority < '3') b ON b.k = identifier
 LEFT JOIN (SELECT 'O-' || o_orderkey AS k, 'b' || o_custkey % 7 AS h, 'blocked ' || o_orderstatus AS e FROM orders WHERE o_orderpriority > '4') c ON c.k = identifier""")
def lookup_precedence(spark, d):
    o = _items(spark, d).withColumn("issue_id", F.col("id"))
    host = lambda p: F.concat(F.lit(p), (F.col("o_custkey") % 7).cast("string"))
    run = o.where("state = 'O'").withColumn("worker_host", host("h"))
    again = o.where("title < '3'").withColumns({"worker_host": host("r"), "error": F.concat(F.lit("retry "), "state"), "attempt": F.col("o_custkey") % 4})
    stuck = o.where("title > '4'").withColumns({"worker_host": host("b"), "error": F.concat(F.lit("blocked "), "state")})
    return reconcile.by_identifier(run, again, stuck).select("identifier", "status", "worker_host", "last_error", F.col("restart_count").cast("long"))


@query("""WITH asked AS (SELECT l_orderkey, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS pos FROM lineitem)
 SELECT o_orderkey, min(pos)::BIGINT AS pos FROM orders JOIN asked ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def requested_order(spark, d):
    """Orders in the order in which lines ask for them, the first request counting."""
    l = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate", "l_linenumber")
    days = l.groupBy("l_shipdate").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("l_shipdate")) - F.col("n")  # one row a day
    own = F.row_number().over(Window.partitionBy("l_shipdate").orderBy("o_orderkey", "l_linenumber")) - 1
    asked = l.withColumn("own", own).join(F.broadcast(days.select("l_shipdate", before.alias("before"))), "l_shipdate")
    asked = asked.select("o_orderkey", (F.col("own") + F.col("before")).cast("long").alias("pos"))
    return reconcile.in_requested_order(_t(spark, d, "orders"), asked, "o_orderkey").select("o_orderkey", "pos")


@query("""SELECT s.state_key, greatest(coalesce(l.n, 10) - coalesce(r.c, 0), 0)::BIGINT AS room FROM (SELECT DISTINCT lower(o_orderstatus) AS state_key FROM orders) s
 LEFT JOIN (VALUES ('o', 5000), ('p', 3)) l(k, n) ON l.k = s.state_key LEFT JOIN (SELECT lower(o_orderstatus) AS k, count(*) AS c FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) r ON r.k = s.state_key""")
def state_limits(spark, d):
    o = _items(spark, d)
    limits = spark.createDataFrame([("O", 5000), (" p", 3)], "state string, max_running long")
    return dispatch.state_room(o, limits, o.where("title = '1-URGENT'"), 10)


@query("""SELECT 'running' AS status, count(*) FILTER (WHERE o_orderstatus = 'O') AS n FROM orders UNION ALL SELECT 'retrying', count(*) FILTER (WHERE o_orderstatus = 'P') FROM orders
 UNION ALL SELECT 'blocked', count(*) FILTER (WHERE o_orderstatus = 'none') FROM orders""")
def status_counts(spark, d):
    o = _t(spark, d, "orders")
    return status.status_counts({n: o.where(F.col("o_orderstatus") == s) for n, s in (("running", "O"), ("retrying", "P"), ("blocked", "none"))})


@query("SELECT lower(trim(o_orderstatus)) AS state_key, count(*) AS running FROM orders GROUP BY 1")
def state_counts(spark, d):
    return dispatch.running_by_state(_t(spark, d, "orders"), "o_orderstatus")


@query("SELECT greatest(20000 - count(*), 0)::BIGINT AS free FROM orders")
def free_slots(spark, d):
    return dispatch.free_slots(20_000, _t(spark, d, "orders"))


@query("""WITH l AS (SELECT s_nationkey, s_suppkey, s_name, count(l_suppkey) AS load FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL)
 SELECT s_nationkey, arg_min(s_name, load * 1000000000 + s_suppkey) AS s_name, min(load) AS load FROM l GROUP BY s_nationkey""")
def least_loaded(spark, d):
    by = _t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("load"))
    s = _t(spark, d, "supplier").join(by, F.col("s_suppkey") == F.col("l_suppkey"), "left").withColumn("load", F.coalesce("load", F.lit(0)))
    return dispatch.least_loaded(s, ["s_nationkey"], "s_name", "load", "s_suppkey")


def _events(spark, d) -> DataFrame:
    return _t(spark, d, "events").select(
        F.col("user_id").alias("issue_id"), F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("event"), F.col("props").alias("payload"), "value",
        tx.lenient_integer(F.get_json_object("props", "$.k")).alias("reported"),
    )


_EV = "e AS (SELECT *, try_cast(regexp_extract(json_extract_string(props, '$.k'), '^([+-]?[0-9]+)', 1) AS BIGINT) AS reported FROM events)"
_DELTA = f"""WITH {_EV}, w AS (SELECT *, max(reported) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
x AS (SELECT *, greatest(coalesce(reported - coalesce(before, 0), 0), 0)::BIGINT AS delta FROM w)"""


@query(_DELTA + " SELECT event_id, delta FROM x")
def counter_delta(spark, d):
    e = _events(spark, d).withColumn("at", F.struct("ts", "seq"))
    return accounting.deltas(e, "reported", order="at").select(F.col("seq").alias("event_id"), "delta")


def _usage():
    """A message that reports cumulative counters."""
    n = F.col("reported")
    counters = F.struct(n.alias("input_tokens"), (n * 2).alias("outputTokens"), (n * 3).alias("total_tokens"))
    return F.to_json(F.struct(F.struct(F.struct(counters.alias("total")).alias("tokenUsage")).alias("params")))


@query(_DELTA + """ SELECT sum(delta)::BIGINT AS input_tokens, (2 * sum(delta))::BIGINT AS output_tokens, (3 * sum(delta))::BIGINT AS total_tokens,
 (SELECT sum(date_sub('second', a, b)) FROM (SELECT min(ts) AS a, max(ts) AS b FROM events GROUP BY user_id))::BIGINT AS seconds_running FROM x""")
def counter_totals(spark, d):
    """Totals of all runs from the counters that their messages report, and their seconds."""
    e = _events(spark, d)
    ended = e.groupBy("issue_id").agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"))
    e = e.withColumn("payload", _usage()).withColumn("seq", F.struct("ts", "seq"))
    return accounting.totals(e, ended)


@query(f"WITH {_EV} SELECT event_id, coalesce(max(reported) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0)::BIGINT AS mark FROM e")
def counter_marks(spark, d):
    e = _events(spark, d).withColumn("at", F.struct("ts", "seq"))
    return accounting.marks(e, "reported", order="at").select(F.col("seq").alias("event_id"), "mark")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_event, max(ts) AS last_ts, arg_max(event_type, (ts, event_id)) FILTER (WHERE event_type = 'error') AS session_id FROM events GROUP BY user_id")
def latest_event(spark, d):
    e = _events(spark, d).withColumns({"at": F.struct("ts", "seq"), "session_id": F.when(F.col("event") == "error", F.col("event")), "pid": F.lit(None).cast("string")})
    return accounting.latest(e, order="at").select(F.col("issue_id").alias("user_id"), "last_event", "last_ts", "session_id")


@query("SELECT arg_max(event_id, (ts, event_id))::BIGINT AS remaining, arg_max(user_id, (ts, event_id))::VARCHAR AS limit_id FROM events WHERE event_type IN ('error', 'click')")
def latest_payload(spark, d):
    """The last rate limits that any message holds, however deep; other messages name none, or no bucket."""
    e = _events(spark, d)
    limits = F.struct(F.col("issue_id").cast("string").alias("limit_id"), F.struct(F.col("seq").alias("remaining")).alias("primary"))
    flat, bare = F.to_json(F.struct(F.struct(limits.alias("rateLimits")).alias("params"))), F.to_json(F.struct(F.col("event").alias("limit_id")))
    nested = F.to_json(F.struct(F.array(F.struct(F.struct(limits.alias("b")).alias("a"))).alias("list")))
    e = e.withColumn("payload", F.when(F.col("event") == "error", nested).when(F.col("event") == "click", flat).otherwise(bare)).withColumn("seq", F.struct("ts", "seq"))
    got = accounting.latest_rate_limits(e)
    return got.select(F.get_json_object("rate_limits", "$.primary.remaining").cast("long").alias("remaining"), F.get_json_object("rate_limits", "$.limit_id").alias("limit_id"))


@query("""WITH w AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
 SELECT user_id, count(*) FILTER (WHERE event_type IS DISTINCT FROM before)::BIGINT AS turn_count FROM w GROUP BY user_id""")
def session_changes(spark, d):
    e = _events(spark, d).withColumns({"at": F.struct("ts", "seq"), "session_id": F.col("event"), "event": F.lit("session_started")})
    return accounting.session_count(e, order="at").select(F.col("issue_id").alias("user_id"), "turn_count")


@query("SELECT sum(date_sub('second', a, b))::BIGINT AS seconds_running FROM (SELECT min(ts) AS a, max(ts) AS b FROM events GROUP BY user_id)")
def run_seconds(spark, d):
    return accounting.run_seconds(_t(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at")))


def _samples(spark, d) -> DataFrame:
    e = _t(spark, d, "events").select(F.col("user_id").alias("series"), _ms(F.col("ts")).alias("ts_ms"), "event_id", "ts")
    w = Window.partitionBy("series").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return e.withColumn("total", F.count("*").over(w) % 40)  # a counter that falls back now and then


_SAMPLES = "s AS (SELECT user_id AS series, epoch_us(ts) // 1000 AS ts_ms, event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) % 40 AS total FROM events)"


@query(f"""WITH {_SAMPLES}, w AS (SELECT *, first_value(ts_ms) OVER v AS a, first_value(total) OVER v AS b FROM s WINDOW v AS (PARTITION BY series ORDER BY ts_ms RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW))
 SELECT event_id, round(CASE WHEN ts_ms > a THEN greatest(total - b, 0) / ((ts_ms - a) / 1000) ELSE 0 END, 9) AS rate FROM w""")
def rolling_rate(spark, d):
    return throughput.rolling_rate(_samples(spark, d), 3_600_000).select("event_id", F.round("rate", 9).alias("rate"))


_NOW = 1_706_140_800_000  # 2024-01-25
_DAY = 86_400_000
_BUCKETS = f"""WITH {_SAMPLES}, p AS (SELECT * FROM s WHERE ts_ms >= {_NOW - _DAY}),
r AS (SELECT series, ts_ms, CASE WHEN ts_ms > lag(ts_ms) OVER v THEN greatest(total - lag(total) OVER v, 0) / ((ts_ms - lag(ts_ms) OVER v) / 1000) WHEN lag(ts_ms) OVER v IS NOT NULL THEN 0.0 END AS rate
 FROM p WINDOW v AS (PARTITION BY series ORDER BY ts_ms, total)),
m AS (SELECT series, ((ts_ms - {_NOW - 23 * (_DAY // 24)}) // {_DAY // 24})::INT AS bucket, avg(rate) AS rate FROM r WHERE rate IS NOT NULL AND ts_ms >= {_NOW - 23 * (_DAY // 24)} AND ts_ms < {_NOW + _DAY // 24} GROUP BY 1, 2),
g AS (SELECT series, b::INT AS bucket FROM (SELECT DISTINCT series FROM s), range(0, 24) t(b)),
f AS (SELECT g.series, g.bucket, coalesce(rate, 0.0) AS rate FROM g LEFT JOIN m ON m.series = g.series AND m.bucket = g.bucket)"""


@query(_BUCKETS + " SELECT series, bucket, round(rate, 12) AS rate FROM f")
def bucket_rate(spark, d):
    return throughput.bucket_rates(_samples(spark, d).drop("event_id"), _NOW, _DAY).select("series", "bucket", F.round("rate", 12).alias("rate"))


@query(_BUCKETS + " SELECT series, bucket, (CASE WHEN max(rate) OVER (PARTITION BY series) > 0 THEN round(rate / max(rate) OVER (PARTITION BY series) * 7) ELSE 0 END)::INT AS level FROM f")
def bucket_level(spark, d):
    return throughput.levels(throughput.bucket_rates(_samples(spark, d).drop("event_id"), _NOW, _DAY)).select("series", "bucket", "level")


@query(f"WITH {_SAMPLES} SELECT series, ts_ms, total FROM s QUALIFY row_number() OVER (PARTITION BY series, ts_ms // 3600000 ORDER BY ts_ms, total) = 1")
def throttled_sample(spark, d):
    return throughput.once_a_second(_samples(spark, d), every_ms=3_600_000).select("series", "ts_ms", "total")


_ATTEMPTS = """WITH a AS (SELECT *, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events),
f AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS attempt FROM a WHERE event_type = 'error'),
q AS (SELECT *, least(10000 * (1::BIGINT << least(attempt - 1, 10)::INT), 300000)::BIGINT AS delay_ms FROM f)"""


@query(_ATTEMPTS + " SELECT event_id, attempt, delay_ms, ts + to_seconds(delay_ms // 1000) AS due_at FROM q")
def retry_schedule(spark, d):
    e = _t(spark, d, "events")
    return retry.schedule(retry.attempts(e, F.col("event_type") == "error", "user_id", ["ts", "event_id"])).select("event_id", "attempt", "delay_ms", "due_at")


@query(_ATTEMPTS + f""", l AS (SELECT user_id, max(attempt) AS attempt, max(epoch_us(ts) // 1000 + delay_ms) AS due FROM q GROUP BY user_id)
 SELECT user_id, attempt, greatest(due - {_NOW}, 0)::BIGINT AS due_in_ms, printf('%d.%03ds', greatest(due - {_NOW}, 0) // 1000, greatest(due - {_NOW}, 0) % 1000) AS words FROM l""")
def backoff_queue(spark, d):
    e = retry.schedule(retry.attempts(_t(spark, d, "events"), F.col("event_type") == "error", "user_id", ["ts", "event_id"]))
    due = (_ms(F.col("ts")) + F.col("delay_ms")).alias("due")
    q = e.select("user_id", "attempt", due).groupBy("user_id").agg(F.max("attempt").alias("attempt"), F.max("due").alias("due_at_ms"))
    q = retry.due(q, _NOW)
    return q.select("user_id", "attempt", "due_in_ms", tx.countdown(F.col("due_in_ms")).alias("words"))


@query(f"SELECT user_id, date_sub('millisecond', max(ts), TIMESTAMP '2024-01-30 00:00:00')::BIGINT AS idle_ms FROM events GROUP BY user_id HAVING date_sub('millisecond', max(ts), TIMESTAMP '2024-01-30 00:00:00') > 7200000")
def stalled(spark, d):
    e = _t(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last_ts"), F.min("ts").alias("started_at"))
    return retry.stalled(e, F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"), 7_200_000).select("user_id", "idle_ms")


@query("""WITH w AS (SELECT p_partkey, unnest(string_split(upper(p_name), ' ')) AS x, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part),
 f AS (SELECT p_partkey, lower(trim(x)) AS x, min(i) AS i FROM w WHERE trim(x) <> '' GROUP BY 1, 2) SELECT p_partkey, string_agg(x, '|' ORDER BY i) AS labels FROM f GROUP BY 1""")
def label_cleanup(spark, d):
    p = _t(spark, d, "part")
    return p.select("p_partkey", F.array_join(tx.clean_labels(F.split(F.upper("p_name"), " ")), "|").alias("labels"))


@query("""SELECT page_id, CASE WHEN regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g') = url THEN url ELSE regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g') || '--' || substr(sha256(url), 1, 16) END AS workspace_key FROM pages""")
def workspace_keys(spark, d):
    return _t(spark, d, "pages").select("page_id", tx.safe_key(F.col("url")).alias("workspace_key"))


@query("""SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(html, '\\x1B\\[[0-9;]*[A-Za-z]', '', 'g'), '\\x1B.', '', 'g'), '[\\x00-\\x1F\\x7F]', '', 'g')) AS clean_md5 FROM pages""")
def sanitize_text(spark, d):
    return _t(spark, d, "pages").select("page_id", F.md5(tx.without_control(F.col("html"))).alias("clean_md5"))


@query("""SELECT doc_id, CASE WHEN octet_length(encode(t)) > 80 THEN left_grapheme(t, 80) || '...' ELSE t END AS preview
 FROM (SELECT doc_id, trim(regexp_replace(replace(text, 'e', 'e' || chr(769)), '[\\s\\x0B]+', ' ', 'g')) AS t FROM documents)""")
def inline_preview(spark, d):
    return _t(spark, d, "documents").select("doc_id", tx.inline(F.replace("text", F.lit("e"), F.lit("e\u0301"))).alias("preview"))  # letters with a mark of their own


@query("""WITH c AS (SELECT doc_id, trim(regexp_replace(text, '[\\s\\x0B]+', ' ', 'g')) AS t FROM documents),
 k AS (SELECT doc_id, CASE WHEN octet_length(encode(t)) > 30 THEN left_grapheme(t, 27) || '...' ELSE t END AS t FROM c)
 SELECT doc_id, t || repeat(' ', greatest(30 - length_grapheme(t), 0)) || lpad(doc_id::VARCHAR, 8, ' ') AS line FROM k""")
def truncate_cells(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.concat(tx.cell(F.col("text"), 30), tx.cell(F.col("doc_id").cast("string"), 8, right=True)).alias("line"))


@query("""SELECT p_partkey, lower(trim(regexp_replace(regexp_replace(regexp_replace(replace(p_type, ' ', '_'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_/]', ' ', 'g'), '\\s+', ' ', 'g'))) AS words FROM part""")
def humanize_types(spark, d):
    return _t(spark, d, "part").select("p_partkey", tx.spaced_words(F.replace("p_type", F.lit(" "), F.lit("_"))).alias("words"))


@query("SELECT event_id, 'in ' || format('{:,}', (value * 1000)::BIGINT) || ', total ' || format('{:,}', event_id) AS usage FROM (SELECT event_id, floor(value)::BIGINT AS value FROM events)")
def usage_text(spark, d):
    usage = F.to_json(F.struct((F.floor("value") * 1000).alias("input_tokens"), F.col("event_id").alias("total")))
    return _t(spark, d, "events").select("event_id", ev.usage_text(usage).alias("usage"))


@query("SELECT o_orderkey, format('{:,}', floor(o_totalprice)::BIGINT) AS price, printf('%dm %ds', o_custkey // 60, o_custkey % 60) AS duration FROM orders")
def format_counts(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", tx.grouped(F.floor("o_totalprice")).alias("price"), tx.duration_words(F.col("o_custkey")).alias("duration"))


@query("SELECT o_orderkey, 0 AS page FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_orderkey, 1 FROM orders WHERE o_orderpriority < '3'")
def page_union(spark, d):
    o = _t(spark, d, "orders")
    return reconcile.merged_pages(o.where("o_orderstatus = 'O'").select("o_orderkey"), o.where("o_orderpriority < '3'").select("o_orderkey"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_orderkey FROM orders WHERE o_orderpriority < '3'")
def visible_diff(spark, d):
    o = _t(spark, d, "orders")
    return reconcile.not_visible(o.where("o_orderstatus = 'O'").select("o_orderkey"), o.where("o_orderpriority < '3'"), "o_orderkey")


@query("SELECT page_id, CASE WHEN contains(url, 'casino') THEN NULL WHEN regexp_matches(url, '^https?://[^/]') THEN url END AS link FROM pages")
def external_links(spark, d):
    u = F.when(F.col("url").contains("casino"), F.replace("url", F.lit("http"), F.lit("ftp"))).otherwise(F.col("url"))
    return _t(spark, d, "pages").select("page_id", tx.safe_link(u).alias("link"))
