"""Expressions over runtime event payloads, which are JSON texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, inline, lenient_integer, spaced_words, truncated, without_control


def at(payload: Column, *paths: str) -> Column:
    """First value found at the paths, as text (objects as JSON)."""
    return F.coalesce(*(_member(payload, p) for p in paths))


def _member(x: Column, path: str) -> Column:
    """Value at a path; a text that holds neither its longest name nor an escape, which may spell it, isn't parsed."""
    name = max(path.split("."), key=lambda n: (n != "params", len(n)))
    return F.when(x.contains(name) | x.contains("\\"), F.get_json_object(x, f"$.{path}"))


# Names that usage counters go by, most trusted first.
INPUT_NAMES = ("input_tokens", "prompt_tokens", "input", "promptTokens", "inputTokens")
OUTPUT_NAMES = ("output_tokens", "completion_tokens", "output", "completion", "outputTokens", "completionTokens")
TOTAL_NAMES = ("total_tokens", "total", "totalTokens")
ABSOLUTE_PATHS = ("params.msg.payload.info.total_token_usage", "params.msg.info.total_token_usage", "params.tokenUsage.total", "tokenUsage.total")
_COUNTER_NAMES = tuple(n for n in (*INPUT_NAMES, *OUTPUT_NAMES, *TOTAL_NAMES) if n not in ("input", "output", "completion", "total"))


def counter(usage: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(*(lenient_integer(_member(usage, n)) for n in names))


def _counters_or_null(usage: Column) -> Column:
    return bound(usage, lambda u: F.when(u.startswith("{"), F.when(counter(u, _COUNTER_NAMES).isNotNull(), u)))


def token_usage(payload: Column, usage: Column | None = None) -> Column:
    """Cumulative usage map of an event: an absolute total if any, else that of a completed turn."""
    if usage is None:
        return bound(payload, lambda p: _token_usage([p]))
    return bound(usage, lambda u: bound(payload, lambda p: _token_usage([u, p])))


def _token_usage(sources: list[Column]) -> Column:
    absolute = [_counters_or_null(at(s, p)) for s in sources for p in ABSOLUTE_PATHS]
    turn = [F.when(at(s, "method") == "turn/completed", _counters_or_null(at(s, "usage", "params.usage"))) for s in sources]
    return F.coalesce(*absolute, *turn)


def usage_text(usage: Column) -> Column:
    """`in X, out Y, total Z`, without missing parts; null if all are."""
    part = lambda u, word, names: F.concat(F.lit(f"{word} "), F.format_number(counter(u, names), 0))
    text = lambda u: F.concat_ws(", ", part(u, "in", INPUT_NAMES), part(u, "out", OUTPUT_NAMES), part(u, "total", TOTAL_NAMES))
    return bound(bound(usage, text), lambda t: F.when(t != "", t))


def rate_limits(payload: Column) -> Column:
    """The first object of a JSON text, at any depth, that names a limit and has a bucket (which may be null).

    A member rate_limits goes first, then the object itself, then its members in
    order of key. JSON nests without bound, which expressions can't follow: an
    Arrow-batched function, for payloads that name a limit (see may_limit).
    """
    import json

    import pandas as pd

    def is_limits(x) -> bool:
        named = isinstance(x, dict) and any(x.get(k) not in (None, False) for k in ("limit_id", "limit_name"))
        return named and not {"primary", "secondary", "credits"}.isdisjoint(x)

    def find(x):
        if isinstance(x, dict):
            own = next((y for y in (x.get("rate_limits"), x) if is_limits(y)), None)
            return own or next((r for k in sorted(x) if (r := find(x[k]))), None)
        return next((r for v in x if (r := find(v))), None) if isinstance(x, list) else None

    def flat(x):
        try:
            found = find(json.loads(x))
        except (ValueError, RecursionError):
            return None
        return json.dumps(found) if found else None

    def run(s: pd.Series) -> pd.Series:
        return s.map(flat, na_action="ignore")

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(payload)


def may_limit(payload: Column) -> Column:
    """False for texts that can't hold rate limits."""
    return F.coalesce(payload.contains('"limit_id"') | payload.contains('"limit_name"'), F.lit(False))


def rate_limit_bucket(x: Column) -> Column:
    return bound(x, _rate_limit_bucket)


def _rate_limit_bucket(x: Column) -> Column:
    number = lambda *names: F.format_number(lenient_integer(at(x, *names)), 0)
    counts = F.coalesce(F.concat(number("remaining"), F.lit("/"), number("limit")), F.lit("n/a"))
    reset = F.concat(F.lit("reset "), number("reset_in_seconds", "resetInSeconds"), F.lit("s"))
    return F.when(x.isNotNull(), F.concat_ws(" ", counts, reset))


def _money(credits: Column) -> Column:
    amount = lambda v: F.when(v.isNotNull(), F.concat(F.lit("credits "), F.format_string("%.2f", v.try_cast("double"))))
    held = lambda has: F.when(has == "false", "credits none").otherwise(F.coalesce(bound(at(credits, "balance"), amount), F.when(has == "true", "credits available")))
    return F.when(at(credits, "unlimited") == "true", "credits unlimited").otherwise(bound(at(credits, "has_credits"), held))


def rate_limits_text(x: Column) -> Column:
    return bound(bound(x, _rate_limits_text), lambda t: F.when(t == "", "unavailable").otherwise(t))


def _rate_limits_text(x: Column) -> Column:
    part = lambda word, v: F.concat(F.lit(f"{word} "), v)
    return F.concat_ws(
        " | ", at(x, "limit_id", "limit_name"), part("primary", rate_limit_bucket(at(x, "primary"))), part("secondary", rate_limit_bucket(at(x, "secondary"))), bound(at(x, "credits"), _money)
    )


def command_text(x: Column) -> Column:
    """Command of a JSON text: a string, a list of words, or an object that holds one."""
    words = lambda held: F.array_join(F.from_json(held, "array<string>"), " ")
    text = lambda held: F.when(held.startswith("["), words(held)).when(held.startswith("{"), None).otherwise(held)
    return inline(bound(bound(x, lambda v: F.coalesce(at(v, "parsedCmd", "command", "cmd"), v)), text))


def line_count(diff: Column) -> Column:
    return F.size(F.filter(F.split(diff, "\n"), lambda v: v != ""))


def _with(base: str, value: Column, pattern: str = " (%s)") -> Column:
    return F.concat(F.lit(base), bound(value, lambda v: F.when(v.isNotNull(), F.format_string(pattern, v)).otherwise("")))


def _present(base: str, value: Column, pattern: str) -> Column:
    return bound(value, lambda v: F.when(F.coalesce(F.trim(v) != "", F.lit(False)), F.format_string(base + pattern, v)).otherwise(base))


# Sentences of methods that only name what streams.
STREAMING = {
    "item/agentMessage/delta": "agent message streaming",
    "item/plan/delta": "plan streaming",
    "item/reasoning/summaryTextDelta": "reasoning summary streaming",
    "item/reasoning/summaryPartAdded": "reasoning summary section added",
    "item/reasoning/textDelta": "reasoning text streaming",
    "item/commandExecution/outputDelta": "command output streaming",
    "item/fileChange/outputDelta": "file change output streaming",
}
WRAPPED_STREAMING = {
    "agent_message_delta": "agent message streaming",
    "agent_message_content_delta": "agent message content streaming",
    "agent_reasoning_delta": "reasoning streaming",
    "reasoning_content_delta": "reasoning content streaming",
}
WRAPPED_FIXED = {
    "mcp_startup_complete": "mcp startup complete",
    "task_started": "task started",
    "user_message": "user message received",
    "agent_reasoning_section_break": "reasoning section break",
    "turn_diff": "turn diff updated",
    "exec_command_output_delta": "command output streaming",
    "mcp_tool_call_begin": "mcp tool call started",
    "mcp_tool_call_end": "mcp tool call completed",
}
WRAPPED_PREFIX = "codex/event/"
METHOD_FIXED = {
    "turn/cancelled": "turn cancelled",
    "account/chatgptAuthTokens/refresh": "account auth token refresh requested",
}


def _lifecycle(p: Column, state: str) -> Column:
    return bound(F.coalesce(at(p, "params.item", "params.msg.payload"), F.lit("{}")), lambda item: _item(item, state))


def _item(item: Column, state: str) -> Column:
    kind = F.coalesce(spaced_words(at(item, "type")), F.lit("item"))
    extra = F.concat_ws(", ", F.substring(at(item, "id"), 1, 12), spaced_words(at(item, "status")))
    return F.concat(F.lit(f"item {state}: "), kind, F.when(extra != "", F.concat(F.lit(" ("), extra, F.lit(")"))).otherwise(""))


def method_sentence(method: Column, p: Column) -> Column:
    """Sentence of an agent's message, by its method; an unknown method stands for itself."""
    wrapped = lambda m: F.regexp_extract(m, f"^{WRAPPED_PREFIX}(.+)$", 1)
    return bound(p, lambda v: bound(method, lambda m: bound(wrapped(m), lambda w: _method_sentence(m, w, v))))


def _method_sentence(method: Column, wrapped: Column, p: Column) -> Column:
    delta = at(p, "params.delta", "params.msg.delta", "params.textDelta", "params.outputDelta", "params.text", "params.summaryText", "params.msg.payload.delta", "params.msg.payload.content")
    usage = at(p, "params.usage", "params.tokenUsage", "usage")
    total = at(p, "params.tokenUsage.total", "usage")
    plan = at(p, "params.plan", "params.steps", "params.items")
    steps = lambda n: F.when(n.isNotNull(), F.format_string("plan updated (%d steps)", n)).otherwise("plan updated")
    planned = bound(plan, lambda v: F.when(v.isNull(), "plan updated (0 steps)").otherwise(bound(F.json_array_length(v), steps)))
    changed = bound(at(p, "params.diff"), lambda v: F.when(v != "", F.format_string("turn diff updated (%d lines)", line_count(v))).otherwise("turn diff updated"))
    files = at(p, "params.fileChangeCount", "params.changeCount").try_cast("long")
    approval = bound(files, lambda n: F.when(n > 0, F.format_string("file change approval requested (%d files)", n)).otherwise("file change approval requested"))
    question = at(p, "params.question", "params.prompt")
    asks = bound(inline(question), lambda q: F.when(F.coalesce(q != "", F.lit(False)), F.concat(F.lit("tool requires user input: "), q)).otherwise("tool requires user input"))
    tool = at(p, "params.tool", "params.name")
    command = command_text(at(p, "params.command", "params.cmd", "params.parsedCmd", "params.msg.command", "params.msg.parsed_cmd"))
    exit_code = at(p, "params.msg.exit_code", "params.msg.exitCode").try_cast("long")
    wrapped_usage = at(p, "params.msg.payload.info.total_token_usage", "params.msg.info.total_token_usage")
    cases: list[tuple[Column, Column]] = [
        (method == "thread/started", _with("thread started", at(p, "params.thread.id"))),
        (method == "turn/started", _with("turn started", at(p, "params.turn.id"))),
        (
            method == "turn/completed",
            F.concat(F.lit("turn completed ("), F.coalesce(at(p, "params.turn.status"), F.lit("completed")), F.lit(")"), F.coalesce(F.concat(F.lit(" ("), usage_text(usage), F.lit(")")), F.lit(""))),
        ),
        (method == "turn/failed", _with("turn failed", at(p, "params.error.message"), ": %s")),
        (method == "turn/diff/updated", changed),
        (method == "turn/plan/updated", planned),
        (method == "thread/tokenUsage/updated", _with("thread token usage updated", usage_text(total))),
        (method == "item/started", _lifecycle(p, "started")),
        (method == "item/completed", _lifecycle(p, "completed")),
        (method == "item/commandExecution/requestApproval", _with("command approval requested", command)),
        (method == "item/fileChange/requestApproval", approval),
        (method.isin("item/tool/requestUserInput", "tool/requestUserInput"), asks),
        (method == "account/updated", F.concat(F.lit("account updated (auth "), F.coalesce(at(p, "params.authMode"), F.lit("unknown")), F.lit(")"))),
        (method == "account/rateLimits/updated", F.concat(F.lit("rate limits updated: "), rate_limits_text(at(p, "params.rateLimits")))),
        (method == "item/tool/call", _present("dynamic tool call requested", tool, " (%s)")),
        (wrapped == "mcp_startup_update", F.concat(F.lit("mcp startup: "), F.coalesce(at(p, "params.msg.server"), F.lit("mcp")), F.lit(" "), F.coalesce(at(p, "params.msg.status.state"), F.lit("updated")))),
        (wrapped == "item_started", _lifecycle(p, "started")),
        (wrapped == "item_completed", _lifecycle(p, "completed")),
        (wrapped == "agent_reasoning", _with("reasoning update", inline(at(p, "params.reason", "params.summaryText", "params.msg.reason", "params.msg.text")), ": %s")),
        (wrapped == "exec_command_begin", F.coalesce(command, F.lit("command started"))),
        (wrapped == "exec_command_end", _with("command completed", exit_code.cast("string"), " (exit %s)")),
        (wrapped == "token_count", _with("token count update", usage_text(wrapped_usage))),
    ]
    for names, column in ((STREAMING, method), (WRAPPED_STREAMING, wrapped)):
        cases += [(column == name, _with(text, inline(delta), ": %s")) for name, text in names.items()]
    for names, column in ((METHOD_FIXED, method), (WRAPPED_FIXED, wrapped)):
        cases += [(column == name, F.lit(text)) for name, text in names.items()]
    kind = at(p, "params.msg.type")
    other = _with_name(F.when(wrapped != "", wrapped).otherwise(method), kind)
    return reduce(lambda chain, c: chain.when(*c), cases[1:], F.when(*cases[0])).otherwise(other)


def _with_name(base: Column, kind: Column) -> Column:
    return bound(kind, lambda k: F.when(k.isNotNull(), F.concat(base, F.lit(" ("), k, F.lit(")"))).otherwise(base))


def event_sentence(event: Column, payload: Column) -> Column:
    """Sentence of a runtime event, 140 characters at most."""
    return truncated(bound(payload, lambda p: bound(event, lambda e: bound(at(p, "method"), lambda m: _event_sentence(e, m, p)))), 140)


def _event_sentence(event: Column, method: Column, payload: Column) -> Column:
    session, tool = at(payload, "session_id"), at(payload, "params.tool", "params.name")
    approved, failed = F.coalesce(event == "approval_auto_approved", F.lit(False)), event == "turn_failed"
    says = method_sentence(F.when(failed, "turn/failed").otherwise(method), payload)
    after = F.when(approved, F.concat(F.lit(" (auto-approved)"), F.coalesce(F.concat(F.lit(": "), at(payload, "decision")), F.lit("")))).otherwise("")
    reason = F.coalesce(at(payload, "reason", "error"), payload)
    plain = F.trim(without_control(F.replace(payload, F.lit("\n"), F.lit(" "))))
    return (
        F.when(payload.isNull() & event.isNull(), "no message yet")
        .when(event == "session_started", _with("session started", session))
        .when(event == "turn_input_required", "turn blocked: waiting for user input")
        .when(event == "tool_call_completed", _present("dynamic tool call completed", tool, " (%s)"))
        .when(event == "tool_call_failed", _present("dynamic tool call failed", tool, " (%s)"))
        .when(event == "unsupported_tool_call", _present("unsupported dynamic tool call rejected", tool, " (%s)"))
        .when(event == "turn_ended_with_error", F.concat(F.lit("turn ended with error: "), reason))
        .when(event == "startup_failed", F.concat(F.lit("startup failed: "), reason))
        .when(event == "turn_cancelled", "turn cancelled")
        .when(event == "malformed", "malformed JSON event")
        .when(method.isNotNull() | failed, F.concat(says, after))
        .when(approved, F.concat(F.lit("approval request auto-approved"), F.coalesce(F.concat(F.lit(": "), at(payload, "decision")), F.lit(""))))
        .when(session.isNotNull(), _with("session started", session))
        .when(at(payload, "error").isNotNull(), F.concat(F.lit("error: "), F.coalesce(at(payload, "error.message"), at(payload, "error"))))
        .otherwise(plain)
    )


def route(line: Column) -> Column:
    """Kind of a protocol line: completed, failed, cancelled, notification, response, malformed, other or log."""
    return bound(line, _route)


def _route(line: Column) -> Column:
    by = lambda m: (
        F.when(m == "turn/completed", "completed").when(m == "turn/failed", "failed").when(m == "turn/cancelled", "cancelled").when(m.isNotNull(), "notification")
        .when(at(line, "id").isNotNull(), "response").otherwise("other")
    )
    kind = F.when(F.try_parse_json(line).isNotNull(), bound(at(line, "method"), by)).otherwise("malformed")
    return F.when(is_object(line), kind).otherwise("log")


def is_object(line: Column) -> Column:
    """The line sets out as a JSON object; others are log lines."""
    return F.coalesce(F.ltrim(line).startswith("{"), F.lit(False))


# Messages that wait for an operator.
INPUT_METHODS = ("turn/input_required", "turn/needs_input", "turn/need_input", "turn/request_input", "turn/request_response", "turn/provide_input", "turn/approval_required", "item/tool/requestUserInput", "mcpServer/elicitation/request")


OPERATOR_EVENTS = ("turn_input_required", "approval_required")
OPERATOR_OUTCOMES = ("input_required", "needs_input", "approval_required")


def needs_operator(event: Column, payload: Column, completion: Column | None = None) -> Column:
    """The event, the message or the outcome of a completion (a JSON text, else the payload's) waits for an operator."""
    return bound(payload, lambda p: _needs_operator(event, p, completion))


def _needs_operator(event: Column, payload: Column, completion: Column | None) -> Column:
    outcome = at(payload, "completion.outcome", "outcome", "params.turn.status", "status")
    if completion is not None:
        outcome = F.coalesce(bound(completion, lambda c: at(c, "outcome")), outcome)
    waits = (event.isin(*OPERATOR_EVENTS), at(payload, "method").isin(*INPUT_METHODS), outcome.isin(*OPERATOR_OUTCOMES))
    return reduce(lambda a, b: a | b, (F.coalesce(w, F.lit(False)) for w in waits))


def envelope(line: Column, now: Column) -> Column:
    """Event, time, usage and payload of a protocol line, in a struct."""
    return bound(line, lambda v: bound(route(v), lambda kind: _envelope(v, kind, now)))


def _envelope(line: Column, kind: Column, now: Column) -> Column:
    event = F.when(kind == "completed", "turn_completed").when(kind == "failed", "turn_failed").when(kind == "cancelled", "turn_cancelled").otherwise(kind)
    return F.struct(event.alias("event"), now.alias("ts"), F.when(kind != "log", token_usage(line)).alias("usage"), F.when(kind != "malformed", line).alias("payload"), F.when(kind == "malformed", line).alias("raw"))


def last_message(event: Column, payload: Column, raw: Column, ts: Column) -> Column:
    return F.struct(event.alias("event"), F.coalesce(payload, raw).alias("message"), ts.alias("timestamp"))
