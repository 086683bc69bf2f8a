"""Workflow files: YAML front matter and a template body, validated, reloaded when they change."""

from __future__ import annotations

import hashlib
import html
import os
import re
from dataclasses import dataclass, field, fields
from datetime import date, time
from pathlib import Path


class ConfigError(ValueError):
    """One message a problem."""


@dataclass(frozen=True)
class Config:
    tracker_kind: str = "memory"
    active_states: tuple[str, ...] = ("Todo", "In Progress")
    terminal_states: tuple[str, ...] = ("Closed", "Cancelled", "Canceled", "Duplicate", "Done")
    required_labels: tuple[str, ...] = ()
    assignee: str | None = None
    poll_interval_ms: int = 30_000
    max_concurrent_agents: int = 10
    max_turns: int = 20
    max_retry_backoff_ms: int = 300_000
    max_concurrent_agents_by_state: dict[str, int] = field(default_factory=dict)
    hosts: tuple[str, ...] = ()
    max_agents_per_host: int | None = None
    stall_timeout_ms: int = 300_000
    turn_timeout_ms: int = 3_600_000
    read_timeout_ms: int = 5_000
    refresh_ms: int = 1_000
    render_interval_ms: int = 16
    port: int | None = None
    provider: dict = field(default_factory=dict)

    def problems(self) -> list[str]:
        """One message for each wrong type, each number out of its range, and each contradiction."""
        out = []
        for name, least in _LEAST.items():
            v = getattr(self, name)
            if v is None and name in ("max_agents_per_host", "port"):
                continue
            if isinstance(v, bool) or not isinstance(v, int):
                out.append(f"{name} must be a whole number")
            elif v < least:
                out.append(f"{name} must be " + ("positive" if least == 1 else f"{least} or more"))
        if self.tracker_kind not in _KINDS:
            out.append(f"tracker_kind must be one of {', '.join(_KINDS)}")
        for s, n in self.max_concurrent_agents_by_state.items():
            if not str(s).strip() or isinstance(n, bool) or not isinstance(n, int) or n <= 0:
                out.append(f"limit of state {s!r} must be positive")
        both = {s.strip().lower() for s in self.active_states} & {s.strip().lower() for s in self.terminal_states}
        return out + [f"state {s!r} is both active and terminal" for s in sorted(both)]

    def state_limits(self) -> dict[str, int]:
        return {s.strip().lower(): n for s, n in self.max_concurrent_agents_by_state.items()}


# Kinds of trackers, and the least value of each number.
_KINDS = ("linear", "github", "gitlab", "jira", "asana", "memory")
_LEAST = {
    "poll_interval_ms": 1, "max_concurrent_agents": 1, "max_turns": 1, "max_retry_backoff_ms": 1, "max_agents_per_host": 1, "stall_timeout_ms": 0,
    "turn_timeout_ms": 1, "read_timeout_ms": 1, "refresh_ms": 1, "render_interval_ms": 1, "port": 0,
}


def cast(value):
    """A text of a whole number, as front matter and environment give them, as that number; all else as it is."""
    return int(value) if isinstance(value, str) and re.fullmatch(r"\s*[+-]?[0-9]+\s*", value) else value


def plain(value):
    """Keys as text, without nulls, at any depth."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items() if v is not None}
    return [plain(v) for v in value] if isinstance(value, list) else value


def resolved(value, env=os.environ):
    """Texts that are $NAME as the environment has them; a missing or empty one is null."""
    if isinstance(value, dict):
        return {k: resolved(v, env) for k, v in value.items()}
    m = re.fullmatch(r"\$([A-Za-z_][A-Za-z0-9_]*)", value) if isinstance(value, str) else None
    return (env.get(m[1]) or None) if m else value


def parse(text: str, env=os.environ) -> tuple[Config, str]:
    """Config and body of a workflow file."""
    import yaml

    m = re.match(r"\A---[ \t]*\r?\n(.*?)(?:\r?\n)?^---[ \t]*(?:\r?\n|\Z)(.*)\Z", text, re.S | re.M)
    front, body = (m[1], m[2]) if m else ("", text)
    loaded = yaml.safe_load(front) if front.strip() else {}
    if not isinstance(loaded, dict):
        raise ConfigError("front matter isn't a map")
    given = resolved(plain(loaded), env)
    names = {f.name for f in fields(Config)}
    known = {k: tuple(v) if isinstance(v, list) else cast(v) if k in _LEAST else v for k, v in given.items() if k in names}
    if isinstance(known.get("max_concurrent_agents_by_state"), dict):
        known["max_concurrent_agents_by_state"] = {k: cast(v) for k, v in known["max_concurrent_agents_by_state"].items()}
    config = Config(**known, provider={**known.pop("provider", {}), **{k: v for k, v in given.items() if k not in names}}) if "provider" not in known else Config(**known)
    if found := config.problems():
        raise ConfigError("; ".join(found))
    return config, body.strip()


class Store:
    """The last good version of a workflow file; call current() once a micro-batch."""

    def __init__(self, path: str):
        self.path, self.stamp, self.error = Path(path), None, None
        self.value = parse(self.path.read_text(encoding="utf-8"))
        self.stamp = self._stamp()

    def _stamp(self):
        s = self.path.stat()
        return s.st_mtime_ns, s.st_size, hashlib.sha256(self.path.read_bytes()).hexdigest()

    def current(self) -> tuple[Config, str]:
        try:
            stamp = self._stamp()
            if stamp != self.stamp:
                self.value, self.stamp, self.error = parse(self.path.read_text(encoding="utf-8")), stamp, None
        except (OSError, ConfigError) as e:
            self.error = e
        return self.value


# Filters that a template may use, by name.
FILTERS = {
    "upcase": lambda v, *_: str(v).upper(),
    "downcase": lambda v, *_: str(v).lower(),
    "capitalize": lambda v, *_: str(v)[:1].upper() + str(v)[1:].lower(),
    "strip": lambda v, *_: str(v).strip(),
    "size": lambda v, *_: len(v) if hasattr(v, "__len__") else 0,
    "join": lambda v, by=" ", *_: by.join(map(str, v)),
    "first": lambda v, *_: v[0] if v else None,
    "last": lambda v, *_: v[-1] if v else None,
    "default": lambda v, other="", *_: other if v in (None, "", False, []) else v,
    "append": lambda v, more="", *_: f"{v}{more}",
    "prepend": lambda v, more="", *_: f"{more}{v}",
    "replace": lambda v, old="", new="", *_: str(v).replace(old, new),
    "truncate": lambda v, n="50", *_: str(v) if len(str(v)) <= int(n) else str(v)[: max(0, int(n) - 3)] + "...",
    "date": lambda v, form="%Y-%m-%d", *_: v.strftime(form) if hasattr(v, "strftime") else str(v),
    "escape": lambda v, *_: html.escape(str(v)),
}


def context(values: dict) -> dict:
    """Template values: keys as text, dates and times as ISO text, at any depth."""

    def told(v):
        if isinstance(v, (date, time)):  # datetimes are dates
            return v.isoformat().replace("+00:00", "Z")
        if isinstance(v, dict):
            return {str(k): told(x) for k, x in v.items()}
        if hasattr(v, "asDict"):
            return told(v.asDict())
        return [told(x) for x in v] if isinstance(v, (list, tuple)) else v

    return told(values)


def rendered(template: str, values: dict) -> str:
    """The template with each {{ a.b | filter: "x" }} replaced; an unknown name or filter fails. A blank template is the default one."""
    known = context(values)

    def found(name: str):
        at = known
        for part in name.split("."):
            if not isinstance(at, dict) or part not in at:
                raise ConfigError(f"unknown name {name}")
            at = at[part]
        return at

    def value(m):
        at = found(m[1])
        for step in _FILTER.finditer(m[2] or ""):
            if step[1] not in FILTERS:
                raise ConfigError(f"unknown filter {step[1]}")
            given = [a or b or c for a, b, c in re.findall(r"\"([^\"]*)\"|'([^']*)'|([\w.%-]+)", step[2] or "")]
            at = FILTERS[step[1]](at, *given)
        return "" if at is None else "".join(map(str, at)) if isinstance(at, list) else str(at).lower() if isinstance(at, bool) else str(at)

    return re.sub(r"\{\{\s*([A-Za-z_][\w.]*)\s*((?:\|[^}]*)?)\}\}", value, template)


_FILTER = re.compile(r"""\|\s*(\w+)\s*(?::((?:\s*(?:"[^"]*"|'[^']*'|[^|"'])+)))?""")
