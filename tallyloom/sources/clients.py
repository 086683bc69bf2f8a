"""Clients of five trackers: what they ask for and how they read the answers; the transport is a function of yours.

A transport takes a Request and returns (status, decoded JSON). A client's
pages(scope, states, cursor) serves scans by the tracker source, one page a call;
by_ids(scope, ids) serves lookups: repeated ids are asked for once, answers come in
the order of the request, what is absent (404) or of another scope is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from urllib.parse import quote


class TrackerError(RuntimeError):
    """The tracker refused, or answered in a form that isn't known."""


class PagingError(TrackerError):
    """A page promised another one without saying where."""


@dataclass(frozen=True)
class Request:
    method: str
    path: str
    params: dict = field(default_factory=dict)
    body: dict | None = None


Transport = Callable[[Request], tuple[int, object]]


def segment(x) -> str:
    return quote(str(x), safe="-._~")


class Client:
    """What all trackers share. BATCH is the number of ids in a lookup's request."""

    PAGE, BATCH = 100, 1
    STATES: dict[str, str] = {}

    def __init__(self, send: Transport):
        self.send = send

    def asked(self, request: Request, absent_ok: bool = False):
        status, payload = self.send(request)
        if absent_ok and status == 404:
            return None
        if status != 200:
            raise TrackerError(f"{request.method} {request.path}: status {status}")
        return payload

    def pages(self, scope: str, states: list[str] | None, cursor):
        """(records, cursor of the next page or None)."""
        raise NotImplementedError

    def lookup(self, scope: str, ids: list[str]) -> Iterable[dict]:
        """Records of one batch of ids."""
        raise NotImplementedError

    def record_id(self, record: dict) -> str:
        return str(record.get("id"))

    def record_state(self, record: dict, scope: str) -> str | None:
        return record.get("state")

    def in_scope(self, record: dict, scope: str) -> bool:
        return True

    def by_ids(self, scope: str, ids: Iterable[str]) -> list[dict]:
        wanted = list(dict.fromkeys(str(i).strip() for i in ids if str(i).strip()))
        found = {}
        for k in range(0, len(wanted), self.BATCH):
            for r in self.lookup(scope, wanted[k : k + self.BATCH]):
                if not isinstance(r, dict):
                    raise TrackerError("a record that is no object")
                if self.in_scope(r, scope):
                    found[self.record_id(r)] = r
        return [found[i] for i in wanted if i in found]

    def one_state(self, states: list[str] | None) -> str | None:
        """The tracker's own word for a set of states: one of two, or all; None if none of them is known."""
        own = {self.STATES[s.strip().lower()] for s in states if s.strip().lower() in self.STATES} if states is not None else set(self.STATES.values())
        return None if not own else own.pop() if len(own) == 1 else "all"


class Numbered(Client):
    """Pages by number, ended by a short one; one request an id."""

    ITEMS, ORDER, ID = "", {}, ""

    def root(self, scope: str) -> str:
        raise NotImplementedError

    def pages(self, scope, states, cursor):
        state, page = self.one_state(states), int(cursor or 1)
        if state is None:
            return [], None
        got = self.asked(Request("GET", self.root(scope), {"state": state, "per_page": self.PAGE, "page": page, **self.ORDER}))
        if not isinstance(got, list):
            raise TrackerError("a page that is no list")
        return got, page + 1 if len(got) >= self.PAGE else None

    def lookup(self, scope, ids):
        got = (self.asked(Request("GET", f"{self.root(scope)}/{segment(i)}"), absent_ok=True) for i in ids if i.isdigit())
        return [r for r in got if r is not None]

    def record_id(self, record):
        return str(record.get(self.ID))


class GitHub(Numbered):
    """Paths, names and words of its interface."""

    STATES, ORDER, ID = {"open": "open", "closed": "closed"}, {"sort": "created", "direction": "asc"}, "number"

    def root(self, scope):
        return "/repos/" + "/".join(map(segment, scope.split("/"))) + "/issues"


class GitLab(Numbered):
    """Paths, names and words of its interface."""

    STATES, ORDER, ID = {"opened": "opened", "closed": "closed"}, {"order_by": "created_at", "sort": "asc"}, "iid"

    def root(self, scope):
        return f"/projects/{segment(scope)}/issues"


class Jira(Client):
    """Pages by token; ids in bulk. Paths, names and the query language."""

    BATCH = 100
    FIELDS = ("summary", "description", "status", "labels", "assignee", "created", "updated", "project", "issuelinks")

    def pages(self, scope, states, cursor):
        text = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
        jql = f"project = {text(scope)}" + (f" AND status in ({', '.join(map(text, states))})" if states is not None else "") + " ORDER BY created ASC"
        body = {"jql": jql, "fields": list(self.FIELDS), "maxResults": self.PAGE} | ({"nextPageToken": cursor} if cursor else {})
        got = self.asked(Request("POST", "/rest/api/3/search/jql", body=body))
        if not isinstance(got, dict) or not isinstance(got.get("issues"), list):
            raise TrackerError("a page without issues")
        following = None if got.get("isLast") is True else got.get("nextPageToken")
        if got.get("isLast") is not True and not following:
            raise PagingError(f"{scope}: a next page without a token")
        return got["issues"], following

    def lookup(self, scope, ids):
        got = self.asked(Request("POST", "/rest/api/3/issue/bulkfetch", body={"issueIdsOrKeys": ids, "fields": list(self.FIELDS)}))
        return got["issues"]

    def record_state(self, record, scope):
        return ((record.get("fields") or {}).get("status") or {}).get("name")

    def in_scope(self, record, scope):
        return ((record.get("fields") or {}).get("project") or {}).get("key") == scope


class Asana(Client):
    """Pages of the whole project by offset; states are judged here. Paths, names and fields."""

    FIELDS = "gid,name,notes,completed,resource_subtype,assignee.gid,tags.name,memberships.project.gid,memberships.section.gid,memberships.section.name,permalink_url,created_at,modified_at"

    def pages(self, scope, states, cursor):
        params = {"limit": self.PAGE, "opt_fields": self.FIELDS} | ({"offset": cursor} if cursor else {})
        got = self.asked(Request("GET", f"/projects/{segment(scope)}/tasks", params))
        following = got.get("next_page")
        if following and not following.get("offset"):
            raise PagingError(f"{scope}: a next page without an offset")
        return [r for r in got["data"] if states is None or self.record_state(r, scope) in states], following["offset"] if following else None

    def lookup(self, scope, ids):
        got = (self.asked(Request("GET", f"/tasks/{segment(i)}", {"opt_fields": self.FIELDS}), absent_ok=True) for i in ids)
        return [r["data"] for r in got if r is not None]

    def record_id(self, record):
        return str(record.get("gid"))

    def _own(self, record, scope):
        return next((m for m in record.get("memberships") or [] if (m.get("project") or {}).get("gid") == scope), None)

    def record_state(self, record, scope):
        return ((self._own(record, scope) or {}).get("section") or {}).get("name")

    def in_scope(self, record, scope):
        return self._own(record, scope) is not None


class Linear(Client):
    """Pages by cursor, and ids in batches, over one query interface. Its names."""

    PAGE, BATCH = 50, 50
    NODE = (
        "id identifier title description priority state { name } branchName url assignee { id } labels { nodes { name } } "
        "inverseRelations(first: 50) { nodes { type issue { id identifier state { name } } } } createdAt updatedAt"
    )

    def asked_query(self, query: str, variables: dict) -> dict:
        got = self.asked(Request("POST", "/graphql", body={"query": query, "variables": variables}))
        if not isinstance(got, dict) or got.get("errors") or not isinstance(got.get("data"), dict):
            raise TrackerError(f"query failed: {got.get('errors') if isinstance(got, dict) else got!r}")
        return got["data"]

    def pages(self, scope, states, cursor):
        own, given = (", state: {name: {in: $states}}", ", $states: [String!]") if states is not None else ("", "")
        query = f"query($scope: String!, $first: Int!, $after: String{given}) {{ issues(filter: {{project: {{slugId: {{eq: $scope}}}}{own}}}, first: $first, after: $after) {{ nodes {{ {self.NODE} }} pageInfo {{ hasNextPage endCursor }} }} }}"
        got = self.asked_query(query, {"scope": scope, "first": self.PAGE, "after": cursor} | ({"states": states} if states is not None else {}))["issues"]
        more = got["pageInfo"].get("hasNextPage")
        if more and not got["pageInfo"].get("endCursor"):
            raise PagingError(f"{scope}: a next page without a cursor")
        return got["nodes"], got["pageInfo"]["endCursor"] if more else None

    def lookup(self, scope, ids):
        query = f"query($scope: String!, $ids: [ID!]!, $first: Int!) {{ issues(filter: {{project: {{slugId: {{eq: $scope}}}}, id: {{in: $ids}}}}, first: $first) {{ nodes {{ {self.NODE} }} }} }}"
        return self.asked_query(query, {"scope": scope, "ids": ids, "first": len(ids)})["issues"]["nodes"]

    def record_state(self, record, scope):
        return (record.get("state") or {}).get("name")

    def viewer(self) -> str:
        """Id of the user whose key the transport carries: whom the assignee `me` means."""
        who = (self.asked_query("query { viewer { id } }", {}).get("viewer") or {}).get("id")
        if not who:
            raise TrackerError("no viewer")
        return who


#: Clients by kind; more kinds may be added.
CLIENTS: dict[str, type[Client]] = {"linear": Linear, "github": GitHub, "gitlab": GitLab, "jira": Jira, "asana": Asana}


def client(kind: str, send: Transport) -> Client:
    if kind not in CLIENTS:
        raise TrackerError(f"unknown kind of tracker {kind!r}; known are {', '.join(sorted(CLIENTS))}")
    return CLIENTS[kind](send)


def assignee(kind: str, own: Client, named: str | None) -> str | None:
    """Whom items have to be assigned to: `me` is looked up where the tracker knows it."""
    named = (named or "").strip() or None
    return own.viewer() if named == "me" and isinstance(own, Linear) else named


# Methods and path roots that raw queries may use.
RAW_METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE")
RAW_ROOTS = {"github": "/", "gitlab": "/", "jira": "/rest/api/3/", "asana": "/"}


def raw_query(kind: str, send: Transport, method: str, path: str, params: dict | None = None, body: dict | None = None):
    """(status, payload) of a request of the caller's own, its method and path checked first."""
    if not isinstance(method, str) or method.strip().upper() not in RAW_METHODS:
        raise ValueError(f"method {method!r} isn't allowed")
    path = path.strip() if isinstance(path, str) else ""
    if kind not in RAW_ROOTS or not path.startswith(RAW_ROOTS[kind]) or path.startswith("//") or any(x in path for x in ("://", "\n", "\r", "\0")) or ".." in path.split("?")[0].split("/"):
        raise ValueError(f"path {path!r} isn't allowed")
    if params is not None and not isinstance(params, dict):
        raise ValueError("params must be a map")
    return send(Request(method.strip().upper(), path, params or {}, body))
