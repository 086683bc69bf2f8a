"""Transports of invented trackers, for the clients of sources.clients."""

ISSUES = [{"number": i, "id": 100 + i, "state": "open" if i % 3 else "closed", "title": f"t{i}"} for i in range(1, 251)]


def github(request):
    assert request.path.startswith("/repos/o/r/issues"), request
    if request.path != "/repos/o/r/issues":
        own = [r for r in ISSUES if request.path.endswith(f"/{r['number']}")]
        return (200, own[0]) if own else (404, {})
    p = request.params
    assert (p["per_page"], p["sort"], p["direction"]) == (100, "created", "asc")
    rows = [r for r in ISSUES if p["state"] in ("all", r["state"])]
    return 200, rows[(p["page"] - 1) * 100 : p["page"] * 100]


def jira(request):
    b = request.body
    row = lambda i: {"id": str(i), "key": f"P-{i}", "fields": {"project": {"key": "P" if i % 10 else "Q"}, "status": {"name": "To Do"}}}
    if request.path.endswith("bulkfetch"):
        assert len(b["issueIdsOrKeys"]) <= 100
        return 200, {"issues": [row(int(i)) for i in reversed(b["issueIdsOrKeys"]) if int(i) < 300]}
    if b["jql"].startswith('project = "bad'):
        return 200, {"issues": [], "isLast": False}
    at = int(b.get("nextPageToken", 0))
    return 200, {"issues": [row(i) for i in range(at, at + 3)]} | ({"isLast": True} if at >= 6 else {"isLast": False, "nextPageToken": str(at + 3)})


def linear(request):
    v = request.body["variables"]
    if "viewer" in request.body["query"]:
        return 200, {"data": {"viewer": {"id": "u1"}}}
    if "ids" in v:
        return 200, {"data": {"issues": {"nodes": [{"id": i} for i in v["ids"] if i != "none"]}}}
    assert v["first"] == 50
    done = v["after"] == "c2"
    return 200, {"data": {"issues": {"nodes": [{"id": v["after"] or "c0", "state": {"name": "Todo"}}], "pageInfo": {"hasNextPage": not done, "endCursor": None if done else ("c1" if not v["after"] else "c2")}}}}


def asana(request):
    task = lambda i, p="p": {"gid": str(i), "memberships": [{"project": {"gid": p}, "section": {"name": "Todo" if i % 2 else "Done"}}]}
    if request.path.startswith("/tasks/"):
        i = int(request.path.rsplit("/", 1)[1])
        return (404, {}) if i > 9 else (200, {"data": task(i, "p" if i < 8 else "other")})
    at = int(request.params.get("offset", 0))
    return 200, {"data": [task(at), task(at + 1)], "next_page": {"offset": str(at + 2)} if at < 4 else None}


def gitlab(request):
    assert request.path.startswith("/projects/a%2Fb/issues")
    return (200, [{"iid": 1, "state": "opened"}]) if request.path.endswith("issues") else (200, {"iid": 1, "state": "opened"}) if request.path.endswith("/1") else (404, None)
