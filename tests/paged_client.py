"""A tracker of two scopes, three records a page."""


class Client:
    records = {"x": [{"id": str(i), "state": "open" if i % 2 else "closed"} for i in range(7)], "y": []}

    def pages(self, scope, states, cursor):
        rows = [r for r in self.records[scope] if states is None or r["state"] in states]
        at = int(cursor or 0)
        following = str(at + 3) if at + 3 < len(rows) else None
        return rows[at : at + 3], following


class Broken(Client):
    def pages(self, scope, states, cursor):
        return [], ""


class Counted(Client):
    def page_count(self, scope, states):
        return -(-len(self.records[scope]) // 3)

    def pages(self, scope, states, cursor):
        return self.records[scope][cursor * 3 : cursor * 3 + 3], None
