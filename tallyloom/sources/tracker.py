"""Python data sources over paged tracker interfaces, with state and id filters pushed down.

A source is named by a factory, given by import path as the option `client`
("module:function"), or by the option `kind` and a `transport` of the same form
for the clients of sources.clients. The client's pages(scope, states, cursor)
returns (records, next cursor or None) and is called on the executors, one
partition a scope, as cursors are sequential; where a client can count pages,
page_count(scope, states) spreads them over partitions. If the query names ids
and the client has by_ids(scope, ids), these alone are asked for, in partitions
of its batches.
"""

from __future__ import annotations

import importlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from .clients import CLIENTS, PagingError, client


def _named(path: str):
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def _client(options: dict):
    return client(options["kind"], _named(options["transport"])) if "kind" in options else _named(options["client"])()


class Pages(InputPartition):
    def __init__(self, scope: str, cursor, ids: list[str] | None = None):
        super().__init__((scope, cursor, ids))
        self.scope, self.cursor, self.ids = scope, cursor, ids


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = {k: options[k] for k in ("client", "kind", "transport") if k in options}
        self.scopes = [s for s in options.get("scopes", "").split(",") if s]
        self.states: list[str] | None = None
        self.ids: list[str] | None = None

    def pushFilters(self, filters):
        """State and id filters go to the client, and stay in the plan as a recheck."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute in (("state",), ("id",)):
                values = [f.value] if isinstance(f, EqualTo) else list(f.value)
                name = "states" if f.attribute == ("state",) else "ids"
                before = getattr(self, name)
                setattr(self, name, values if before is None else [v for v in before if v in values])
            yield f

    def partitions(self):
        if self.states == [] or self.ids == []:
            return []
        own = _client(self.options)
        if self.ids is not None and hasattr(own, "by_ids"):
            step = max(1, getattr(own, "BATCH", 1))
            return [Pages(s, None, self.ids[k : k + step]) for s in self.scopes for k in range(0, len(self.ids), step)]
        count = getattr(own, "page_count", None)
        if count is None:
            return [Pages(s, None) for s in self.scopes]
        return [Pages(s, page) for s in self.scopes for page in range(count(s, self.states))]

    def read(self, partition):
        own, cursor = _client(self.options), partition.cursor
        name = getattr(own, "record_id", lambda r: r.get("id"))
        state = getattr(own, "record_state", lambda r, _: r.get("state"))
        row = lambda r: (partition.scope, name(r), state(r, partition.scope), json.dumps(r))
        if partition.ids is not None:
            yield from map(row, own.by_ids(partition.scope, partition.ids))
            return
        paged = hasattr(own, "page_count")
        while True:
            records, following = own.pages(partition.scope, self.states, cursor)
            yield from map(row, records)
            if paged or following is None:
                return
            if following == "" or following == cursor:
                raise PagingError(f"scope {partition.scope}: a next page without a cursor")
            cursor = following


class TrackerSource(DataSource):
    """Raw records: scope, id, state and the record as JSON text."""

    @classmethod
    def name(cls):
        return "tracker"

    def schema(self):
        return "scope string, id string, state string, record string"

    def reader(self, schema):
        return _Reader(self.options)


#: The kinds of trackers that normalizers exist for.
KINDS = (*CLIENTS, "memory")


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TrackerSource)


def memory(spark: SparkSession, items, schema: str) -> DataFrame:
    """In-memory source: rows that aren't mappings are ignored."""
    return spark.createDataFrame([i for i in items if isinstance(i, dict)], schema)
