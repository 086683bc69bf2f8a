"""Records of five trackers as work items, by column expressions over landed JSON.

Scans are lenient: malformed records are dropped and counted. Lookups are
strict: a malformed record fails the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, clean_labels, key_of, non_blank, parse_time, path_segment
from ..operators.dispatch import assigned_to, blocked_by_open, in_states, normal_set

_NO_BLOCKERS = "array<struct<id:string,identifier:string,state:string>>"


def _ref(**values: Column) -> Column:
    pairs = [x for k, v in values.items() for x in (F.lit(k), v.cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def linear(raw: DataFrame, terminal=("done", "closed", "cancelled", "canceled", "duplicate"), worker: str | None = None) -> DataFrame:
    """Blockers are the `blocks` links; a todo item with an open or unknown blocker isn't dispatchable."""
    links = F.filter("inverseRelations.nodes", lambda r: key_of(r["type"]) == "blocks")
    blockers = F.transform(links, lambda r: F.struct(r["issue"]["id"].alias("id"), r["issue"]["identifier"].alias("identifier"), r["issue"]["state"]["name"].alias("state")))
    blockers = F.coalesce(blockers, F.array().cast(_NO_BLOCKERS))
    waits = (key_of(F.col("state.name")) == "todo") & blocked_by_open(blockers, terminal)
    return raw.select(
        "id", _ref(id=F.col("id")).alias("native_ref"), "identifier", "title", "description", "priority", F.col("state.name").alias("state"),
        F.col("branchName").alias("branch_name"), "url", F.col("assignee.id").alias("assignee_id"), blockers.alias("blocked_by"),
        clean_labels(F.transform("labels.nodes", lambda n: n["name"])).alias("labels"),
        (assigned_to(F.col("assignee.id"), worker) & ~F.coalesce(waits, F.lit(False))).alias("dispatchable"),
        parse_time(F.col("createdAt")).alias("created_at"), parse_time(F.col("updatedAt")).alias("updated_at"),
    )


def github(raw: DataFrame, worker: str | None = None) -> DataFrame:
    """The number is the id; pull requests aren't dispatchable."""
    number = F.col("number").cast("string")
    return raw.select(
        number.alias("id"), _ref(number=F.col("number"), id=F.col("id"), node_id=F.col("node_id")).alias("native_ref"),
        F.concat(F.lit("GH-"), number).alias("identifier"), "title", F.col("body").alias("description"), _none("bigint").alias("priority"), "state",
        _none("string").alias("branch_name"), F.col("html_url").alias("url"), F.col("assignee.login").alias("assignee_id"),
        F.array().cast(_NO_BLOCKERS).alias("blocked_by"), clean_labels(F.transform("labels", lambda n: n["name"])).alias("labels"),
        (F.col("pull_request").isNull() & assigned_to(F.col("assignee.login"), worker)).alias("dispatchable"),
        parse_time(F.col("created_at")).alias("created_at"), parse_time(F.col("updated_at")).alias("updated_at"),
    )


def gitlab(raw: DataFrame, worker: str | None = None) -> DataFrame:
    """The project's number is the id; the first assignee counts, else the single one."""
    iid = F.col("iid").cast("string")
    first = F.get("assignees", F.lit(0))
    who = F.coalesce(first["username"], first["id"].cast("string"), F.col("assignee.username"), F.col("assignee.id").cast("string"))
    return raw.select(
        iid.alias("id"), _ref(iid=F.col("iid"), id=F.col("id"), project_id=F.col("project_id")).alias("native_ref"),
        F.concat(F.lit("GL-"), iid).alias("identifier"), "title", "description", _none("bigint").alias("priority"), "state",
        _none("string").alias("branch_name"), F.col("web_url").alias("url"), who.alias("assignee_id"), F.array().cast(_NO_BLOCKERS).alias("blocked_by"),
        clean_labels(F.col("labels")).alias("labels"), assigned_to(who, worker).alias("dispatchable"),
        parse_time(F.col("created_at")).alias("created_at"), parse_time(F.col("updated_at")).alias("updated_at"),
    )


def jira(raw: DataFrame, base_url: str = "", terminal=("done",), worker: str | None = None) -> DataFrame:
    """A new item waits for all its blockers to end; its URL is built from its key."""
    f = F.col("fields")
    links = F.filter(f["issuelinks"], lambda r: (key_of(r["type"]["name"]) == "blocks") & r["inwardIssue"].isNotNull())
    blockers = F.transform(links, lambda r: F.struct(r["inwardIssue"]["id"].alias("id"), r["inwardIssue"]["key"].alias("identifier"), r["inwardIssue"]["fields"]["status"]["name"].alias("state")))
    blockers = F.coalesce(blockers, F.array().cast(_NO_BLOCKERS))
    category, state = key_of(f["status"]["statusCategory"]["key"]), key_of(f["status"]["name"])
    fresh = F.when(category.isNotNull(), category == "new").otherwise(state.isin("todo", "to do"))
    who = f["assignee"]["accountId"]
    return raw.select(
        "id", _ref(id=F.col("id"), key=F.col("key"), project_key=f["project"]["key"]).alias("native_ref"), F.col("key").alias("identifier"),
        f["summary"].alias("title"), rich_text(f["description"]).alias("description"), _none("bigint").alias("priority"), f["status"]["name"].alias("state"),
        _none("string").alias("branch_name"), F.concat(F.lit(base_url.rstrip("/") + "/browse/"), path_segment(F.col("key"))).alias("url"),
        who.alias("assignee_id"), blockers.alias("blocked_by"), clean_labels(f["labels"]).alias("labels"),
        (assigned_to(who, worker) & ~(F.coalesce(fresh, F.lit(False)) & blocked_by_open(blockers, terminal))).alias("dispatchable"),
        parse_time(f["created"]).alias("created_at"), parse_time(f["updated"]).alias("updated_at"),
    )


def asana(raw: DataFrame, project: str, worker: str | None = None) -> DataFrame:
    """The state is the section of the project's membership; done tasks and sections aren't dispatchable."""
    own = F.get(F.filter("memberships", lambda m: m["project"]["gid"] == project), F.lit(0))
    open_ = F.coalesce(F.col("completed") == F.lit(False), F.lit(False)) & ~F.col("resource_subtype").eqNullSafe("section")
    return raw.select(
        F.col("gid").alias("id"), _ref(gid=F.col("gid"), section_gid=own["section"]["gid"], project_gid=own["project"]["gid"]).alias("native_ref"),
        F.concat(F.lit("ASANA-"), F.col("gid")).alias("identifier"), F.col("name").alias("title"), F.col("notes").alias("description"), _none("bigint").alias("priority"),
        own["section"]["name"].alias("state"), _none("string").alias("branch_name"), F.col("permalink_url").alias("url"), F.col("assignee.gid").alias("assignee_id"),
        F.array().cast(_NO_BLOCKERS).alias("blocked_by"), clean_labels(F.transform("tags", lambda t: t["name"])).alias("labels"),
        (open_ & assigned_to(F.col("assignee.gid"), worker)).alias("dispatchable"),
        parse_time(F.col("created_at")).alias("created_at"), parse_time(F.col("modified_at")).alias("updated_at"),
    )


def rich_text(document: Column) -> Column:
    """Plain text of a rich-text tree given as JSON text; other text as it is.

    Trees nest without bound, which expressions can't follow: an Arrow-batched function.
    """
    import json

    import pandas as pd

    def text(node) -> str:
        if isinstance(node, list):
            return "".join(map(text, node))
        if not isinstance(node, dict):
            return ""
        kind = node.get("type")
        if kind == "text":
            return str(node.get("text") or "")
        if kind == "hardBreak":
            return "\n"
        inner = text(node.get("content") or [])
        return inner + "\n" if kind in ("paragraph", "heading", "listItem", "codeBlock", "blockquote") else inner

    def flat(x):
        if x is None:
            return None
        try:
            node = json.loads(x)
        except ValueError:
            return x
        return (text(node).strip() or None) if isinstance(node, (dict, list)) else x

    def run(s: pd.Series) -> pd.Series:
        return s.map(flat, na_action="ignore")

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(document)


def well_formed() -> Column:
    return non_blank(F.col("id")) & non_blank(F.col("identifier")) & non_blank(F.col("title")) & non_blank(F.col("state"))


def scan(items: DataFrame, states, observation: Observation | None = None) -> DataFrame:
    """Well-formed items in the states; the observation counts malformed ones."""
    if not normal_set(states):
        return items.limit(0)
    if observation is not None:
        items = items.observe(observation, F.count_if(~well_formed()).alias("malformed"))
    return items.where(well_formed() & in_states(F.col("state"), states))


def lookup(items: DataFrame, requested: DataFrame, strict: bool = True) -> DataFrame:
    """Items of requested(pos, id), with pos; one request for an id is enough. A malformed item fails a strict lookup."""
    first = blank_to_null(F.col("id"))
    ids = requested.withColumn("id", first).where("id IS NOT NULL").groupBy("id").agg(F.min("pos").alias("pos"))
    found = items.join(ids, "id")
    if not strict:
        return found.where(well_formed())
    checked = F.when(well_formed(), F.col("id")).otherwise(F.raise_error(F.concat(F.lit("malformed item "), F.coalesce("id", F.lit("?")))))
    return found.withColumn("id", checked)
