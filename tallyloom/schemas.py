"""Schemas of work items, runtime events and scheduler state tables."""

WORK_ITEM = (
    "id STRING, native_ref MAP<STRING,STRING>, identifier STRING, title STRING, description STRING, priority BIGINT, "
    "state STRING, branch_name STRING, url STRING, assignee_id STRING, "
    "blocked_by ARRAY<STRUCT<id:STRING, identifier:STRING, state:STRING>>, labels ARRAY<STRING>, dispatchable BOOLEAN, "
    "created_at TIMESTAMP, updated_at TIMESTAMP"
)
RUNTIME_EVENT = "issue_id STRING, seq BIGINT, event STRING, ts TIMESTAMP, session_id STRING, pid STRING, usage STRING, payload STRING, raw STRING"
RUNNING = (
    "issue_id STRING, identifier STRING, issue_url STRING, state STRING, worker_host STRING, workspace_path STRING, "
    "session_id STRING, pid STRING, input_tokens BIGINT, output_tokens BIGINT, total_tokens BIGINT, turn_count BIGINT, "
    "started_at TIMESTAMP, last_ts TIMESTAMP, last_message STRING, last_event STRING"
)
RETRYING = "issue_id STRING, identifier STRING, issue_url STRING, attempt BIGINT, due_at_ms BIGINT, error STRING, worker_host STRING, workspace_path STRING"
BLOCKED = (
    "issue_id STRING, identifier STRING, issue_url STRING, state STRING, worker_host STRING, workspace_path STRING, "
    "session_id STRING, error STRING, blocked_at TIMESTAMP, last_ts TIMESTAMP, last_message STRING, last_event STRING"
)
TOKEN_SAMPLE = "pos INT, ts_ms BIGINT, total BIGINT"

LINEAR = (
    "id STRING, identifier STRING, title STRING, description STRING, priority BIGINT, state STRUCT<name:STRING>, branchName STRING, "
    "url STRING, assignee STRUCT<id:STRING>, labels STRUCT<nodes:ARRAY<STRUCT<name:STRING>>>, "
    "inverseRelations STRUCT<nodes:ARRAY<STRUCT<type:STRING, issue:STRUCT<id:STRING, identifier:STRING, state:STRUCT<name:STRING>>>>>, "
    "createdAt STRING, updatedAt STRING"
)
GITHUB = (
    "number BIGINT, id BIGINT, node_id STRING, title STRING, body STRING, state STRING, html_url STRING, assignee STRUCT<login:STRING>, "
    "labels ARRAY<STRUCT<name:STRING>>, pull_request STRUCT<url:STRING>, created_at STRING, updated_at STRING"
)
GITLAB = (
    "iid BIGINT, id BIGINT, project_id BIGINT, title STRING, description STRING, state STRING, web_url STRING, "
    "assignees ARRAY<STRUCT<id:BIGINT, username:STRING>>, assignee STRUCT<id:BIGINT, username:STRING>, labels ARRAY<STRING>, "
    "references MAP<STRING,STRING>, created_at STRING, updated_at STRING"
)
JIRA = (
    "id STRING, key STRING, fields STRUCT<summary:STRING, description:STRING, "
    "status:STRUCT<name:STRING, statusCategory:STRUCT<key:STRING>>, labels:ARRAY<STRING>, assignee:STRUCT<accountId:STRING>, "
    "created:STRING, updated:STRING, project:STRUCT<key:STRING>, "
    "issuelinks:ARRAY<STRUCT<type:STRUCT<name:STRING>, inwardIssue:STRUCT<id:STRING, key:STRING, fields:STRUCT<status:STRUCT<name:STRING>>>>>>"
)
ASANA = (
    "gid STRING, name STRING, notes STRING, completed BOOLEAN, resource_subtype STRING, assignee STRUCT<gid:STRING>, "
    "tags ARRAY<STRUCT<name:STRING>>, memberships ARRAY<STRUCT<project:STRUCT<gid:STRING>, section:STRUCT<gid:STRING, name:STRING>>>, "
    "permalink_url STRING, created_at STRING, modified_at STRING"
)
