"""Schemas and defaults of the store's tables."""

from __future__ import annotations

from pyspark.sql.types import StructType

NOW = "CURRENT_TIMESTAMP"

# Column names and types of the tables the operators read and write.
TABLES = {
    "introspection_index": "id bigint, filepath string, symbol_type string, name string, lineno bigint, route_method string, "
    "route_path string, ag_tag string, description string, target_symbol string, relation_type string, unique_key_hash string, "
    "status string, discovered_at timestamp, last_seen_at timestamp, resolved_at timestamp, occurrences bigint, "
    "recurrence_count bigint, created_at timestamp, updated_at timestamp, mdata string",
    "introspection_index_embeddings": "id bigint, item_id bigint, model string, dim bigint, embedding binary, note string, created_at timestamp",
    "agent_self_review": "id bigint, agent_id bigint, review_cycle bigint, review_timestamp timestamp, review_text string, "
    "reviewer string, score double, status string, metadata string, created_at timestamp, updated_at timestamp",
    "agent_messages": "id bigint, sender_id bigint, receiver_id bigint, content string, msg_type string, metadata string, "
    "read boolean, created_at timestamp, updated_at timestamp",
    "system_events": "id bigint, timestamp timestamp, source string, event_type string, details string, created_at timestamp, updated_at timestamp",
    "lock_state": "lock_name string, value boolean, holder string, since timestamp, ttl_seconds bigint, expires_at timestamp, "
    "metadata string, created_at timestamp, updated_at timestamp",
    "lock_events": "id bigint, lock_name string, action string, holder string, metadata string, event_time timestamp",
    "file_snapshots": "id bigint, snapshot_id string, agent_id bigint, file_path string, file_hash string, snapshot_type string, "
    "created_at timestamp, updated_at timestamp",
    "patch_risk_evaluations": "id bigint, patch_id string, evaluated_at timestamp, risk_score double, human_required boolean, "
    "reboot_required boolean, is_safe_to_autoapply boolean, metadata string, created_at timestamp, updated_at timestamp",
    "patch_test_results": "id bigint, patch_id string, file_path string, syntax_ok boolean, script_tests_ok boolean, error_msg string, "
    "script_log string, tested_by string, tested_at timestamp, metadata string, created_at timestamp, updated_at timestamp",
    "patch_trust_assessments": "id bigint, patch_id string, ag_reference array<string>, trust_score double, trusted boolean, "
    "reason string, tested_by string, tested_at timestamp, metadata string, created_at timestamp, updated_at timestamp",
    "patch_file_versions": "id bigint, patch_id bigint, path string, version bigint, snapshot string, created_at timestamp",
    "patch_action_log": "id bigint, patch_id string, action_type string, target string, payload_preview string, status string, "
    "message string, execution_order bigint, timestamp timestamp, metadata string",
}

# Declared defaults.
DEFAULTS = {
    "introspection_index": {"symbol_type": "unknown", "lineno": 0, "status": "active", "discovered_at": NOW, "last_seen_at": NOW,
                            "occurrences": 1, "recurrence_count": 0, "created_at": NOW, "updated_at": NOW, "mdata": "{}"},
    "agent_self_review": {"review_timestamp": NOW, "reviewer": "self", "status": "pending", "metadata": "{}", "created_at": NOW, "updated_at": NOW},
    "agent_messages": {"msg_type": "info", "metadata": "{}", "read": False, "created_at": NOW, "updated_at": NOW},
    "lock_state": {"value": False, "ttl_seconds": 900, "metadata": "{}", "created_at": NOW, "updated_at": NOW},
    "lock_events": {"metadata": "{}", "event_time": NOW},
}


def table_schema(name: str) -> StructType:
    return StructType.fromDDL(TABLES[name])


def table_defaults(name: str) -> dict[str, object]:
    return dict(DEFAULTS.get(name, {}))
