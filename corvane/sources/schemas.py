"""The declared tables, and older or wider ones brought to that form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

#: The tables with their columns in order.
TABLES = {
    "holons": "id string, type string, kind string, layer string, title string, content string, context_id string, scope string, parent_id string, cached_r_score double, created_at timestamp_ntz, updated_at timestamp_ntz",
    "evidence": "id string, holon_id string, type string, content string, verdict string, assurance_level string, carrier_ref string, valid_until timestamp_ntz, created_at timestamp_ntz",
    "relations": "source_id string, target_id string, relation_type string, congruence_level int, created_at timestamp_ntz",
    "characteristics": "id string, holon_id string, name string, scale string, value string, unit string, created_at timestamp_ntz",
    "work_records": "id string, method_ref string, performer_ref string, started_at timestamp_ntz, ended_at timestamp_ntz, resource_ledger string, created_at timestamp_ntz",
    "audit_log": "id string, timestamp timestamp_ntz, tool_name string, operation string, actor string, target_id string, input_hash string, result string, details string, context_id string",
    "waivers": "id string, evidence_id string, waived_by string, waived_until timestamp_ntz, rationale string, created_at timestamp_ntz",
    "state": "context_id string, active_role string, active_session_id string, active_role_context string, last_commit string, assurance_threshold double, updated_at timestamp_ntz",
}
#: What a column has where a row comes without it.
DEFAULTS = {
    "holons": {"cached_r_score": 0.0}, "relations": {"congruence_level": 3}, "audit_log": {"context_id": "default"}, "state": {"assurance_threshold": 0.8},
}
#: The columns by which a row is known.
KEYS = {"relations": ["source_id", "target_id", "relation_type"], "state": ["context_id"]}
#: The instants that a new row gets.
STAMPS = ("created_at", "updated_at", "timestamp")


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])


def keys(name: str) -> list[str]:
    return KEYS.get(name, ["id"])


def conformed(df: DataFrame, name: str, at: Column | None = None) -> DataFrame:
    """df with the columns of the table `name`, in order and type. A column that is missing gets its default, or null; with `at`
    a missing stamp gets that instant. Further columns are dropped."""
    out = []
    for field in schema(name):
        if field.name in df.columns:
            value = F.col(field.name)
        elif at is not None and field.name in STAMPS:
            value = at
        else:
            value = F.lit(DEFAULTS.get(name, {}).get(field.name))
        out.append(value.cast(field.dataType).alias(field.name))
    return df.select(*out)
