"""Schemas of the collections and the normalisation of records that disagree with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLLECTIONS = {
    "users": "user_id STRING, email STRING, hashed_password STRING, role STRING, status STRING, full_name STRING, enabled_apis MAP<STRING,BOOLEAN>, created_at TIMESTAMP",
    "tenants": "tenant_id STRING, name STRING, billing_tier STRING, contact_email STRING, status STRING, created_at TIMESTAMP",
    "projects": "project_id STRING, project_name STRING, type STRING, user_id STRING, tenant_id STRING, description STRING, created_at TIMESTAMP",
    "api_keys": "key_id STRING, tenant_id STRING, name STRING, project_name STRING, prefix STRING, hashed_key STRING, cost_center STRING, allowed_aliases ARRAY<STRING>, "
    "rpm_limit BIGINT, tpm_limit BIGINT, concurrency_limit BIGINT, status STRING, created_at TIMESTAMP, expires_at TIMESTAMP",
    "key_requests": "request_id STRING, tenant_id STRING, requested_by STRING, justification STRING, rpm_limit BIGINT, tpm_limit BIGINT, concurrency_limit BIGINT, "
    "status STRING, approved_key_id STRING, rejection_reason STRING, created_at TIMESTAMP, updated_at TIMESTAMP",
    "aliases": "alias_name STRING, target_model STRING, runtime STRING, min_vram_gb BIGINT, status STRING, description STRING, updated_at TIMESTAMP",
    "endpoints": "endpoint_id STRING, path STRING, method STRING, name STRING, status STRING, description STRING, updated_at TIMESTAMP",
    "jobs": "job_id STRING, job_type STRING, alias_name STRING, status STRING, progress BIGINT, error_message STRING, result_urls ARRAY<STRING>, created_at TIMESTAMP, updated_at TIMESTAMP",
    "models": "model_id STRING, name STRING, provider STRING, context_window BIGINT, input_price_per_1k DECIMAL(12,6), output_price_per_1k DECIMAL(12,6), status STRING",
    "payments": "txn_ref STRING, date TIMESTAMP, status STRING, amount BIGINT, package STRING, project STRING, txn_no STRING",
    "audit_logs": "log_id STRING, timestamp TIMESTAMP, actor STRING, action STRING, resource STRING, details STRING, ip_address STRING",
    "api_logs": "timestamp TIMESTAMP, api STRING, request_id STRING, status BIGINT, latency_ms DOUBLE, client_ip STRING",
    "notifications": "user_id STRING, type STRING, category STRING, title STRING, description STRING, name STRING, phone STRING, email STRING, message STRING, created_at TIMESTAMP",
    "webhooks": "webhook_id STRING, tenant_id STRING, url STRING, created_at TIMESTAMP",
    "sessions": "session_id STRING, user_id STRING, created_at TIMESTAMP",
    "rate_limits": "policy_id STRING, rpm_limit BIGINT, tpm_limit BIGINT, concurrency_limit BIGINT",
}

CHAT_REQUEST = (
    "model STRING, messages ARRAY<STRUCT<role: STRING, content: STRING, name: STRING>>, temperature DOUBLE, top_p DOUBLE, n BIGINT, stream BOOLEAN, max_tokens BIGINT, user STRING"
)

#: Other names under which writers store a field.
SYNONYMS = {"project_name": ["name"], "target_model": ["model_name"], "runtime": ["provider"]}
STATUS_WORDS = {"active": "enabled", "inactive": "disabled"}


def normalise(rows: DataFrame, collection: str, status_words: dict[str, str] | None = None) -> DataFrame:
    """rows in the collection's schema: synonyms merged, text times parsed, missing fields null, others dropped."""
    out = []
    for field in rows.sparkSession.createDataFrame([], COLLECTIONS[collection]).schema:
        names = [c for c in [field.name, *SYNONYMS.get(field.name, [])] if c in rows.columns]
        value = F.coalesce(*(F.col(c) for c in names)) if names else F.lit(None)
        kind = field.dataType.simpleString()
        if kind == "timestamp" and names and dict(rows.dtypes)[names[0]] == "string":
            value = F.try_to_timestamp(value)
        if field.name == "status" and status_words and names:
            value = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in status_words.items() for x in p)), value), value)
        out.append(value.cast(kind).alias(field.name))
    return rows.select(*out)
