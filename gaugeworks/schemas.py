"""Tables, enumerations and the constraints that are checked on write."""

from __future__ import annotations

from functools import reduce
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# The enumerations, in their declared order.
ENUMS: dict[str, tuple[str, ...]] = {
    "evaluator_state": ("active", "yanked", "deprecated", "disabled", "removed"),
    "evaluator_http_policy_action": ("allow", "deny"),
    "run_status": ("pending", "running", "finalizing", "completed", "failed", "cancelled"),
    "gate_status": ("unknown", "pass", "fail"),
    "execution_status": ("pending", "running", "awaiting_evaluators", "retry_scheduled", "completed", "failed", "timed_out", "cancelled"),
    "attempt_status": ("pending", "running", "completed", "failed_agent_call", "failed_evaluation", "timed_out", "cancelled", "stale"),
    "evaluation_status": ("passed", "failed", "error", "skipped"),
    "severity": ("none", "low", "medium", "high", "critical"),
    "outbox_status": ("pending", "published", "failed"),
    "chunk_status": ("pending", "leased", "completed", "failed", "cancelled"),
    "dimension": ("correctness", "format", "safety", "quality", "latency", "tool_use", "calibration", "other"),
    "preference": ("preferred", "tie", "not_preferred"),
    "score_kind": ("binary", "range", "normalized", "severity_mapped", "preference", "informational"),
    "aggregation_method": ("min_score", "weighted_mean"),
    "persistence_mode": ("full", "summary"),
    "raw_outputs": ("all", "failures_only", "none"),
}

SCORE = "struct<kind: string, passed: boolean, value: double, min: double, max: double, severity: string, outcome: string>"

# The columns of the tables. JSON columns are variants.
TABLES: dict[str, str] = {
    "evaluators": "id string not null, namespace string not null, name string not null, version string not null, content_hash string not null, wasm_bytes binary not null, wasm_size_bytes bigint not null, interface_name string, interface_version string, wit_world string, runtime string not null, runtime_version string not null, runtime_fingerprint string not null, description string, tags array<string> not null, metadata variant not null, state string not null, state_reason string, created_at timestamp not null, updated_at timestamp not null",
    "evaluator_http_policies": "id string not null, evaluator_id string not null, uri string not null, action string not null, created_at timestamp not null, updated_at timestamp not null",
    "dataset_versions": "dataset_version_id string not null, dataset_id string not null, dataset_version string not null, created_at timestamp not null, updated_at timestamp not null",
    "runs": "id string not null, run_key string not null, name string, description string, dataset_id string not null, dataset_version_id string not null, dataset_version string not null, evaluation_profile_id string not null, evaluation_profile_version string not null, profile_version_id string not null, profile_hash string not null, aggregation_policy_id string not null, aggregation_policy_version string not null, aggregation_policy_hash string not null, agent_provider string not null, agent_name string not null, agent_version string, prompt_config_id string not null, prompt_config_version string not null, config_snapshot variant not null, status string not null, gate_status string not null, coordinator_id string, coordinator_leased_until timestamp, coordinator_heartbeat_at timestamp, expected_execution_count int not null, terminal_execution_count int not null, passed_execution_count int not null, failed_execution_count int not null, errored_execution_count int not null, summary variant not null, error_message string, created_at timestamp not null, started_at timestamp, dispatched_at timestamp, finalized_at timestamp, completed_at timestamp, updated_at timestamp not null",
    "run_chunks": "id string not null, run_id string not null, dataset_version_id string not null, profile_group_id string not null, ordinal_start int not null, ordinal_end int not null, status string not null, leased_until timestamp, created_at timestamp not null, updated_at timestamp not null",
    "case_blobs": "case_hash string not null, task_type string not null, input_payload variant not null, expected_output variant not null, context_payload variant not null, tags array<string> not null, metadata variant not null, created_at timestamp not null",
    "dataset_version_cases": "dataset_version_id string not null, case_id string not null, case_ordinal int not null, case_hash string not null, created_at timestamp not null, updated_at timestamp not null",
    "executions": "id string not null, run_id string not null, case_id string not null, case_hash string not null, profile_group_id string not null, task_type string not null, tags array<string> not null, input_payload variant not null, expected_output variant not null, case_metadata variant not null, evaluation_profile_id string not null, evaluation_profile_version string not null, evaluator_manifest variant not null, expected_evaluator_count int not null, status string not null, current_attempt_no int not null, current_attempt_id string, last_error_message string, created_at timestamp not null, started_at timestamp, completed_at timestamp, updated_at timestamp not null",
    "execution_attempts": "id string not null, execution_id string not null, run_id string not null, attempt_no int not null, status string not null, worker_id string, worker_host string, queue_message_id string, leased_until timestamp, heartbeat_at timestamp, request_artifact_uri string, response_artifact_uri string, agent_latency_ms bigint, evaluator_latency_ms bigint, total_latency_ms bigint, token_usage variant not null, outcome_summary variant not null, error_message string, created_at timestamp not null, started_at timestamp, completed_at timestamp, updated_at timestamp not null",
    "execution_aggregates": "execution_id string not null, run_id string not null, attempt_id string not null, overall_status string not null, aggregate_score double, evaluator_result_count int not null, dimension_scores variant not null, blocking_failures variant not null, summary variant not null, created_at timestamp not null, updated_at timestamp not null",
    "evaluator_results": "id string not null, run_id string not null, execution_id string not null, attempt_id string not null, evaluator_id string not null, evaluator_version string not null, evaluator_profile_id string not null, evaluator_profile_version string not null, evaluator_interface_version string, evaluator_runtime_version string, finding_no int not null, dimension string not null, status string not null, blocking boolean not null, score_kind string not null, raw_score double, raw_score_min double, raw_score_max double, normalized_score double, weight double not null, severity string not null, failure_category string, reason string, evidence variant not null, raw_evaluator_output variant not null, created_at timestamp not null",
    "outbox_events": "id string not null, event_type string not null, aggregate_type string not null, aggregate_id string not null, dedupe_key string not null, payload variant not null, status string not null, available_at timestamp not null, published_at timestamp, error_message string, created_at timestamp not null, updated_at timestamp not null",
}

KEYS: dict[str, tuple[tuple[str, ...], ...]] = {
    "evaluators": (("id",), ("namespace", "name", "version"), ("namespace", "content_hash")),
    "evaluator_http_policies": (("id",), ("evaluator_id", "uri", "action")),
    "dataset_versions": (("dataset_version_id",),),
    "runs": (("id",), ("run_key",), ("id", "dataset_version_id")),
    "run_chunks": (("id",),),
    "case_blobs": (("case_hash",),),
    "dataset_version_cases": (("dataset_version_id", "case_id"), ("dataset_version_id", "case_ordinal")),
    "executions": (("id",), ("run_id", "case_id")),
    "execution_attempts": (("id",), ("execution_id", "attempt_no")),
    "execution_aggregates": (("execution_id",), ("attempt_id",)),
    "evaluator_results": (("id",), ("attempt_id", "evaluator_id", "finding_no")),
    "outbox_events": (("id",), ("dedupe_key",)),
}

#: child table and column -> parent table and column
FOREIGN: tuple[tuple[str, str, str, str], ...] = (
    ("evaluator_http_policies", "evaluator_id", "evaluators", "id"),
    ("runs", "dataset_version_id", "dataset_versions", "dataset_version_id"),
    ("run_chunks", "run_id", "runs", "id"),
    ("dataset_version_cases", "dataset_version_id", "dataset_versions", "dataset_version_id"),
    ("dataset_version_cases", "case_hash", "case_blobs", "case_hash"),
    ("executions", "run_id", "runs", "id"),
    ("execution_attempts", "execution_id", "executions", "id"),
    ("execution_aggregates", "execution_id", "executions", "id"),
    ("execution_aggregates", "attempt_id", "execution_attempts", "id"),
    ("evaluator_results", "attempt_id", "execution_attempts", "id"),
    ("evaluator_results", "execution_id", "executions", "id"),
    ("evaluator_results", "run_id", "runs", "id"),
)

CHECKS: dict[str, dict[str, str]] = {
    "evaluators": {"wasm_size_bytes": "wasm_size_bytes >= 0"},
    "runs": {"counts": "least(expected_execution_count, terminal_execution_count, passed_execution_count, failed_execution_count, errored_execution_count) >= 0"},
    "run_chunks": {"range": "ordinal_start >= 0 AND ordinal_end > ordinal_start"},
    "dataset_version_cases": {"ordinal": "case_ordinal >= 0"},
    "execution_attempts": {"attempt_no": "attempt_no > 0", "latency": "coalesce(least(agent_latency_ms, evaluator_latency_ms, total_latency_ms), 0) >= 0"},
    "execution_aggregates": {"score": "aggregate_score IS NULL OR (aggregate_score BETWEEN 0 AND 1)"},
    "evaluator_results": {"score": "normalized_score IS NULL OR (normalized_score BETWEEN 0 AND 1)", "weight": "weight >= 0"},
}


def schema(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])


def conform(df: DataFrame, table: str) -> DataFrame:
    """The table's declared columns, in order and of their types: JSON texts become variants, absent nullable columns null.

    A null in a column that may not be null, and a broken check, raise when the row is read.
    """
    declared, have = schema(table), {c.lower() for c in df.columns}
    if missing := [f.name for f in declared if not f.nullable and f.name not in have]:
        raise ValueError(f"{table} needs {', '.join(missing)}")
    kinds = dict(df.dtypes)

    def shaped(f) -> Column:
        kind = f.dataType.simpleString()
        if f.name not in have:
            return F.lit(None).cast(kind)
        return F.parse_json(f.name) if kind == "variant" and kinds[f.name] == "string" else F.col(f.name).cast(kind)

    out = df.select(*[shaped(f).alias(f.name) for f in declared])
    present = {f"{f.name} is not null": f"`{f.name}` IS NOT NULL" for f in declared if not f.nullable}
    return enforce(out, present | CHECKS.get(table, {}))


def create_all(spark: SparkSession, folder: str) -> dict[str, str]:
    """Empty Parquet tables under a folder, one for each name; the paths."""
    paths = {t: str(PurePosixPath(folder) / t) for t in TABLES}
    for t, path in paths.items():
        spark.createDataFrame([], schema(t)).write.mode("ignore").parquet(path)
    return paths


def rank(c: Column, enum: str) -> Column:
    """Place in the declared order; values outside it come after, by themselves."""
    values = ENUMS[enum]
    return F.coalesce(*[F.when(c == v, F.lit(i)) for i, v in enumerate(values)], F.lit(len(values)))


def violations(df: DataFrame, checks: dict[str, str], keys: tuple[tuple[str, ...], ...] = ()) -> DataFrame:
    """check, n: rows that break a row constraint, and surplus rows of a key. One aggregation for all row checks."""
    spark = df.sparkSession
    parts = []
    if checks:
        counted = df.agg(*[F.count_if(~F.coalesce(F.expr(e), F.lit(False))).alias(name) for name, e in checks.items()])
        parts.append(counted.select(F.inline(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("n")) for n in checks]))))
    for key in keys:
        per = df.groupBy(*key).agg(F.count("*").alias("c"))
        parts.append(per.agg(F.lit("unique(" + ",".join(key) + ")").alias("check"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n")))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "check string, n long")


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def enforce(df: DataFrame, checks: dict[str, str]) -> DataFrame:
    """The same rows; reading one that breaks a check raises."""
    ok = F.lit(True)
    for name, e in checks.items():
        ok = ok & F.when(F.coalesce(F.expr(e), F.lit(False)), True).otherwise(F.raise_error(F.lit(f"constraint {name} broken")).cast("boolean"))
    return df.where(ok)
