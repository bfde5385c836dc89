"""Evaluator inputs and outputs as JSON documents and as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import ENUMS
from .canonical import canonical_json, json_payload, optional_payload
from .evaluators import FINDING

# The fields of an evaluator's input and output documents.
INPUT = (
    "run_id string, execution_id string, attempt_id string, "
    "case struct<id: string, task_type: string, case_group: string, input: variant, expected: variant, context: variant, tags: array<string>, metadata: variant>, "
    "actual struct<text: string, structured: variant, tool_calls: array<struct<name: string, arguments: variant, result: variant>>, trace: array<struct<kind: string, name: string, payload: variant>>, raw: variant, metadata: variant>, "
    "evaluator_config variant"
)
_SCORE = "struct<kind: string, passed: boolean, value: double, min: double, max: double, severity: string, outcome: string>"
OUTPUT = (
    "evaluator struct<namespace: string, name: string, version: string, content_hash: string, interface_version: string>, "
    f"results array<struct<dimension: struct<kind: string, value: string>, status: string, score: {_SCORE}, blocking: boolean, severity: string, failure_category: string, reason: string, evidence: variant, tags: array<string>>>, "
    "metadata variant"
)


def read_input(document: Column) -> Column:
    """An evaluator's input; a document that is no JSON raises."""
    return F.from_json(canonical_json(json_payload(document, "evaluator input").cast("string")), INPUT)


def payloads(i: Column) -> Column:
    """The input as evaluators get it: its JSON parts as canonical texts, absent optional ones null."""
    text = lambda v: F.coalesce(F.to_json(v), F.lit("{}"))
    optional = lambda v: F.nullif(F.to_json(v), F.lit("null"))
    c, a = i["case"], i["actual"]
    calls = F.transform(a.tool_calls, lambda t: F.struct(t["name"].alias("name"), text(t.arguments).alias("arguments_json"), optional(t.result).alias("result_json")))
    trace = F.transform(a.trace, lambda t: F.struct(t.kind.alias("kind"), t["name"].alias("name"), text(t.payload).alias("payload_json")))
    return F.struct(
        *[i[n].alias(n) for n in ("run_id", "execution_id", "attempt_id")],
        F.struct(*[c[n].alias(n) for n in ("id", "task_type", "case_group")], text(c.input).alias("input_json"), optional(c.expected).alias("expected_json"), optional(c.context).alias("context_json"), F.coalesce(c.tags, F.array().cast("array<string>")).alias("tags"), text(c.metadata).alias("metadata_json")).alias("test_case"),
        F.struct(a.text.alias("text"), optional(a.structured).alias("structured_json"), calls.alias("tool_calls"), trace.alias("trace"), text(a.raw).alias("raw_json"), text(a.metadata).alias("metadata_json")).alias("actual"),
        text(i.evaluator_config).alias("evaluator_config_json"),
    )


def known(value: Column, enum: str) -> Column:
    """The value if the enumeration has it; another one raises."""
    return F.when(value.isin(*ENUMS[enum]), value).otherwise(F.raise_error(F.concat(F.lit(f"unknown {enum}: "), F.coalesce(value, F.lit("none")))).cast("string"))


def dimension_name(dimension: Column) -> Column:
    """A dimension's stored text: its kind, or what `other` calls it."""
    return F.when(dimension.kind == "other", F.coalesce(dimension.value, F.lit("other"))).otherwise(known(dimension.kind, "dimension"))


def read_output(document: Column) -> Column:
    """An evaluator's output document: evaluator, results (array of findings) and metadata (canonical JSON). Unknown statuses, severities, score kinds and dimensions raise."""
    o = F.from_json(document, OUTPUT)

    def one(f: Column) -> Column:
        score = F.struct(known(f.score.kind, "score_kind").alias("kind"), *[f.score[n].alias(n) for n in ("passed", "value", "min", "max", "severity", "outcome")])
        return F.struct(
            dimension_name(f.dimension).alias("dimension"),
            known(f.status, "evaluation_status").alias("status"),
            score.alias("score"),
            F.coalesce(f.blocking, F.lit(False)).alias("blocking"),
            known(f.severity, "severity").alias("severity"),
            f.failure_category.alias("failure_category"),
            f.reason.alias("reason"),
            F.coalesce(F.to_json(f.evidence), F.lit("null")).alias("evidence"),
            F.coalesce(f.tags, F.array().cast("array<string>")).alias("tags"),
        ).cast(FINDING)

    results = F.transform(F.coalesce(o.results, F.array().cast(_results_type())), one)
    return F.struct(o.evaluator.alias("evaluator"), results.alias("results"), F.coalesce(F.to_json(o.metadata), F.lit("null")).alias("metadata"))


def _results_type() -> str:
    return OUTPUT[OUTPUT.index("results ") + len("results ") : OUTPUT.rindex(", metadata variant")]


def optional_json(text: Column) -> Column:
    return optional_payload(text)
