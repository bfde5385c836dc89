"""A planned run to its gate: executions, attempts, findings, facts, aggregates, counters, one lazy plan."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import canonical as C
from ..functions import evaluators as E
from ..functions.scores import normalize, raw_parts
from ..operators import aggregate as A
from ..operators.lookup import authoritative
from ..operators.routing import persisted
from ..operators.state import completed_events, finalize_run
from ..schemas import conform

#: What an agent's attempts hold: one row an attempt of a case.
OUTPUTS = "case_id string, attempt_no int, status string, text string, structured string, tool_calls string, agent_latency_ms bigint, token_usage string"

Builder = Callable[[dict[str, Any], str], Column]


def at(path: str, kind: str = "string") -> Column:
    """A configured path ($.expected..., $.actual.structured..., $.actual.tool_calls, $.actual.text, $.input...) over the columns of a bound case: resolved when the plan is made."""
    if path == "$.actual.text":
        return F.col("text")
    for root, column in (("$.expected", "expected"), ("$.actual.structured", "structured"), ("$.actual.tool_calls", "tool_calls"), ("$.input", "input"), ("$.context", "context")):
        if path == root:
            return C.canonical_json(F.col(column))
        if path.startswith((root + ".", root + "[")):
            return C.at_path(F.col(column), "$" + path[len(root) :], kind)
    raise ValueError(f"no such path: {path}")


def _strings(path: str | None) -> Column:
    empty = F.array().cast("array<string>")
    return F.coalesce(F.from_json(F.to_json(at(path, "variant")), "array<string>"), empty) if path else empty


def _calls(path: str) -> Column:
    return F.coalesce(F.from_json(at(path, "string") if path == "$.actual.tool_calls" else F.to_json(at(path, "variant")), E.CALLS), F.array().cast(E.CALLS))


def _lexicon(c: dict[str, Any], dimension: str) -> Column:
    words = {k: tuple(c.get(k) or v) for k, v in (("positive", E.POSITIVE), ("negative", E.NEGATIVE))}
    text = E.evaluated_text(F.col("text"), C.at_path(F.col("input"), "$.user_message"))
    one = F.transform(F.array(F.struct(text.alias("text"), E.lexicon_hits(text, **words).alias("hits"))), lambda x: E.sentiment_finding(x.text, x.hits, **words))[0]
    return one.withField("dimension", F.lit(dimension))


def _numbers(c: dict[str, Any]) -> tuple[Column, Column]:
    return at(c["actual_path"], "double"), at(c["expected_path"], "double")


def _told(found: Column, value: Column) -> Column:
    return F.when(found.isNotNull(), value)


#: Evaluators that are column expressions, by namespace/name: a configuration and a dimension -> a finding.
NATIVE: dict[str, Builder] = {
    "core/sentiment-basic-en": _lexicon,
    "core/exact-label-match": lambda c, d: E.judged(d, E.exact_label(at(c["actual_path"]), at(c["expected_path"]))),
    "core/json-schema": lambda c, d: E.judged(d, E.json_schema(F.col("structured"), c["schema"]).cast("double")),
    "core/tool-call-schema": lambda c, d: E.judged(d, E.tool_call_schema(at(c.get("actual_path", "$.actual.tool_calls"))).cast("double")),
    "core/tool-call-match": lambda c, d: E.judged(d, E.partial_arguments_match(_calls(c.get("actual_path", "$.actual.tool_calls")), _calls(c.get("expected_path", "$.expected.tool_calls")))),
    "core/refusal-policy": lambda c, d: E.judged(d, E.refusal_policy(F.col("text"), at(c["expected_path"]) == "refusal")),
    "core/helpful-alternative": lambda c, d: E.judged(d, E.helpful_alternative(F.col("text"))),
    "core/concept-adherence": lambda c, d: E.judged(d, E.concept_adherence(F.col("text"), _strings(c.get("required_concepts_path")), _strings(c.get("prohibited_concepts_path")))),
    "core/absolute-error": lambda c, d: E.judged(d, E.absolute_error(*_numbers(c), c["max_error"]), least=c.get("least", 0.0)),
    "core/within-tolerance": lambda c, d: E.judged(d, _told(_numbers(c)[0] + _numbers(c)[1], E.within_percent(*_numbers(c), c["tolerance_percent"]).cast("double"))),
}


def findings(bound: DataFrame, bindings: list[dict[str, Any]], evaluators: dict[str, Builder]) -> Column:
    """Each bound case's findings: that of the evaluator which the row's binding names. A profile's bindings are known when the plan is made."""
    out = None
    for b in bindings:
        name = b["evaluator_id"].rpartition(":")[0]
        if name in evaluators:
            one = F.array(evaluators[name](json.loads(b["config"] or "{}"), b["dimension"]).cast(E.FINDING))
        else:
            one = F.array(E.finding(b["dimension"], F.lit("error"), E._score("informational"), category=F.lit("unknown_evaluator"), reason=F.lit(f"no evaluator {b['evaluator_id']}")))
        mine = (F.col("group_id") == b["group_id"]) & (F.col("binding_no") == b["binding_no"])
        out = F.when(mine, one) if out is None else out.when(mine, one)
    return F.array().cast(f"array<{E.FINDING}>") if out is None else out


def evaluate_run(plan: dict[str, Any], outputs: DataFrame, now: str, evaluators: dict[str, Builder] | None = None) -> dict[str, DataFrame]:
    """The tables that a run leaves: executions, execution_attempts, evaluator_results, execution_aggregates, runs and outbox_events (run.completed).

    outputs (OUTPUTS) are the agent's attempts. A case whose last attempt did not complete is retried while the
    profile's max_attempts allow it, and failed after that; a case without an attempt is pending.
    """
    s, run_id, when = plan["settings"], plan["run_id"], F.lit(now).cast("timestamp")
    stamped = {"created_at": when, "updated_at": when}
    execution, attempt = C.stable_id(F.lit(run_id), F.col("case_id")), C.stable_id(F.lit(run_id), F.col("case_id"), F.col("attempt_no"))
    tries = outputs.select(F.struct("*").alias("o"), attempt.alias("id"), execution.alias("execution_id"), "attempt_no", "status")
    last = authoritative(tries).select("execution_id", F.col("id").alias("attempt_id"), "attempt_no", F.col("status").alias("attempt_status"), "o.text", "o.structured", "o.tool_calls")

    bound = plan["bound"].withColumn("execution_id", execution).join(last.where("attempt_status = 'completed'"), "execution_id")
    bindings = [r.asDict() for r in plan["bindings"].withColumn("evaluator_id", C.binding_identifier(F.col("ref"))).collect()]
    of = findings(bound, bindings, NATIVE if evaluators is None else evaluators)
    keep = ("execution_id", "attempt_id", "evaluator_id", "group_id", "weight", F.col("blocking").alias("bound_blocking"), "binding_no")
    facts = bound.select(*keep, F.posexplode(of).alias("finding_no", "f"))
    parts = raw_parts(F.col("f.score"))
    profile = plan["runs"].select("evaluation_profile_id", "evaluation_profile_version").first()
    facts = facts.select(
        C.stable_id(F.col("attempt_id"), F.col("evaluator_id"), F.col("binding_no"), F.col("finding_no")).alias("id"),
        *("execution_id", "attempt_id", "evaluator_id", "group_id", "finding_no", "weight"),
        *[F.col(f"f.{n}").alias(n) for n in ("dimension", "status", "severity", "failure_category", "reason", "evidence")],
        (F.col("f.blocking") | F.col("bound_blocking")).alias("blocking"),
        F.col("f.score.kind").alias("score_kind"),
        parts["raw"].alias("raw_score"),
        parts["low"].alias("raw_score_min"),
        parts["high"].alias("raw_score_max"),
        normalize(F.col("f.score")).alias("normalized_score"),
        F.to_json("f").alias("raw_evaluator_output"),
    )
    dims = A.dimension_scores(facts, "execution_id", "attempt_id", rules=plan["rules"])
    per = A.execution_aggregates(dims, "execution_id", "attempt_id", min_score=s["min_execution_score"], fail_on_blocking=s["fail_on_any_blocking_failure"])
    blocked = A.blocking_failures(facts, "execution_id")

    counts = plan["bindings"].groupBy("group_id").agg(F.count("*").cast("int").alias("expected_evaluator_count"))
    manifest = plan["bindings"].groupBy("group_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("binding_no", "ref", "dimension", "weight")))).alias("evaluator_manifest"))
    routed = plan["routed"].withColumn("execution_id", execution).join(last.select("execution_id", "attempt_id", "attempt_no", "attempt_status"), "execution_id", "left")
    routed = routed.join(per.select("execution_id", "overall_status"), "execution_id", "left").join(counts, "group_id", "left").join(manifest, "group_id", "left")
    retry = F.col("attempt_no") < s["max_attempts"]
    broke = F.coalesce(F.col("attempt_status") != "completed", F.lit(False))
    status = F.when(F.col("attempt_no").isNull(), "pending").when(broke & retry, "retry_scheduled").when(broke, "failed").otherwise("completed")
    # of an execution that will not be tried again: no group applies to a skipped one, a failed one is an error
    outcome = F.when(F.col("group_id").isNull(), "skipped").when(status == "failed", "error").when(status == "completed", F.coalesce("overall_status", F.lit("skipped")))
    routed = routed.withColumns({"status": F.when(F.col("group_id").isNull(), "completed").otherwise(status), "outcome": outcome})
    executions = routed.select(
        F.col("execution_id").alias("id"), F.lit(run_id).alias("run_id"), "case_id", "case_hash", F.coalesce("group_id", F.lit("unmatched")).alias("profile_group_id"), "task_type", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.col("input").alias("input_payload"), F.coalesce("expected", F.lit("null")).alias("expected_output"), F.col("metadata").alias("case_metadata"), F.lit(profile[0]).alias("evaluation_profile_id"), F.lit(profile[1]).alias("evaluation_profile_version"),
        F.coalesce("evaluator_manifest", F.lit("[]")).alias("evaluator_manifest"), F.coalesce("expected_evaluator_count", F.lit(0)).alias("expected_evaluator_count"), "status", F.coalesce("attempt_no", F.lit(0)).alias("current_attempt_no"), F.col("attempt_id").alias("current_attempt_id"), when.alias("created_at"), when.alias("updated_at"),
    )
    attempts = tries.select("id", "execution_id", F.lit(run_id).alias("run_id"), "attempt_no", "status", "o.agent_latency_ms", F.col("o.agent_latency_ms").alias("total_latency_ms"), F.coalesce("o.token_usage", F.lit("{}")).alias("token_usage"), F.lit("{}").alias("outcome_summary"), when.alias("created_at"), when.alias("updated_at"))
    results = persisted(facts, s["persist_raw_outputs"], s["persist_evaluator_evidence"], s["mode"]).withColumns({
        "run_id": F.lit(run_id), "evaluator_version": F.substring_index("evaluator_id", ":", -1), "evaluator_profile_id": F.lit(profile[0]), "evaluator_profile_version": F.lit(profile[1]),
        "evidence": F.coalesce("evidence", F.lit("null")), "raw_evaluator_output": F.coalesce("raw_evaluator_output", F.lit("null")), "created_at": when,
    })
    aggregates = per.join(blocked, "execution_id").select(
        "execution_id", F.lit(run_id).alias("run_id"), "attempt_id", "overall_status", "aggregate_score", F.col("evaluator_result_count").cast("int").alias("evaluator_result_count"),
        F.to_json("dimension_scores").alias("dimension_scores"), F.to_json("blocking_failures").alias("blocking_failures"), F.to_json(F.struct("n_blocking", "n_error", "n_judged")).alias("summary"), when.alias("created_at"), when.alias("updated_at"),
    )
    counters = A.gate(A.run_counters(routed.withColumn("run_id", F.lit(run_id)), "run_id", status="outcome"))
    running = plan["runs"].withColumn("status", F.when(F.col("status") == "pending", "running").otherwise(F.col("status")))
    runs = finalize_run(running, counters, now)
    return {
        "executions": conform(executions, "executions"),
        "execution_attempts": conform(attempts, "execution_attempts"),
        "evaluator_results": conform(results, "evaluator_results"),
        "execution_aggregates": conform(aggregates, "execution_aggregates"),
        "runs": runs,
        "outbox_events": conform(completed_events(running, runs, now).withColumns(stamped), "outbox_events"),
        "counters": counters,
        "outcomes": routed.select("case_id", "group_id", "status", "outcome"),
        "dimensions": dims,
    }


def run_status(runs: DataFrame, run_id: str) -> DataFrame:
    """One run's state and counts; no row if there is no such run."""
    n = F.col("expected_execution_count")
    return runs.where(F.col("id") == run_id).select("id", "status", "gate_status", "expected_execution_count", "terminal_execution_count", "passed_execution_count", "failed_execution_count", "errored_execution_count", F.round(F.when(n > 0, F.col("terminal_execution_count") / n), 6).alias("progress"))


def run_report(executions: DataFrame, aggregates: DataFrame, run_id: str) -> DataFrame:
    """One row an execution of the run: its case, state, overall status and score."""
    mine = executions.where(F.col("run_id") == run_id).select(F.col("id").alias("execution_id"), "case_id", "status", "current_attempt_no")
    return mine.join(aggregates.select("execution_id", "overall_status", "aggregate_score", "evaluator_result_count"), "execution_id", "left")
