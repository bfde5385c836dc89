"""Which group a case belongs to, and which evaluators judge it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import binding_identifier


def applies(task_type: Column, tags: Column, group: str = "g") -> Column:
    c = lambda n: F.col(f"{group}.{n}")
    return (c("task_type") == task_type) & ((F.size(c("tags_any")) == 0) | F.arrays_overlap(c("tags_any"), tags)) & (F.size(F.array_except(c("tags_all"), tags)) == 0)


def route(cases: DataFrame, groups: DataFrame) -> DataFrame:
    """cases with group_id of the first group that applies, in profile order; null if none does.

    A profile's groups are a handful: they travel as one row per task type, so cases are never multiplied.
    """
    packed = groups.groupBy("task_type").agg(F.array_sort(F.collect_list(F.struct("group_no", "group_id", "tags_any", "tags_all"))).alias("groups_"))
    fits = lambda g: ((F.size(g.tags_any) == 0) | F.arrays_overlap(g.tags_any, F.col("tags"))) & (F.size(F.array_except(g.tags_all, F.col("tags"))) == 0)
    joined = cases.join(packed, "task_type", "left")  # a row a task type: Spark broadcasts it by its size
    return joined.withColumn("group_id", F.try_element_at(F.filter("groups_", fits), F.lit(1))["group_id"]).drop("groups_")


def bind(routed: DataFrame, bindings: DataFrame) -> DataFrame:
    """One row for each case and evaluator that its group binds. A profile's bindings travel as one row a group, broadcast if Spark finds them small."""
    b = bindings.withColumn("evaluator_id", binding_identifier(F.col("ref")))
    columns = [c for c in b.columns if c != "group_id"]
    packed = b.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("bindings_"))
    return routed.join(packed, "group_id").select(*routed.columns, F.inline("bindings_"))


def http_allowed(requests: DataFrame, policies: DataFrame) -> DataFrame:
    """requests (evaluator_id, uri) with allowed: some allow pattern fits and no deny pattern; without allow patterns, only deny counts."""
    rules = policies.groupBy("evaluator_id").agg(*[F.collect_list(F.when(F.col("action") == a, F.col("uri"))).alias(a) for a in ("allow", "deny")])
    empty = F.array().cast("array<string>")
    fits = lambda c: F.exists(F.coalesce(F.col(c), empty), lambda p: (p == F.col("uri")) | F.rlike(F.col("uri"), p))
    return requests.join(rules, "evaluator_id", "left").withColumn("allowed", ((F.size(F.coalesce("allow", empty)) == 0) | fits("allow")) & ~fits("deny")).drop("allow", "deny")


def persisted(results: DataFrame, mode: str = "all", evidence: bool = True, level: str = "full") -> DataFrame:
    """What a profile's persistence settings keep: raw outputs (all, failures_only, none), evidence, and with level `summary` only the judged numbers (no raw output, evidence or reason)."""
    empty = F.lit(None).cast("string")
    if level == "summary":
        mode, evidence = "none", False
        if "reason" in results.columns:
            results = results.withColumn("reason", empty)
    if mode == "none":
        results = results.withColumn("raw_evaluator_output", empty)
    elif mode == "failures_only":
        results = results.withColumn("raw_evaluator_output", F.when(F.col("status").isin("failed", "error") | F.col("blocking"), F.col("raw_evaluator_output")))
    return results if evidence else results.withColumn("evidence", empty)
