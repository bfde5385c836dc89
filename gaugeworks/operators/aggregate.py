"""From findings to dimensions, executions and runs to the gate: partial aggregations on growing keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import canonical_json
from ..schemas import rank


def by_dimension(facts: DataFrame, *keys: str, order: str = "finding_no") -> DataFrame:
    """Findings of each dimension in the order in which they came; dim_rank gives the dimensions' order."""
    cols = [c for c in facts.columns if c not in (*keys, "dimension", order)]
    got = F.array_sort(F.collect_list(F.struct(order, *cols))).alias("findings")
    return facts.groupBy(*keys, "dimension").agg(got).withColumn("dim_rank", rank(F.col("dimension"), "dimension"))


def contributes() -> Column:
    return (F.col("status") != "skipped") & F.col("normalized_score").isNotNull()


def dimension_scores(facts: DataFrame, *keys: str, rules: DataFrame | None = None) -> DataFrame:
    """min_score and weighted_mean per dimension, and score by the rule's method (default weighted mean).

    facts need dimension, status, normalized_score, weight, blocking.
    """
    if rules is not None:
        on = [c for c in ("group_id", "dimension") if c in rules.columns]
        facts = facts.join(rules.select(*on, "method", F.col("blocking").alias("dim_blocking"), F.col("weight").alias("dim_weight")), on, "left")  # a few rows a profile: broadcast by their size
    else:
        facts = facts.withColumns({"method": F.lit(None).cast("string"), "dim_blocking": F.lit(True), "dim_weight": F.lit(1.0)})
    ok, s, w = contributes(), F.col("normalized_score"), F.col("weight")
    failed = F.col("status").isin("failed", "error") & F.col("blocking") & F.coalesce("dim_blocking", F.lit(True))
    out = facts.groupBy(*keys, "dimension").agg(
        F.min(F.when(ok, s)).alias("min_score"),
        (F.sum(F.when(ok, w * s)) / F.nullif(F.sum(F.when(ok, w)), F.lit(0.0))).alias("weighted_mean"),
        F.first("method").alias("method"),
        F.coalesce(F.first("dim_weight"), F.lit(1.0)).alias("dim_weight"),
        F.count("*").alias("n_results"),
        F.count_if(failed).alias("n_blocking"),
        F.count_if(F.col("status") == "error").alias("n_error"),
        F.count_if(F.col("status") != "skipped").alias("n_judged"),
    )
    return out.withColumn("score", F.when(F.col("method") == "min_score", F.col("min_score")).otherwise(F.col("weighted_mean")))


def execution_aggregates(dimensions: DataFrame, *keys: str, min_score: float | None = None, fail_on_blocking: bool = True, expected: str | None = None) -> DataFrame:
    """Overall score and status of each execution, from its dimensions.

    Status: not terminal (null) until `expected` results are in; then failed by a blocking failure, error,
    skipped if nothing was judged, failed below the minimum, else passed.
    """
    pos = F.col("score").isNotNull() & (F.col("dim_weight") > 0)
    extra = [F.max(expected).alias("expected_")] if expected else []
    out = dimensions.groupBy(*keys).agg(
        (F.sum(F.when(pos, F.col("dim_weight") * F.col("score"))) / F.sum(F.when(pos, F.col("dim_weight")))).alias("aggregate_score"),
        F.sum("n_results").alias("evaluator_result_count"),
        F.sum("n_blocking").alias("n_blocking"),
        F.sum("n_error").alias("n_error"),
        F.sum("n_judged").alias("n_judged"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("dimension", "score")))).alias("dimension_scores"),
        *extra,
    )
    steps = [(F.lit(fail_on_blocking) & (F.col("n_blocking") > 0), "failed"), (F.col("n_error") > 0, "error"), (F.col("n_judged") == 0, "skipped")]
    if min_score is not None:
        steps.append((F.col("aggregate_score") < min_score, "failed"))
    chain = F.when(F.col("evaluator_result_count") < F.col("expected_"), F.lit(None).cast("string")) if expected else F.when(F.lit(False), F.lit(None).cast("string"))
    for cond, value in steps:
        chain = chain.when(cond, value)
    return out.withColumn("overall_status", chain.otherwise("passed")).drop("expected_")


def blocking_failures(facts: DataFrame, *keys: str) -> DataFrame:
    bad = F.col("status").isin("failed", "error") & F.col("blocking")
    items = F.array_sort(F.collect_list(F.when(bad, F.struct("dimension", "evaluator_id", "finding_no", "status"))))
    return facts.groupBy(*keys).agg(items.alias("blocking_failures"))


def run_counters(executions: DataFrame, *keys: str, status: str = "overall_status", also: tuple[Column, ...] = ()) -> DataFrame:
    """expected, terminal, passed, failed, errored and skipped executions of a run, and further aggregates, in one aggregation."""
    s = F.col(status)
    return executions.groupBy(*keys).agg(
        F.count("*").alias("expected"),
        F.count(s).alias("terminal"),
        F.count_if(s == "passed").alias("passed"),
        F.count_if(s == "failed").alias("failed"),
        F.count_if(s == "error").alias("errored"),
        F.count_if(s == "skipped").alias("skipped"),
        *also,
    )


def gate(counters: DataFrame) -> DataFrame:
    """unknown until all are terminal; then pass if each passed or was skipped and one passed at least."""
    passed = (F.col("passed") + F.col("skipped") == F.col("expected")) & (F.col("passed") > 0)
    return counters.withColumn("gate_status", F.when(F.col("terminal") < F.col("expected"), "unknown").when(passed, "pass").otherwise("fail"))


def dimension_means(dimensions: DataFrame, *keys: str) -> DataFrame:
    """dimensions: of each run, array<struct<dimension, executions, mean_score, failing>>, by name."""
    per = dimensions.groupBy(*keys, "dimension").agg(F.count("*").alias("executions"), F.avg("score").alias("mean_score"), F.sum("n_blocking").alias("failing"))
    items = F.struct("dimension", "executions", F.round("mean_score", 6).alias("mean_score"), "failing")
    return per.groupBy(*keys).agg(F.array_sort(F.collect_list(items)).alias("dimensions"))


def run_summary(counters: DataFrame, dimensions: DataFrame, *keys: str) -> DataFrame:
    """counters (one row a run) with summary: canonical JSON of the counters and the dimension breakdown."""
    metrics = [c for c in counters.columns if c not in keys]
    joined = counters.join(dimension_means(dimensions, *keys), list(keys), "left")
    doc = F.to_json(F.struct(F.struct(*metrics).alias("counters"), F.coalesce("dimensions", F.array().cast("array<struct<dimension:string,executions:bigint,mean_score:double,failing:bigint>>")).alias("dimensions")))
    return joined.select(*counters.columns, canonical_json(doc).alias("summary"))


def complete(facts: DataFrame, expected: DataFrame, key: str = "execution_id") -> DataFrame:
    """expected (key, expected_evaluator_count) with reported (distinct evaluators) and complete."""
    got = facts.groupBy(key).agg(F.count_distinct("evaluator_id").alias("reported"))
    out = expected.join(got, key, "left").withColumn("reported", F.coalesce("reported", F.lit(0)))
    return out.withColumn("complete", F.col("reported") >= F.col("expected_evaluator_count"))


def usage_summary(attempts: DataFrame, *keys: str, latency: str = "total_latency_ms", usage: str = "token_usage", accuracy: int = 10_000) -> DataFrame:
    """Latency (mean, median, 95th percentile, largest) and summed token counts (of the JSON usage) of attempts.

    Percentiles are the sketch's, whose state is bounded whatever a group holds; its rank error is 1 / accuracy.
    """
    tokens = lambda name: F.coalesce(F.sum(F.try_variant_get(F.try_parse_json(usage), f"$.{name}", "bigint")), F.lit(0)).alias(name)
    return attempts.groupBy(*keys).agg(
        F.count("*").alias("attempts"),
        F.avg(latency).alias("mean_latency"),
        F.percentile_approx(latency, 0.5, accuracy).alias("median_latency"),
        F.percentile_approx(latency, 0.95, accuracy).alias("p95_latency"),
        F.max(latency).alias("max_latency"),
        tokens("prompt_tokens"),
        tokens("completion_tokens"),
    )


def breakdown(facts: DataFrame, *dims: str) -> DataFrame:
    """Counts for each combination and every total (nulls stand for all)."""
    return facts.rollup(*dims).agg(F.count("*").alias("n"))


def status_pivot(facts: DataFrame, *keys: str, statuses: tuple[str, ...] = ("passed", "failed", "error", "skipped")) -> DataFrame:
    return facts.groupBy(*keys).agg(*[F.count_if(F.col("status") == s).alias(s) for s in statuses])
