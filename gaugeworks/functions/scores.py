"""Scores: normalization to [0, 1], raw parts, and findings as facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The score of a severity and of a preference.
SEVERITY_SCORE = {"none": 1.0, "low": 0.75, "medium": 0.5, "high": 0.25, "critical": 0.0}
PREFERENCE_SCORE = {"preferred": 1.0, "tie": 0.5, "not_preferred": 0.0}


def finite(c: Column) -> Column:
    """NaN is no score."""
    return F.when(~F.isnan(c), c)


def clamp(c: Column) -> Column:
    """To [0, 1]; null stays null, which least and greatest alone would not keep."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def _of(c: Column, table: dict[str, float]) -> Column:
    return F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in table.items()])


def normalize(score: Column) -> Column:
    """Null for informational scores and for ranges without extent."""
    kind, value, low, high = score["kind"], finite(score["value"]), finite(score["min"]), finite(score["max"])
    return (
        F.when(kind == "binary", score["passed"].cast("double"))
        .when((kind == "range") & (high > low), clamp((value - low) / F.nullif(high - low, F.lit(0.0))))
        .when(kind == "normalized", clamp(value))
        .when(kind == "severity_mapped", _of(score["severity"], SEVERITY_SCORE))
        .when(kind == "preference", _of(score["outcome"], PREFERENCE_SCORE))
    )


def raw_parts(score: Column) -> Column:
    """struct(raw, low, high); severities and informational scores have none."""
    kind = score["kind"]
    unit = kind.isin("binary", "normalized", "preference")
    raw = F.when(kind == "binary", score["passed"].cast("double")).when(kind.isin("range", "normalized"), score["value"]).when(kind == "preference", _of(score["outcome"], PREFERENCE_SCORE))
    low, high = F.when(unit, F.lit(0.0)).when(kind == "range", score["min"]), F.when(unit, F.lit(1.0)).when(kind == "range", score["max"])
    return F.struct(raw.alias("raw"), low.alias("low"), high.alias("high"))


def evaluator_id(namespace: Column, name: Column, version: Column) -> Column:
    return F.concat(namespace, F.lit("/"), name, F.lit(":"), version)


def explode_findings(outputs: DataFrame, *keep: str) -> DataFrame:
    """evaluator struct and results array -> one fact a finding, numbered from 0."""
    e = outputs.select(*keep, "evaluator", F.posexplode("results").alias("finding_no", "f"))
    parts = raw_parts(F.col("f.score"))
    return e.select(
        *keep,
        evaluator_id(F.col("evaluator.namespace"), F.col("evaluator.name"), F.col("evaluator.version")).alias("evaluator_id"),
        F.col("evaluator.version").alias("evaluator_version"),
        "finding_no",
        F.col("f.dimension").alias("dimension"),
        F.col("f.status").alias("status"),
        F.coalesce("f.blocking", F.lit(False)).alias("blocking"),
        F.col("f.score.kind").alias("score_kind"),
        parts["raw"].alias("raw_score"),
        parts["low"].alias("raw_score_min"),
        parts["high"].alias("raw_score_max"),
        normalize(F.col("f.score")).alias("normalized_score"),
        F.col("f.severity").alias("severity"),
        F.col("f.failure_category").alias("failure_category"),
        F.col("f.reason").alias("reason"),
    )
