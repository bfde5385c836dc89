"""Reads: by key, ordered children, pages, oldest first."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_key(df: DataFrame, **key: Any) -> DataFrame:
    for c, v in key.items():
        df = df.where(F.col(c) == F.lit(v))
    return df


def children(df: DataFrame, parent: str, value: Any, *order: Column | str) -> DataFrame:
    return df.where(F.col(parent) == F.lit(value)).orderBy(*order)


def page(df: DataFrame, limit: int, offset: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).offset(max(0, offset)).limit(max(0, limit))


def oldest(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The row of each key that is last in the order (ascending columns, unique within a key), by a partial aggregation: no key is sorted in one task."""
    top = F.max_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(*keys).agg(top.alias("top_")).select(*[F.col("top_")[c].alias(c) for c in df.columns])


def latest_by(df: DataFrame, keys: list[str], by: str, *columns: str) -> DataFrame:
    """The same through a partial aggregation: nothing of a hot key is sorted."""
    top = F.max_by(F.struct(*columns), F.col(by))
    return df.groupBy(*keys).agg(top.alias("top")).select(*keys, "top.*")


def chunk_scan(members: DataFrame, blobs: DataFrame, version: str, start: int, end: int) -> DataFrame:
    """Cases of a dataset version with ordinals in [start, end), with their payloads."""
    part = members.where((F.col("dataset_version_id") == version) & (F.col("case_ordinal") >= start) & (F.col("case_ordinal") < end))
    return part.join(blobs, "case_hash").orderBy("case_ordinal")


def authoritative(attempts: DataFrame) -> DataFrame:
    """Each execution's last attempt that is not stale."""
    return latest(attempts.where("status <> 'stale'"), ["execution_id"], "attempt_no")


def current_results(results: DataFrame, attempts: DataFrame) -> DataFrame:
    """The results of each execution's authoritative attempt."""
    return results.join(authoritative(attempts).select(F.col("id").alias("attempt_id")), "attempt_id", "left_semi")


def run_results(runs: DataFrame, executions: DataFrame, attempts: DataFrame, results: DataFrame) -> DataFrame:
    """The facts of runs with what they hang on: run, execution and attempt, joined along the foreign keys."""
    r = runs.select(F.col("id").alias("run_id"), "run_key")
    e = executions.select(F.col("id").alias("execution_id"), "run_id", "case_id")
    a = attempts.select(F.col("id").alias("attempt_id"), "execution_id", "attempt_no")
    facts = results.drop("run_id", "execution_id")
    return r.join(e, "run_id").join(a, "execution_id").join(facts, "attempt_id")


def by_status(df: DataFrame, status: str, limit: int, order: str = "available_at") -> DataFrame:
    return oldest(df.where(F.col("status") == status), limit, order, "id")
