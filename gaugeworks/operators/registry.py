"""The evaluator registry: publish, show, search, list, states."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import identifier_parts, stable_id
from ..functions.scores import explode_findings
from ..schemas import ENUMS
from .lookup import latest_by

# Bounds and default of a search's limit.
MIN_LIMIT, MAX_LIMIT, DEFAULT_LIMIT = 1, 20, 10
SUMMARY = ("id", "namespace", "name", "version", "description", "tags", "state", "state_reason")


def publish(registry: DataFrame, drafts: DataFrame, now: str) -> DataFrame:
    """The registry with the drafts; a version, or a content, that is already there raises."""
    at = F.lit(now).cast("timestamp")
    new = drafts.withColumns({"id": stable_id(F.col("namespace"), F.col("name"), F.col("version")), "content_hash": F.sha2("wasm_bytes", 256), "wasm_size_bytes": F.octet_length("wasm_bytes").cast("long"), "state": F.lit("active"), "state_reason": F.lit(None).cast("string"), "created_at": at, "updated_at": at})
    every = registry.unionByName(new, allowMissingColumns=True)
    for key in (("namespace", "name", "version"), ("namespace", "content_hash")):
        if not every.groupBy(*key).count().where("count > 1").isEmpty():
            raise ValueError(f"{', '.join(key)} is already published")
    return every


def show(registry: DataFrame, namespace: str, name: str, version: str) -> DataFrame:
    return registry.where((F.col("namespace") == namespace) & (F.col("name") == name) & (F.col("version") == version)).limit(1)


def listing(registry: DataFrame, namespace: str) -> DataFrame:
    return registry.where(F.col("namespace") == namespace).orderBy(F.asc("name"), F.desc("version"))


def tags_text(tags: Column) -> Column:
    """As the search sees them: JSON with a blank after each comma."""
    quoted = F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.regexp_replace(F.to_json(F.array(t)), r"^\[|\]$", ""))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def search(registry: DataFrame, query: str | None = None, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Contains, in any case, in name, namespace, description, tags or state reason; % and _ are wildcards."""
    q = (query or "").strip()
    if q:
        of = [F.col("namespace"), F.col("name"), F.coalesce("description", F.lit("")), F.coalesce("state_reason", F.lit("")), tags_text(F.col("tags"))]
        registry = registry.where(reduce(or_, [c.ilike(f"%{q}%") for c in of]))
    return registry.select(*[c for c in SUMMARY if c in registry.columns]).orderBy(F.asc("name"), F.desc("version"), F.asc("id")).limit(max(MIN_LIMIT, min(MAX_LIMIT, limit)))


def latest_versions(registry: DataFrame) -> DataFrame:
    return latest_by(registry, ["namespace", "name"], "created_at", "id", "version")


def test(registry: DataFrame, identifier: str, inputs: DataFrame, evaluate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The facts of a registered evaluator over inputs; an unknown one, or one that is disabled or removed, raises."""
    parts = registry.sparkSession.range(1).select(identifier_parts(F.lit(identifier)).alias("i")).first().i
    if parts is None:
        raise ValueError(f"not an evaluator's name: {identifier}")
    row = show(registry, *parts).select("state").first()
    if row is None:
        raise LookupError(f"no evaluator {identifier}")
    if row.state in ("disabled", "removed"):
        raise PermissionError(f"{identifier} cannot be tested while it is {row.state}")
    own = F.struct(*[F.lit(v).alias(k) for k, v in zip(("namespace", "name", "version"), parts, strict=True)])
    return explode_findings(evaluate(inputs).withColumn("evaluator", own), *[c for c in inputs.columns if c in ("id", "case_id", "doc_id")])


def set_state(registry: DataFrame, evaluator_id: str, state: str, reason: str | None = None) -> DataFrame:
    """Any state but out of `removed`; no such evaluator raises."""
    if state not in ENUMS["evaluator_state"]:
        raise ValueError(f"unknown state {state}")
    hit = (F.col("id") == evaluator_id) & (F.col("state") != "removed")
    if registry.where(hit).isEmpty():
        raise LookupError("no such evaluator, or it is removed")
    return registry.withColumn("state_reason", F.when(hit, F.lit(reason)).otherwise(F.col("state_reason"))).withColumn("state", F.when(hit, F.lit(state)).otherwise(F.col("state")))


def runnable(registry: DataFrame) -> DataFrame:
    return registry.where(~F.col("state").isin("disabled", "removed"))


def selectable(registry: DataFrame, pinned: bool) -> DataFrame:
    """Yanked versions only for pinned references; deprecated ones stay selectable."""
    return registry.where(F.col("state").isin(*(("active", "deprecated", "yanked") if pinned else ("active", "deprecated"))))
