"""Planning a run: dense ordinals, content-addressed cases, chunks, events, one staged commit."""

from __future__ import annotations

import uuid
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import canonical as C
from ..operators.routing import bind, route
from ..operators.state import ready_events
from ..schemas import conform, schema
from ..sources.documents import load_dataset, load_profile, profile_ids, profile_settings


def dense_ordinals(df: DataFrame, *order: str, name: str = "ordinal", parts: int | None = None) -> DataFrame:
    """0-based places in a global order without one task for all rows: ranges, sorted inside, then offsets.

    Only the sizes of the ranges (as many as partitions) come together. The ranges are the column range_:
    the same value never falls in two, so the order columns should be (nearly) unique.
    """
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(n, *order).withColumn("range_", F.spark_partition_id())
    within = F.row_number().over(Window.partitionBy("range_").orderBy(*order)) - 1
    sizes = {r["range_"]: r["count"] for r in cut.groupBy("range_").count().collect()}
    offsets, total = {}, 0
    for k in sorted(sizes):
        offsets[k], total = total, total + sizes[k]
    start = F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv]) if offsets else F.create_map(F.lit(0), F.lit(0))
    return cut.withColumn(name, within + F.element_at(start, F.col("range_"))).drop("range_")


def chunks(n: int, size: int = C.CHUNK_SIZE) -> list[tuple[int, int]]:
    return [(a, min(a + size, n)) for a in range(0, n, size)]


def chunk_table(counts: DataFrame, size: int = C.CHUNK_SIZE, n: str = "n") -> DataFrame:
    """One row for each half-open range of `size` ordinals."""
    starts = F.when(F.col(n) > 0, F.sequence(F.lit(0).cast("long"), F.col(n) - 1, F.lit(size).cast("long")))
    return counts.withColumn("ordinal_start", F.explode(starts)).withColumn("ordinal_end", F.least(F.col("ordinal_start") + size, F.col(n)))


def chunk_of(ordinal: str, size: int = C.CHUNK_SIZE):
    return F.floor(F.col(ordinal) / size)


def plan_run(spark: SparkSession, profile: str, dataset: str, run_key: str, now: str, size: int = C.CHUNK_SIZE) -> dict[str, Any]:
    """All tables of a new run, keyed by name, from the two documents."""
    raw_d, cases = load_dataset(spark, dataset)
    return plan_cases(spark, profile, cases, raw_d.get("dataset_id"), raw_d.get("dataset_version"), run_key, now, size)


def plan_cases(spark: SparkSession, profile: str, cases: DataFrame, dataset_id: str | None, version: str | None, run_key: str, now: str, size: int = C.CHUNK_SIZE) -> dict[str, Any]:
    """The same for cases (sources.documents.CASES) of any number: nothing of them comes to the driver but the version's hash and count.

    The tables have their declared columns and types (schemas.conform); routed, bound, unmatched, rules, bindings and
    settings are what evaluation goes on with.
    """
    raw_p, groups, bindings, rules = load_profile(spark, profile)
    cases = cases.withColumn("case_hash", C.case_hash(*map(F.col, ("task_type", "input", "expected", "context", "tags", "metadata"))))
    at, run_id = F.lit(now).cast("timestamp"), C.hash_value({"run_key": run_key})[:32]
    stamped = {"created_at": at, "updated_at": at}
    named = cases.select(F.lit(str(dataset_id or run_key)).alias("dataset_id"), F.lit(str(version or "")).alias("dataset_version"), "ordinal", "case_id", "case_hash")
    known = C.dataset_version_ids(named).first()
    if known is None:
        raise ValueError("a dataset has at least one case")
    version_id, n = known["dataset_version_id"], known["n"]
    version = str(version or version_id)
    one = spark.range(1).select(F.lit(version_id).alias("dataset_version_id"), F.lit(known["dataset_id"]).alias("dataset_id"), F.lit(version).alias("dataset_version"))
    routed = route(cases, groups)
    ids = profile_ids(raw_p)
    ranges = spark.range(0, n, size).select(F.lit(version_id).alias("dataset_version_id"), F.col("id").alias("ordinal_start"), F.least(F.col("id") + size, F.lit(n)).alias("ordinal_end"))
    ranges = ranges.withColumns({"run_id": F.lit(run_id), "id": C.stable_id(F.lit(run_id), F.col("ordinal_start")), "profile_group_id": F.lit("default"), "status": F.lit("pending"), **stamped})
    blobs = cases.dropDuplicates(["case_hash"]).select("case_hash", "task_type", F.col("input").alias("input_payload"), F.coalesce("expected", F.lit("null")).alias("expected_output"), F.coalesce("context", F.lit("null")).alias("context_payload"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "metadata", at.alias("created_at"))
    members = cases.select(F.lit(version_id).alias("dataset_version_id"), "case_id", F.col("ordinal").alias("case_ordinal"), "case_hash").withColumns(stamped)
    policy_hash = C.aggregation_policy_hash(raw_p)
    snapshot = {"profile": raw_p, "dataset_version_id": version_id, "aggregation_policy_hash": policy_hash, "chunk_size": size, **ids}
    # What a run says of policy, agent and prompt where nothing else is known.
    fixed = {"aggregation_policy_id": "profile_case_group_aggregation", "aggregation_policy_version": "v3", "agent_provider": "unknown", "agent_name": "unknown", "prompt_config_id": "default", "prompt_config_version": "v1"}
    zero = dict.fromkeys(("terminal_execution_count", "passed_execution_count", "failed_execution_count", "errored_execution_count"), 0)
    texts = {"id": run_id, "run_key": run_key, "evaluation_profile_id": str(raw_p["profile_id"]), "evaluation_profile_version": str(raw_p["profile_version"]), "aggregation_policy_hash": policy_hash, "status": "pending", "gate_status": "unknown", "config_snapshot": C.canonical(snapshot), "summary": "{}", **fixed, **ids}
    run = one.withColumns({k: F.lit(v) for k, v in {**texts, **zero, "expected_execution_count": n}.items()} | stamped)
    chunks_ = conform(ranges, "run_chunks")
    return {
        "runs": conform(run, "runs"),
        "dataset_versions": conform(one.withColumns(stamped), "dataset_versions"),
        "case_blobs": conform(blobs, "case_blobs"),
        "dataset_version_cases": conform(members, "dataset_version_cases"),
        "run_chunks": chunks_,
        "outbox_events": conform(ready_events(chunks_, now), "outbox_events"),
        "routed": routed,
        "bound": bind(routed.where("group_id is not null"), bindings),
        "unmatched": routed.where("group_id is null"),
        "rules": rules,
        "bindings": bindings,
        "settings": profile_settings(raw_p),
        "run_id": run_id,
    }


PLANNED = ("runs", "dataset_versions", "case_blobs", "dataset_version_cases", "run_chunks", "outbox_events")


def collection_counts(plan: dict[str, Any]) -> DataFrame:
    """case_count, blob_count, chunk_count and event_count of a planned run."""
    counts = {"case_count": "dataset_version_cases", "blob_count": "case_blobs", "chunk_count": "run_chunks", "event_count": "outbox_events"}
    parts = [plan[t].agg(F.count("*").alias("n")).select(F.lit(c).alias("what"), "n") for c, t in counts.items()]
    return reduce(DataFrame.unionByName, parts)


def commit(tables: dict[str, DataFrame], folder: str) -> str:
    """Stage all tables, then publish them by one marker: `committed` reads only folders with the marker."""
    spark = next(iter(tables.values())).sparkSession
    stage = f"{folder.rstrip('/')}/batch-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{stage}/{name}")
    spark.createDataFrame([(stage,)], "batch string").coalesce(1).write.json(f"{stage}/committed")
    return stage


def committed(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table over all batches that were published; what a failed commit left behind is not seen."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/batch-*/committed/_SUCCESS")
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    stages = sorted(str(f.getPath().getParent().getParent()) for f in found)
    if not stages:
        return spark.createDataFrame([], schema(table))
    return spark.read.schema(schema(table)).parquet(*[f"{s}/{table}" for s in stages])
