"""State transitions as pure functions of a table and a clock: claims, leases, retries, upserts."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import stable_id
from ..schemas import enforce

# Fixed values, in seconds.
RUN_LEASE, CHUNK_LEASE, OUTBOX_LEASE, RETRY_DELAY = 60, 60, 30, 10
OUTBOX_BATCH = 32


def at(now: Any) -> Column:
    return now if isinstance(now, Column) else F.lit(now).cast("timestamp")


def later(now: Any, seconds: int) -> Column:
    return at(now) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))


def lease_free(lease: str, now: Any) -> Column:
    return F.col(lease).isNull() | (F.col(lease) < at(now))


def _change(df: DataFrame, hit: Column, **values: Any) -> DataFrame:
    """New values where hit, all computed from the old row."""
    kinds = dict(df.dtypes)
    return df.select(*[F.when(hit, values[c] if isinstance(values[c], Column) else F.lit(values[c])).otherwise(F.col(c)).cast(kinds[c]).alias(c) if c in values else F.col(c) for c in df.columns])


def _claim(df: DataFrame, ready: Column, n: int, order: list[str], **values: Any) -> tuple[DataFrame, DataFrame]:
    """The n first ready rows, changed; and the whole table with them changed. At most n ids are broadcast."""
    ids = df.where(ready).orderBy(*order).limit(n).select("id", F.lit(True).alias("hit_"))
    new = _change(df.join(F.broadcast(ids), "id", "left"), F.coalesce("hit_", F.lit(False)), **values)
    return new.where("hit_").drop("hit_"), new.drop("hit_")


def claim_run(runs: DataFrame, coordinator: str, now: Any, lease: int = RUN_LEASE) -> tuple[DataFrame, DataFrame]:
    """The oldest run that waits, or whose coordinator's lease ran out."""
    ready = ((F.col("status") == "pending") & lease_free("coordinator_leased_until", now)) | ((F.col("status") == "running") & (F.col("coordinator_leased_until") < at(now)))
    return _claim(runs, ready, 1, ["created_at", "id"], status="running", coordinator_id=coordinator, coordinator_leased_until=later(now, lease), coordinator_heartbeat_at=at(now), started_at=F.coalesce("started_at", at(now)), updated_at=at(now))


def chunk_claimable(now: Any) -> Column:
    return (F.col("status") == "pending") | ((F.col("status") == "leased") & (F.col("leased_until") < at(now)))


def claim_chunk(chunks: DataFrame, chunk_id: str, now: Any, lease: int = CHUNK_LEASE) -> tuple[DataFrame, DataFrame]:
    return _claim(chunks, chunk_claimable(now) & (F.col("id") == chunk_id), 1, ["id"], status="leased", leased_until=later(now, lease), updated_at=at(now))


def _finish_chunk(chunks: DataFrame, chunk_id: str, held_until: Any, now: Any, status: str) -> DataFrame:
    """Only the holder of the lease may finish it."""
    mine = (F.col("id") == chunk_id) & (F.col("status") == "leased") & (F.col("leased_until") == at(held_until))
    return _change(chunks, mine, status=status, leased_until=F.lit(None).cast("timestamp"), updated_at=at(now))


def complete_chunk(chunks: DataFrame, chunk_id: str, held_until: Any, now: Any) -> DataFrame:
    return _finish_chunk(chunks, chunk_id, held_until, now, "completed")


def release_chunk(chunks: DataFrame, chunk_id: str, held_until: Any, now: Any) -> DataFrame:
    return _finish_chunk(chunks, chunk_id, held_until, now, "pending")


def available(now: Any) -> Column:
    return (F.col("status") == "pending") & (F.col("available_at") <= at(now))


def claim_outbox(events: DataFrame, now: Any, n: int = OUTBOX_BATCH, lease: int = OUTBOX_LEASE) -> tuple[DataFrame, DataFrame]:
    """The oldest available events; they stay pending and become available again when the lease ends."""
    return _claim(events, available(now), n, ["available_at", "id"], available_at=later(now, lease), updated_at=at(now))


def mark_published(events: DataFrame, ids: DataFrame, now: Any) -> DataFrame:
    marked = events.join(ids.select("id", F.lit(True).alias("hit_")), "id", "left")
    return _change(marked, F.coalesce("hit_", F.lit(False)), status="published", published_at=at(now), error_message=F.lit(None).cast("string"), updated_at=at(now)).drop("hit_")


def reschedule(events: DataFrame, failures: DataFrame, now: Any, delay: int = RETRY_DELAY) -> DataFrame:
    """failures: id, error."""
    marked = events.join(failures.select("id", F.col("error").alias("error_")), "id", "left")
    return _change(marked, F.col("error_").isNotNull(), status="pending", available_at=later(now, delay), error_message=F.col("error_"), updated_at=at(now)).drop("error_")


def after_attempt(attempts: DataFrame, max_attempts: int) -> DataFrame:
    """The execution's state after its last attempt."""
    s, n = F.col("status"), F.col("attempt_no")
    failed = s.isin("failed_agent_call", "failed_evaluation", "timed_out", "stale")
    state = F.when(s == "completed", "completed").when(s == "cancelled", "cancelled").when(failed & (n < max_attempts), "retry_scheduled").when(s == "timed_out", "timed_out").when(failed, "failed").otherwise("running")
    return attempts.withColumn("execution_status", state)


def mark_stale(attempts: DataFrame, now: Any) -> DataFrame:
    """Running attempts whose lease ran out, or that a later attempt replaced."""
    last = attempts.groupBy("execution_id").agg(F.max("attempt_no").alias("last_"))
    joined = attempts.join(last, "execution_id")
    stale = (F.col("status") == "running") & (F.coalesce(F.col("leased_until") < at(now), F.lit(False)) | (F.col("attempt_no") < F.col("last_")))
    return _change(joined, stale, status="stale").drop("last_")


def cancel_run(runs: DataFrame, run_id: str, now: Any) -> DataFrame:
    hit = (F.col("id") == run_id) & F.col("status").isin("pending", "running", "finalizing")
    return _change(runs, hit, status="cancelled", completed_at=at(now), updated_at=at(now))


def finalize_run(runs: DataFrame, gates: DataFrame, now: Any) -> DataFrame:
    """gates: run_id, gate_status and counters. Idempotent: only running runs with a decided gate change."""
    g = gates.select(F.col("run_id").alias("id"), F.col("gate_status").alias("gate_"), *[F.col(c).alias(f"{c}_") for c in ("terminal", "passed", "failed", "errored")])
    hit = F.col("status").isin("running", "finalizing") & F.coalesce(F.col("gate_") != "unknown", F.lit(False))
    new = _change(runs.join(g, "id", "left"), hit, status="completed", gate_status=F.col("gate_"), terminal_execution_count=F.col("terminal_"), passed_execution_count=F.col("passed_"), failed_execution_count=F.col("failed_"), errored_execution_count=F.col("errored_"), finalized_at=at(now), completed_at=at(now), updated_at=at(now))
    return new.select(*runs.columns)


def completed_events(before: DataFrame, after: DataFrame, now: Any) -> DataFrame:
    """A run.completed event for each run that `finalize_run` has just completed; its key makes a repetition harmless."""
    done = after.where("status = 'completed'").join(before.where("status <> 'completed'").select("id"), "id", "left_semi")
    key = F.format_string("run:%s:completed", "id")
    payload = F.to_json(F.struct(F.col("id").alias("run_id"), "gate_status"))
    return done.select(stable_id(F.lit("event"), key).alias("id"), F.lit("run.completed").alias("event_type"), F.lit("run").alias("aggregate_type"), F.col("id").alias("aggregate_id"), key.alias("dedupe_key"), payload.alias("payload"), F.lit("pending").alias("status"), at(now).alias("available_at"), at(now).alias("created_at"), at(now).alias("updated_at"))


def enqueue(events: DataFrame, new: DataFrame) -> DataFrame:
    """The events to append: one of each dedupe_key that the log has not."""
    return insert_ignore(events, new, "dedupe_key")


def ready_events(chunks: DataFrame, now: Any) -> DataFrame:
    """A run.chunk.ready event for each pending chunk."""
    key = F.format_string("run:%s:chunk:%s:ready", "run_id", "id")
    payload = F.to_json(F.struct("run_id", F.col("id").alias("chunk_id"), "dataset_version_id", "ordinal_start", "ordinal_end"))
    return chunks.where("status = 'pending'").select(stable_id(F.lit("event"), key).alias("id"), F.lit("run.chunk.ready").alias("event_type"), F.lit("run_chunk").alias("aggregate_type"), F.col("id").alias("aggregate_id"), key.alias("dedupe_key"), payload.alias("payload"), F.lit("pending").alias("status"), at(now).alias("available_at"), at(now).alias("created_at"), at(now).alias("updated_at"))


def started_events(runs: DataFrame, now: Any) -> DataFrame:
    """A run.started event for each running run."""
    key = F.format_string("run:%s:started", "id")
    payload = F.to_json(F.struct(F.col("id").alias("run_id"), "dataset_version_id"))
    return runs.where("status = 'running'").select(stable_id(F.lit("event"), key).alias("id"), F.lit("run.started").alias("event_type"), F.lit("run").alias("aggregate_type"), F.col("id").alias("aggregate_id"), key.alias("dedupe_key"), payload.alias("payload"), F.lit("pending").alias("status"), at(now).alias("available_at"), at(now).alias("created_at"), at(now).alias("updated_at"))


# ---- inserts, upserts, patches, deletes -----------------------------------------------------


def inserted(table: DataFrame, rows: DataFrame, keys: tuple[tuple[str, ...], ...], checks: dict[str, str] | None = None) -> DataFrame:
    """The rows to append, checked as they are written: a row that breaks a check raises when read, a key that is taken or repeated raises now."""
    for key in keys:
        every = table.select(*key).union(rows.select(*key))
        if not every.groupBy(*key).count().where("count > 1").isEmpty():
            raise ValueError(f"{', '.join(key)} is taken")
    return enforce(rows, checks) if checks else rows


def insert_ignore(table: DataFrame, rows: DataFrame, *key: str) -> DataFrame:
    """The rows to append: one of each key that the table has not."""
    return rows.dropDuplicates(list(key)).join(table.select(*key), list(key), "left_anti")


def guarded_upsert(table: DataFrame, rows: DataFrame, key: list[str], must_equal: list[str]) -> DataFrame:
    """The rows to append; a key repeated in the batch, or present with other values, raises."""
    if not rows.groupBy(*key).count().where("count > 1").isEmpty():
        raise ValueError("a key is repeated in one batch")
    old = table.select(*key, F.struct(*must_equal).alias("old_"))
    if not rows.join(old, key).where(~F.col("old_").eqNullSafe(F.struct(*must_equal))).isEmpty():
        raise ValueError("a stored row differs: it is immutable")
    return rows.join(old, key, "left_anti")


def patch(table: DataFrame, changes: DataFrame, key: str, now: Any | None = None) -> DataFrame:
    """Fields of `changes` that are not null replace the table's."""
    fields = [c for c in changes.columns if c != key]
    new = table.join(changes.select(key, *[F.col(c).alias(f"{c}_new") for c in fields], F.lit(True).alias("hit_")), key, "left")
    out = [F.coalesce(f"{c}_new", c).alias(c) if c in fields else F.when(F.col("hit_"), at(now)).otherwise(F.col(c)).alias(c) if c == "updated_at" and now is not None else F.col(c) for c in table.columns]
    return new.select(*out)


def delete_cascade(tables: dict[str, DataFrame], name: str, ids: DataFrame, foreign: tuple[tuple[str, str, str, str], ...]) -> dict[str, DataFrame]:
    """Without the rows of these ids, and without their descendants."""
    out, todo = dict(tables), [(name, "id", ids.select("id"))]
    while todo:
        t, column, gone = todo.pop()
        dead = out[t].join(gone.withColumnRenamed("id", column), column, "left_semi")
        for child, c, parent, key in foreign:
            if parent == t and child in out and key in dead.columns and c in out[child].columns:
                todo.append((child, c, dead.select(F.col(key).alias("id"))))
        out[t] = out[t].join(gone.withColumnRenamed("id", column), column, "left_anti")
    return out
