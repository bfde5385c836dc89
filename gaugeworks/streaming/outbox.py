"""The event log as a stream: publish, dedupe, route, set aside what cannot be read, watch progress."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.state import CHUNK_LEASE, at, chunk_claimable

MESSAGE = "run_id string, chunk_id string, dataset_version_id string, ordinal_start long, ordinal_end long"
#: Fixed value: seconds between two cycles.
TICK = 5


def read_events(spark: SparkSession, path: str, schema: Any, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def deduped(events: DataFrame, within: str | None = None, time: str = "available_at") -> DataFrame:
    """By dedupe_key: for ever (state grows with the keys), or within a delay (bounded state)."""
    if within is None:
        return events.dropDuplicates(["dedupe_key"])
    return events.withWatermark(time, within).dropDuplicatesWithinWatermark(["dedupe_key"])


def decoded(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages, and the events whose payload cannot be read (they do not stop the stream)."""
    e = events.withColumn("m", F.from_json("payload", MESSAGE))
    good = F.try_parse_json("payload").isNotNull() & F.col("m.chunk_id").isNotNull()
    good = F.coalesce(good, F.lit(False))
    return e.where(good).select(*events.columns, "m.*"), e.where(~good).drop("m")


def publish(events: DataFrame, out: str, checkpoint: str, route: str = "event_type", trigger: dict[str, Any] | None = None) -> StreamingQuery:
    """To files by routing key. A batch that is repeated after a failure overwrites itself: no event is lost or doubled."""

    def batch(df: DataFrame, epoch: int) -> None:
        df.withColumn("batch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", route).parquet(out)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": f"{TICK} seconds"})).start()


def evaluate(cases: DataFrame, judge: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, trigger: dict[str, Any] | None = None) -> StreamingQuery:
    """The batch plan `judge` over every micro-batch of cases."""

    def batch(df: DataFrame, epoch: int) -> None:
        judge(df).withColumn("batch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    return cases.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": f"{TICK} seconds"})).start()


def watch(results: DataFrame, name: str, *keys: str) -> StreamingQuery:
    """Running counts for each key, in memory."""
    return progress(results, *keys).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()


def publish_stats(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("claimed"), F.count_if(F.col("status") == "published").alias("published"), F.count_if(F.col("error_message").isNotNull()).alias("failed"))


def once() -> dict[str, Any]:
    return {"availableNow": True}


def stop(query: StreamingQuery, seconds: int = 30) -> None:
    """Let the running batch end, within the time; its checkpoint makes the rest repeatable."""
    query.stop()
    query.awaitTermination(seconds)


# ---- the work queue: pure functions of a batch of messages and the chunks ----------------------


def worker_cycle(messages: DataFrame, chunks: DataFrame, now: Any, failed: DataFrame | None = None, lease: int = CHUNK_LEASE) -> tuple[DataFrame, DataFrame]:
    """What becomes of a batch of messages (tag, payload), and the chunks after it.

    A message that cannot be read is poison: it is acknowledged and set aside. One whose chunk is missing, leased or
    done, or that a message with a lower tag has already claimed, is acknowledged without work. The others are
    claimed; those whose batch `failed` (chunk_id) are requeued and their chunks released, the rest completed.
    """
    m = messages.withColumn("m", F.from_json("payload", MESSAGE)).select("tag", F.coalesce(F.try_parse_json("payload").isNotNull() & F.col("m.chunk_id").isNotNull(), F.lit(False)).alias("read"), F.col("m.chunk_id").alias("chunk_id"))
    free = chunks.where(chunk_claimable(now)).select(F.col("id").alias("chunk_id"), F.lit(True).alias("free"))
    m = m.join(free, "chunk_id", "left")
    won = m.where("read and free").groupBy("chunk_id").agg(F.min("tag").alias("tag")).withColumn("won", F.lit(True))
    m = m.join(won, ["chunk_id", "tag"], "left")
    bad = m.limit(0).select("chunk_id") if failed is None else failed.select("chunk_id").distinct()
    m = m.join(bad.withColumn("failed", F.lit(True)), "chunk_id", "left")
    outcome = F.when(~F.col("read"), "poison").when(F.col("won").isNull(), "unclaimable").when(F.col("failed"), "failed").otherwise("completed")
    done = m.select("tag", "chunk_id", outcome.alias("outcome"), F.when(outcome == "failed", "requeue").otherwise("ack").alias("answer"))
    state = done.where("outcome in ('failed', 'completed')").select(F.col("chunk_id").alias("id"), "outcome")
    marked = chunks.join(state, "id", "left")
    hit = F.col("outcome").isNotNull()
    new = marked.select(*[
        F.when(hit, F.when(F.col("outcome") == "failed", "pending").otherwise("completed")).otherwise(F.col("status")).alias("status") if c == "status"
        else F.when(hit, F.lit(None)).otherwise(F.col(c)).alias(c) if c == "leased_until"
        else F.when(hit, at(now)).otherwise(F.col(c)).alias(c) if c == "updated_at"
        else F.col(c)
        for c in chunks.columns
    ])
    return done, new


def left_in_queue(messages: DataFrame, done: DataFrame) -> DataFrame:
    """The messages after a cycle: what was acknowledged is gone, what was requeued is there again."""
    return messages.join(done.where("answer = 'ack'").select("tag"), "tag", "left_anti")


def loaded_cases(done: DataFrame, chunks: DataFrame, members: DataFrame, blobs: DataFrame) -> DataFrame:
    """The cases of the claimed chunks, with their payloads: ordinals are found by arithmetic on the chunks' own ranges."""
    mine = chunks.join(done.where("outcome in ('failed', 'completed')").select(F.col("chunk_id").alias("id")), "id", "left_semi")
    slots = mine.select(F.col("id").alias("chunk_id"), "dataset_version_id", F.explode(F.sequence("ordinal_start", F.col("ordinal_end") - 1)).alias("case_ordinal"))
    return slots.join(members.select("dataset_version_id", "case_ordinal", "case_id", "case_hash"), ["dataset_version_id", "case_ordinal"]).join(blobs, "case_hash")


def work(messages: DataFrame, cycle: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, trigger: dict[str, Any] | None = None) -> StreamingQuery:
    """Worker cycles over a stream of messages: their outcomes to files. A batch that fails is read again from the checkpoint."""
    return evaluate(messages, cycle, out, checkpoint, trigger)


def log_events(events: DataFrame, logger: Any, checkpoint: str, trigger: dict[str, Any] | None = None) -> StreamingQuery:
    """The logging sink: a line for each event type and its count of every batch, so that no batch comes to the driver whole."""

    def batch(df: DataFrame, epoch: int) -> None:
        for r in df.groupBy("event_type").count().orderBy("event_type").collect():
            logger.info("batch %s: %s events of type %s", epoch, r["count"], r["event_type"])

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": f"{TICK} seconds"})).start()


def routed_to(events: DataFrame, pattern: str, key: str = "event_type") -> DataFrame:
    """The events whose routing key fits a topic pattern: words between dots, * for one word, # for any number."""
    words = {"*": r"[^.]+", "#": r".*"}
    body = "".join((r"\." if i else "") + words.get(w, re.escape(w)) for i, w in enumerate(pattern.split(".")))
    body = body.replace(r"\..*", r"(?:\..*)?").replace(r".*\.", r"(?:.*\.)?")
    return events.where(F.col(key).rlike(f"^{body}$"))


def progress(results: DataFrame, *keys: str) -> DataFrame:
    """What `watch` shows, of a finished batch."""
    return results.groupBy(*keys).count()
