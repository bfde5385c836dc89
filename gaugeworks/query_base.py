"""The list of queries, the DuckDB SQL that must agree with them, and the test tables as evaluation tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NOW, DAY = "2024-01-15 00:00:00", "2024-01-15"
WORDS = {"positive": ("the", "and", "in", "de", "der"), "negative": ("of", "to", "la", "is", "that")}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def cases(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("case_id"), F.col("lang").alias("task_type"), F.array("lang", "source").alias("tags"), F.sha2("text", 256).alias("case_hash"), "text")
