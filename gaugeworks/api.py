"""One object for what a command line would offer: the folders, how much to say, and the commands."""

from __future__ import annotations

import logging
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from . import schemas
from .operators import state
from .plans import evaluate, runs
from .sources.documents import export, text_source, validate_inputs


@dataclass(frozen=True)
class Settings:
    """tables: the folder of committed tables; messages: that of the event log. quiet and verbose set the log level."""

    tables: str
    messages: str = ""
    quiet: bool = False
    verbose: int = 0

    def level(self) -> int:
        if self.quiet:
            return logging.ERROR
        return (logging.WARNING, logging.INFO, logging.DEBUG)[min(self.verbose, 2)]


class Engine:
    def __init__(self, spark: SparkSession, settings: Settings) -> None:
        self.spark, self.settings = spark, settings
        self.log = logging.getLogger("gaugeworks")
        self.log.setLevel(settings.level())

    def setup(self) -> dict[str, str]:
        return schemas.create_all(self.spark, self.settings.tables.rstrip("/") + "/empty")

    def table(self, name: str) -> DataFrame:
        return runs.committed(self.spark, self.settings.tables, name)

    def _texts(self, profile: str | None, profile_file: str | None, dataset: str | None, dataset_file: str | None) -> tuple[str, str]:
        return text_source(profile, profile_file, "profile", self.spark), text_source(dataset, dataset_file, "dataset", self.spark)

    def test(self, profile: str | None = None, profile_file: str | None = None, dataset: str | None = None, dataset_file: str | None = None) -> dict[str, Any]:
        """Read and check the documents of a run, without making one."""
        return validate_inputs(*self._texts(profile, profile_file, dataset, dataset_file))

    def create(self, run_key: str, now: str, profile: str | None = None, profile_file: str | None = None, dataset: str | None = None, dataset_file: str | None = None) -> dict[str, Any]:
        """Plan a run and commit its tables as one batch."""
        plan = runs.plan_run(self.spark, *self._texts(profile, profile_file, dataset, dataset_file), run_key, now)
        runs.commit({name: plan[name] for name in runs.PLANNED}, self.settings.tables)
        self.log.info("run %s planned", plan["run_id"])
        return plan

    def status(self, run_id: str) -> DataFrame:
        return evaluate.run_status(self.table("runs"), run_id)

    def cancel(self, run_id: str, now: str) -> DataFrame:
        return state.cancel_run(self.table("runs"), run_id, now)

    def results(self, run_id: str) -> DataFrame:
        return evaluate.run_report(self.table("executions"), self.table("execution_aggregates"), run_id)

    def export(self, run_id: str, path: str, kind: str = "parquet") -> None:
        export(self.results(run_id), path, kind)
