"""Registered queries: name, Spark job over a folder of tables, oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gatelake.catalog.views import with_views

Job = Callable[[SparkSession, str], DataFrame]

JOBS: dict[str, Job] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Job], Job]:
    """Register a job; ``oracle`` may use the views of this package by name."""

    def add(job: Job) -> Job:
        if name in JOBS:
            raise ValueError(f"query {name} is registered twice")
        JOBS[name] = job
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return job

    return add
