"""The registered queries: a callable over (spark, data folder) and, where SQL can express it, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.runs: dict[str, Run] = {}
        self.sqls: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Run], Run]:
        """Register the decorated function as query `name`."""

        def add(run: Run) -> Run:
            if name in self.runs:
                raise ValueError(f"query {name} is registered twice")
            self.runs[name] = run
            if sql is not None:
                self.sqls[name] = sql
            return run

        return add
