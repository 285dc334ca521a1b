"""Registry of named queries.

Each entry: a builder ``fn(t: Tables) -> DataFrame``, an output spec shared with the
oracle (kassa.plans.spec), and optionally DuckDB SQL over the raw tables (the test
views of kassa.sources.testdata are prepended as CTEs).  Entries without SQL are
checked rows-only by the driver plus own assertions in tests/.
"""
from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from kassa.plans.spec import finalize, finalize_sql
from kassa.sources.testdata import Tables, with_views


@dataclass
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    spec: str | None
    sql: str | None
    digits: int = 9

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(Tables(spark, sf_dir))
        return finalize(df, self.spec, self.digits) if self.spec else df

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        return finalize_sql(with_views(self.sql), self.spec, self.digits)


REGISTRY: dict[str, Query] = {}


def register(name: str, spec: str | None, sql: str | None = None, digits: int = 9):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, spec, sql, digits)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    # importing the modules registers their queries
    from kassa.plans import (q_clean, q_features, q_aggregates, q_forecast,  # noqa: F401
                             q_predictions, q_anomaly, q_models, q_maintain, q_reports)
    return REGISTRY
