"""Driver queries: each applies operators to whole tables and carries its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Queries(dict):
    """name -> Query; ``add`` registers a function with its SQL under its own name."""

    def add(self, sql: str | None):
        def keep(f):
            self[f.__name__] = Query(f, sql)
            return f

        return keep
