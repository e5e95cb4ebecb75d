"""All registered queries of the engine: name -> callable, name -> DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleaner.queries import corpus, evaluation, retrieval

FLAGSHIP = "hybrid_retrieval"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
for _part in (corpus, retrieval, evaluation):
    QUERIES |= {name: q.run for name, q in _part.ALL.items()}
    ORACLE |= {name: q.sql for name, q in _part.ALL.items() if q.sql}
