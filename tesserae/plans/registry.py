"""All queries of the library proper and the SQL that says the same. Names begin with the operator's number in the survey."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "X1_section_audit"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its own name, with DuckDB SQL if that can say it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def load() -> None:
    from tesserae.plans import audit_queries, byte_queries, config_queries, graph_queries, image_queries, mesh_queries, raster_queries, render_queries  # noqa: F401


load()
