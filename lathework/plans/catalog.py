"""All registered queries and their oracles."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def add(module) -> None:
    clash = QUERIES.keys() & module.QUERIES.keys()
    if clash:
        raise ValueError(f"registered twice: {sorted(clash)}")
    QUERIES.update(module.QUERIES)
    ORACLES.update(module.ORACLES)


def _load() -> None:
    from lathework.plans import graph_queries, matrix_queries, model_queries, relational_queries, report_queries, source_queries, stream_queries, survival_queries

    for module in (matrix_queries, relational_queries, graph_queries, survival_queries, model_queries, report_queries, source_queries, stream_queries):
        add(module)


_load()
