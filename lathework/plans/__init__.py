"""Registered queries: a name, a Spark plan and, where SQL can say it, a DuckDB query."""
