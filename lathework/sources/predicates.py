"""Predicates that go to the source: conjunctions of equalities, and filter trees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def all_of(*conditions: dict[str, object]) -> Column:
    """All fields equal (or, for lists, among) their values; Parquet scans apply it row group by row group."""
    parts = [F.col(k).isin(*v) if isinstance(v, (list, tuple, set)) else F.col(k) == F.lit(v) for c in conditions for k, v in c.items()]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def from_tree(tree: dict) -> Column:
    """A filter tree ``{"op": "and" | "or" | "not" | "=" | "in" | "!=" | "<" | ">" | "<=" | ">=", "content": ...}``.

    Inner nodes hold lists of trees, leaves ``{"field": .., "value": ..}``.
    """
    op, content = tree["op"], tree["content"]
    if op in ("and", "or"):
        return reduce((lambda a, b: a & b) if op == "and" else (lambda a, b: a | b), map(from_tree, content))
    if op == "not":
        return ~from_tree(content[0] if isinstance(content, list) else content)
    x, v = F.col(content["field"]), content["value"]
    if op in ("=", "in"):
        return x.isin(*v) if isinstance(v, (list, tuple)) else x == F.lit(v)
    compare = {"!=": x.__ne__, "<": x.__lt__, ">": x.__gt__, "<=": x.__le__, ">=": x.__ge__}
    if op not in compare:
        raise ValueError(f"unknown operation {op!r}")
    return compare[op](F.lit(v))
