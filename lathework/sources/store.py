"""Materialised stages, keyed by what made them.

A stage's folder name holds a hash of its name, parameters and the keys of the
stages before it. A changed parameter or input gives another key, so a stale
result is never read and nothing has to be deleted by hand.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lathework.sources.files import exists


@dataclass(frozen=True)
class Stage:
    key: str
    path: str
    reused: bool

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def key(self, name: str, params: dict, inputs: list[Stage] | None = None) -> str:
        body = json.dumps([name, params, [s.key for s in inputs or []]], sort_keys=True, default=str)
        return hashlib.sha256(body.encode()).hexdigest()[:16]

    def stage(self, name: str, params: dict, make: Callable[..., DataFrame], inputs: list[Stage] | None = None) -> Stage:
        """The stage's result, made from its inputs' frames unless a finished one is there."""
        key = self.key(name, params, inputs)
        path = f"{self.root}/{name}-{key}"
        if exists(self.spark, f"{path}/_SUCCESS"):
            return Stage(key, path, True)
        make(*[s.read(self.spark) for s in inputs or []], **params).write.mode("overwrite").parquet(path)
        return Stage(key, path, False)

    def patch(self, name: str, base: Stage, corrected: DataFrame, on: list[str], column: str, params: dict | None = None) -> Stage:
        """A new version of ``base`` with the corrected values where there are any; the base stays as it is."""
        from pyspark.sql import functions as F

        def make(old: DataFrame, **_) -> DataFrame:
            fix = corrected.select(*on, F.col(column).alias("_new"))
            return old.join(fix, on, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")

        return self.stage(name, params or {}, make, [base])
