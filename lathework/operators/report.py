"""Result tables, and the frames behind figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lathework.functions.columns import recode


def master_table(clustering: DataFrame, survival: DataFrame, names: dict[str, str], key: str = "method") -> DataFrame:
    """Both metric tables side by side, keys renamed, methods of either kept."""
    named = lambda df: df.withColumn(key, F.coalesce(recode(F.col(key), names), key))
    return named(clustering).join(named(survival), key, "full_outer")


def ordered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows in a given order of keys, as a position; keys that are absent get a row of nulls."""
    spark = rows.sparkSession
    wanted = spark.createDataFrame([(k, v) for k, v in enumerate(order)], f"position int, {key} string")
    return F.broadcast(wanted).join(rows, key, "left")


def curve_points(curve: DataFrame, group: str, scale: float = 30.4375) -> DataFrame:
    """Step points of survival curves in months, each from one at time zero."""
    start = curve.select(group).distinct().select(group, F.lit(0.0).alias("months"), F.lit(1.0).alias("s"))
    return start.unionByName(curve.select(group, (F.col("time") / scale).alias("months"), "s"))


def forest(rows: DataFrame, key: str, value: str, low: str, high: str) -> DataFrame:
    """Rows of a forest plot by falling value: position, and error bars as distances."""
    position = F.row_number().over(Window.orderBy(F.col(value).desc(), key)) - 1  # a row per method
    return rows.select(key, value, (F.col(value) - F.col(low)).alias("down"), (F.col(high) - F.col(value)).alias("up"), position.alias("position"))


def stacked_shares(rows: DataFrame, group: str, status: str, levels: list[str]) -> DataFrame:
    """Percent of each status within each group; the levels are exactly those given, with zeros."""
    n = rows.groupBy(group).agg(F.count("*").alias("total"), *[F.count_if(F.col(status) == v).alias(v) for v in levels])
    long = n.select(group, "total", F.explode(F.array(*[F.struct(F.lit(v).alias("status"), F.col(v).alias("n")) for v in levels])).alias("x"))
    return long.select(group, F.col("x.status").alias("status"), F.col("x.n").alias("n"), (100 * F.col("x.n") / F.col("total")).alias("pct"))
