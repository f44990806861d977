"""Registering queries, and the frames that several of them start from, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathework.functions.columns import r6
from lathework.session import table


class Registry:
    def __init__(self):
        self.QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.ORACLES: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        def put(f):
            self.QUERIES[name] = f
            if sql is not None:
                self.ORACLES[name] = sql
            return f

        return put


def r(x: str, digits: int = 6) -> str:
    """SQL for ``r6``."""
    return f"floor(({x}) * 1e{digits} + 0.5) / 1e{digits}"


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


#: Counts: samples are suppliers, features are parts modulo 200; an absent cell is a zero.
COUNTS = "(select l_suppkey as sample_id, l_partkey % 200 as feature_id, sum(l_quantity) as value from lineitem group by 1, 2)"
#: Values with gaps: samples are suppliers, features parts modulo 100; cells without a line of some tax are null, and so are absent ones.
BETA = "(select l_suppkey as sample_id, 'f' || cast(l_partkey % 100 as varchar) as feature_id, max(case when l_tax >= 0.03 then l_discount end) as value from lineitem group by 1, 2)"
#: Survival: days since the order, an event if it is finished; the customer gives group, risk and stage.
SURVIVAL = (
    "(select o_orderkey as id, cast(date_diff('day', cast(o_orderdate as date), date '2001-08-02') as double) as time, "
    "o_orderstatus = 'F' as event, c_mktsegment as grp, c_acctbal as risk, c_nationkey as site, cast(substr(o_orderpriority, 1, 1) as int) as stage from orders join customer on o_custkey = c_custkey)"
)
#: The same, a row per customer: the latest order.
PATIENTS = f"(select * exclude (rn) from (select c_custkey as pid, s.*, row_number() over (partition by c_custkey order by time, id) as rn from {SURVIVAL} s join orders on o_orderkey = s.id join customer on c_custkey = o_custkey) where rn = 1)"


def counts(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    return lines.groupBy(F.col("l_suppkey").alias("sample_id"), (F.col("l_partkey") % 200).alias("feature_id")).agg(F.sum("l_quantity").alias("value"))


def beta(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    return lines.groupBy(F.col("l_suppkey").alias("sample_id"), F.concat(F.lit("f"), (F.col("l_partkey") % 100).cast("string")).alias("feature_id")).agg(F.max(F.when(F.col("l_tax") >= 0.03, F.col("l_discount"))).alias("value"))


def survival(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return both.select(
        F.col("o_orderkey").alias("id"),
        F.date_diff(F.lit("2001-08-02").cast("date"), F.col("o_orderdate").cast("date")).cast("double").alias("time"),
        (F.col("o_orderstatus") == "F").alias("event"),
        F.col("c_mktsegment").alias("grp"),
        F.col("c_acctbal").alias("risk"),
        F.col("c_nationkey").alias("site"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("stage"),
        F.col("c_custkey").alias("pid"),
    )


def patients(spark: SparkSession, d: str) -> DataFrame:
    own = survival(spark, d)
    return own.groupBy("pid").agg(F.min(F.struct("time", "id", "event", "grp", "risk", "site", "stage")).alias("r")).select("pid", "r.*")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """``(id, vec, label)`` of all embeddings."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"), "label")
