"""Relational operators: lookups, restriction to cohorts, sets, deduplication, contingency."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup(rows: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Rows whose key the dimension has, with its columns; unmatched rows are skipped."""
    return rows.join(dimension, key, "inner")


def left_labels(rows: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    return rows.join(labels, key, "left")


def restrict(rows: DataFrame, cohort: DataFrame, key: str) -> DataFrame:
    return rows.join(cohort.select(key), key, "left_semi")


def exclude(rows: DataFrame, *lists: DataFrame, key: str) -> DataFrame:
    return reduce(lambda a, b: a.join(b.select(key), key, "left_anti"), lists, rows)


def align(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows in the set of ``ids``; a missing id is an error that names how many are missing."""
    missing = ids.join(rows, key, "left_anti").count()
    if missing:
        raise ValueError(f"{missing} ids are missing")
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two frames hold the same rows, repeats counted."""
    extra = a.exceptAll(b).select(F.lit(1).alias("x")).unionByName(b.exceptAll(a).select(F.lit(1).alias("x")))
    return extra.agg((F.count("*") == 0).alias("same"))


def outer_metrics(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b, key, "full_outer")


def intersect_all(sets: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.intersect(b), sets)


def overlap_counts(sets: dict[str, DataFrame], key: str) -> DataFrame:
    """Size of each set, of their intersection, and of what each has outside it: a row per set."""
    flagged = None
    for name, s in sets.items():
        part = s.select(key).distinct().withColumn("set", F.lit(name))
        flagged = part if flagged is None else flagged.unionByName(part)
    n = F.count("*").over(Window.partitionBy(key))
    return flagged.withColumn("in_all", (n == len(sets)).cast("long")).groupBy("set").agg(F.count("*").alias("n"), F.sum("in_all").alias("n_common"), F.sum(1 - F.col("in_all")).alias("n_only_some"))


def keep_first(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first by an explicit order that breaks all ties."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def fallback(first: DataFrame, second: DataFrame) -> DataFrame:
    """``first``, or ``second`` where the first has no row."""
    any_row = first.limit(1).agg(F.count("*").alias("_n"))
    return first.unionByName(second.join(any_row.where("_n = 0"), how="left_semi"))


def crosstab(rows: DataFrame, row: str, column: str) -> DataFrame:
    """``(row, column, n, share)``: counts of all observed pairs and their share of the row, in percent."""
    n = rows.groupBy(row, column).agg(F.count("*").alias("n"))
    return n.withColumn("share", 100 * F.col("n") / F.sum("n").over(Window.partitionBy(row)))


def top_categories(rows: DataFrame, column: str, n: int, other: str = "Other") -> DataFrame:
    """``rows`` with all but the ``n`` most frequent values (ties by value) replaced."""
    top = rows.groupBy(column).agg(F.count("*").alias("_n")).orderBy(F.col("_n").desc(), column).limit(n).select(F.col(column).alias("_top"))
    return rows.join(F.broadcast(top), F.col(column) == F.col("_top"), "left").withColumn(column, F.coalesce("_top", F.lit(other))).drop("_top")


def extremes(rows: DataFrame, score: Column, n: int, tie: str) -> DataFrame:
    """The ``n`` largest and the ``n`` smallest by score, a row once."""
    high = rows.orderBy(score.desc(), F.col(tie)).limit(n)
    low = rows.orderBy(score.asc(), F.col(tie)).limit(n)
    return high.unionByName(low).distinct()


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def eta_squared(rows: DataFrame, group: str, features: list[str]) -> DataFrame:
    """Share of variance between groups, per feature (zero where there is none) and the bias-corrected omega squared.

    One row per feature: ``feature, eta2, omega2``.
    """
    long = rows.select(group, F.explode(F.map_from_arrays(F.array(*[F.lit(f) for f in features]), F.array(*[F.col(f).cast("double") for f in features]))).alias("feature", "x"))
    by = long.groupBy("feature", group).agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.coalesce(F.var_pop("x") * F.count("x"), F.lit(0.0)).alias("ss"))
    total = by.groupBy("feature").agg(
        F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("ss").alias("within"), (F.sum(F.col("n") * F.col("m") * F.col("m")) - F.sum(F.col("n") * F.col("m")) * F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("between")
    )
    whole = F.col("between") + F.col("within")
    ms = F.col("within") / F.greatest(F.col("n") - F.col("k"), F.lit(1))
    return total.select(
        "feature",
        F.when(whole <= 1e-12, 0.0).otherwise(F.col("between") / whole).alias("eta2"),
        F.when(whole <= 1e-12, 0.0).otherwise((F.col("between") - (F.col("k") - 1) * ms) / (whole + ms)).alias("omega2"),
    )


def group_mean_delta(rows: DataFrame, feature: str, label: str, value: str) -> DataFrame:
    """Mean in group 1, in group 0, and their difference, per feature."""
    one, zero = F.avg(F.when(F.col(label) == 1, F.col(value))), F.avg(F.when(F.col(label) == 0, F.col(value)))
    return rows.groupBy(feature).agg(one.alias("mean_1"), zero.alias("mean_0"), (one - zero).alias("delta"))


def majority(rows: DataFrame, key: str, label: str) -> DataFrame:
    """The most frequent label of each key; among equals the lowest."""
    n = rows.groupBy(key, label).agg(F.count("*").alias("_n"))
    return n.groupBy(key).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(label).alias("l")))["l"].alias(label))


def best_first(rows: DataFrame, score: Column, order: str, keys: list[str] | None = None) -> DataFrame:
    """The row with the largest score; among equals the first by ``order``."""
    pick = F.max_by(F.struct(*rows.columns), F.struct(score, -F.col(order)))
    return (rows.groupBy(*keys) if keys else rows.groupBy()).agg(pick.alias("_r")).select("_r.*")
