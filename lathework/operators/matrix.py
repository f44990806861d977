"""Feature matrices in long form: ``(sample_id, feature_id, value)``, a row per cell.

A missing cell means zero in count matrices and null elsewhere; functions say
which. Statistics of implicit zeros come from counts, so the grid is only made
where the result has a row per cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathework.functions.columns import clip, guarded_ratio
from lathework.session import materialize

FEATURE, SAMPLE = "feature_id", "sample_id"


def densify(long: DataFrame, fill: float | None = None) -> DataFrame:
    """All samples times all features; absent cells get ``fill``. The result's size is the grid's."""
    grid = long.select(SAMPLE).distinct().crossJoin(long.select(FEATURE).distinct())
    full = grid.join(long, [SAMPLE, FEATURE], "left")
    return full if fill is None else full.withColumn("value", F.coalesce("value", F.lit(fill)))


def library_size(long: DataFrame) -> DataFrame:
    return long.groupBy(SAMPLE).agg(F.sum("value").alias("library_size"))


def counts_per_million(long: DataFrame) -> DataFrame:
    """Each value's share of its sample's sum, times a million; samples that sum to zero keep their values."""
    total = library_size(long)
    return long.join(total, SAMPLE).withColumn("value", guarded_ratio(F.col("value"), F.col("library_size")) * 1e6).drop("library_size")


def low_count_features(long: DataFrame, n_samples: int, below: float = 1.0, most: float = 0.80) -> DataFrame:
    """Features with a value under ``below`` in at most a share ``most`` of all samples; absent cells are zeros."""
    enough = F.sum((F.col("value") >= below).cast("long"))
    return long.groupBy(FEATURE).agg(((F.lit(n_samples) - enough) / F.lit(n_samples)).alias("share_low")).where(F.col("share_low") <= most)


def log2p1(long: DataFrame) -> DataFrame:
    return long.withColumn("value", F.log2(F.col("value") + 1))


def _median(value: str, n: str = "freq") -> F.Column:
    return F.expr(f"percentile({value}, 0.5, {n})")


def median_absolute_deviation(long: DataFrame, n_samples: int | None = None) -> DataFrame:
    """``(feature_id, median, mad)``, unscaled. With ``n_samples`` absent cells count as zeros, else they and nulls are left out."""
    own = long.where("value is not null").withColumn("freq", F.lit(1).cast("long"))
    if n_samples is not None:
        zeros = own.groupBy(FEATURE).agg((F.lit(n_samples) - F.count("*")).cast("long").alias("freq")).where("freq > 0")
        own = own.select(FEATURE, "value", "freq").unionByName(zeros.select(FEATURE, F.lit(0.0).alias("value"), "freq"))
    middle = own.groupBy(FEATURE).agg(_median("value").alias("median"))
    return own.join(middle, FEATURE).withColumn("dev", F.abs(F.col("value") - F.col("median"))).groupBy(FEATURE).agg(F.first("median").alias("median"), _median("dev").alias("mad"))


def top_features(scores: DataFrame, score: str, n: int, digits: int = 9) -> DataFrame:
    """The ``n`` features with the largest score (compared to ``digits`` places), ties by id."""
    return scores.orderBy(F.floor(F.col(score) * 10.0**digits + 0.5).desc(), F.col(FEATURE)).limit(n)


def zscore(long: DataFrame) -> DataFrame:
    """Per feature: minus the mean, over the population standard deviation (one where it is zero). Nulls stay."""
    stats = long.groupBy(FEATURE).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    return long.join(stats, FEATURE).withColumn("value", guarded_ratio(F.col("value") - F.col("mean"), F.col("sd"))).drop("mean", "sd")


def missing_filter(long: DataFrame, n_samples: int, most: float = 0.20) -> DataFrame:
    """Features with a share of null or absent cells of at most ``most``."""
    return long.groupBy(FEATURE).agg(((F.lit(n_samples) - F.count("value")) / F.lit(n_samples)).alias("share_null")).where(F.col("share_null") <= most)


def constant_filter(long: DataFrame) -> DataFrame:
    """Features whose sample standard deviation is above zero."""
    return long.groupBy(FEATURE).agg(F.stddev_samp("value").alias("sd")).where("sd > 0")


def impute_median(long: DataFrame) -> DataFrame:
    """Null values of a (dense) frame become their feature's median."""
    middle = long.groupBy(FEATURE).agg(F.median("value").alias("median"))
    return long.join(middle, FEATURE).withColumn("value", F.coalesce("value", "median")).drop("median")


def impute_mean(long: DataFrame) -> DataFrame:
    """Null values become their feature's mean, and zero where it has none."""
    middle = long.groupBy(FEATURE).agg(F.avg("value").alias("mean"))
    return long.join(middle, FEATURE).withColumn("value", F.coalesce("value", "mean", F.lit(0.0))).drop("mean")


def winsorise(long: DataFrame, bound: float = 5.0) -> DataFrame:
    return long.withColumn("value", clip(F.col("value"), -bound, bound))


def unit_samples(long: DataFrame) -> DataFrame:
    """Each sample scaled to Euclidean length one; all-zero samples stay."""
    norm = long.groupBy(SAMPLE).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    return long.join(norm, SAMPLE).withColumn("value", guarded_ratio(F.col("value"), F.col("norm"))).drop("norm")


def to_vectors(long: DataFrame, features: str = FEATURE) -> DataFrame:
    """``(sample_id, vec)``: values in the order of their feature ids. A sample's row must fit a task."""
    return long.groupBy(SAMPLE).agg(F.transform(F.array_sort(F.collect_list(F.struct(features, "value"))), lambda s: s["value"]).alias("vec"))


def to_cells(long: DataFrame, position: str = FEATURE) -> DataFrame:
    """``(sample_id, at, v)``: positions of a sample's values other than zero and null, ascending, and the values. A sample's cells must fit a task."""
    cell = F.struct(F.col(position).cast("int").alias("at"), F.col("value").cast("double").alias("v"))
    own = long.groupBy(SAMPLE).agg(F.array_sort(F.collect_list(F.when(F.col("value") != 0, cell))).alias("cells"))
    return own.select(SAMPLE, F.col("cells.at").alias("at"), F.col("cells.v").alias("v"))


def to_long(vectors: DataFrame, vec: str = "vec") -> DataFrame:
    return vectors.select(SAMPLE, F.posexplode(vec).alias(FEATURE, "value"))


def prepare_counts(long: DataFrame, n_top: int = 50) -> DataFrame:
    """The count pipeline: per million, low-count filter, log2, the ``n_top`` most variable features, z-scores over the dense grid."""
    cpm = materialize(counts_per_million(long), "cpm")  # read several times below; the input's own plan runs once
    samples = cpm.select(SAMPLE).distinct()
    n = samples.count()
    kept = materialize(log2p1(cpm.join(low_count_features(cpm, n), FEATURE, "left_semi")), "kept")
    top = top_features(median_absolute_deviation(kept, n), "mad", n_top)
    grid = samples.crossJoin(top.select(FEATURE))
    dense = grid.join(kept, [SAMPLE, FEATURE], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    return zscore(dense)


def prepare_beta(long: DataFrame, exclude: list[DataFrame], n_top: int = 50, drop_prefix: str | None = None) -> DataFrame:
    """The pipeline for bounded values with gaps: exclusion lists, missingness, median imputation, most variable, z-scores."""
    n = long.select(SAMPLE).distinct().count()
    if drop_prefix:
        long = long.where(~F.startswith(FEATURE, F.lit(drop_prefix)))
    for listed in exclude:
        long = long.join(listed, FEATURE, "left_anti")
    long = long.join(missing_filter(long, n), FEATURE, "left_semi")
    full = materialize(impute_median(densify(long)), "full")
    top = top_features(median_absolute_deviation(full), "mad", n_top)
    return zscore(full.join(top.select(FEATURE), FEATURE, "left_semi"))


def load_modality(long: DataFrame, cohort: DataFrame) -> DataFrame:
    """Restricted to the cohort, winsorised and scaled to unit samples."""
    return unit_samples(winsorise(long.join(cohort, SAMPLE, "left_semi")))


def concat_blocks(blocks: dict[str, DataFrame]) -> DataFrame:
    """Feature blocks side by side: ids get their block's name in front; samples must be in every block."""
    common = None
    for b in blocks.values():
        ids = b.select(SAMPLE).distinct()
        common = ids if common is None else common.join(ids, SAMPLE, "left_semi")
    out = None
    for name, b in blocks.items():
        part = b.join(common, SAMPLE, "left_semi").select(SAMPLE, F.concat(F.lit(f"{name}:"), F.col(FEATURE).cast("string")).alias(FEATURE), "value")
        out = part if out is None else out.unionByName(part)
    return out
