"""Queries on feature matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from lathework.functions.columns import r6
from lathework.operators import matrix as M
from lathework.plans.base import BETA, COUNTS, Registry, beta, counts, r, rounded
from lathework.session import table

query = Registry()

_N = f"(select count(distinct sample_id) from {COUNTS})"
_CPM = f"(select sample_id, feature_id, case when t = 0 then value else value / t end * 1e6 as value from (select *, sum(value) over (partition by sample_id) as t from {COUNTS}))"
_KEPT = f"(select feature_id from {_CPM} group by 1 having ({_N} - count(*) filter (value >= 1.0)) / cast({_N} as double) <= 0.8)"
_LOG = f"(select sample_id, feature_id, log2(value + 1) as value from {_CPM} where feature_id in (select feature_id from {_KEPT}))"
_GRID = f"(select s.sample_id, f.feature_id, coalesce(l.value, 0.0) as value from (select distinct sample_id from {COUNTS}) s cross join (select distinct feature_id from {_LOG}) f left join {_LOG} l on l.sample_id = s.sample_id and l.feature_id = f.feature_id)"
_MAD = f"(select feature_id, any_value(m) as median, median(abs(value - m)) as mad from (select *, median(value) over (partition by feature_id) as m from {_GRID}) group by 1)"
_TOP = f"(select feature_id from {_MAD} order by floor(mad * 1e9 + 0.5) desc, feature_id limit 50)"


def zscore_sql(frame: str) -> str:
    return f"(select sample_id, feature_id, case when sd = 0 then value - mean else (value - mean) / sd end as value from (select *, avg(value) over (partition by feature_id) as mean, stddev_pop(value) over (partition by feature_id) as sd from {frame}))"


@query("matrix_prep", f"select sample_id, feature_id, {r('value')} as value from {zscore_sql(f'(select * from {_GRID} where feature_id in (select feature_id from {_TOP}))')}")
def matrix_prep(spark, d):
    return rounded(M.prepare_counts(counts(spark, d)), "value").select("sample_id", "feature_id", "value")


@query("cpm", f"select sample_id, feature_id, {r('value')} as value from {_CPM}")
def cpm(spark, d):
    return rounded(M.counts_per_million(counts(spark, d)), "value").select("sample_id", "feature_id", "value")


@query("library_size_summary", f"select {r('median(t)')} as median_size, {r('min(t)')} as min_size, {r('max(t)')} as max_size, count(*) as n from (select sum(value) as t from {COUNTS} group by sample_id)")
def library_size_summary(spark, d):
    own = M.library_size(counts(spark, d))
    return own.agg(r6(F.median("library_size")).alias("median_size"), r6(F.min("library_size")).alias("min_size"), r6(F.max("library_size")).alias("max_size"), F.count("*").alias("n"))


@query("low_count_filter", f"select feature_id, {r('share')} as share_low from (select feature_id, ({_N} - count(*) filter (value >= 1.0)) / cast({_N} as double) as share from {_CPM} group by 1) where share <= 0.8")
def low_count_filter(spark, d):
    own = counts(spark, d)
    return rounded(M.low_count_features(M.counts_per_million(own), own.select("sample_id").distinct().count()), "share_low")


@query("log2p1", f"select sample_id, feature_id, {r('log2(value + 1)')} as value from {COUNTS}")
def log2p1(spark, d):
    return rounded(M.log2p1(counts(spark, d)), "value").select("sample_id", "feature_id", "value")


@query("mad_scores", f"select feature_id, {r('median')} as median, {r('mad')} as mad from {_MAD}")
def mad_scores(spark, d):
    own = counts(spark, d)
    n = own.select("sample_id").distinct().count()
    all_cpm = M.counts_per_million(own)
    kept = M.log2p1(all_cpm.join(M.low_count_features(all_cpm, n), "feature_id", "left_semi"))
    return rounded(M.median_absolute_deviation(kept, n), "median", "mad")


@query("mad_top_n", f"select feature_id from {_TOP}")
def mad_top_n(spark, d):
    own = counts(spark, d)
    n = own.select("sample_id").distinct().count()
    all_cpm = M.counts_per_million(own)
    kept = M.log2p1(all_cpm.join(M.low_count_features(all_cpm, n), "feature_id", "left_semi"))
    return M.top_features(M.median_absolute_deviation(kept, n), "mad", 50).select("feature_id")


@query("zscore", f"select sample_id, feature_id, {r('value')} as value from {zscore_sql(COUNTS)}")
def zscore(spark, d):
    return rounded(M.zscore(counts(spark, d)), "value").select("sample_id", "feature_id", "value")


@query("mad_on_zscores", f"select feature_id, {r('mad')} as mad from (select feature_id, median(abs(value - m)) as mad from (select *, median(value) over (partition by feature_id) as m from {zscore_sql(COUNTS)}) group by 1) order by floor(mad * 1e6 + 0.5) desc, feature_id limit 20")
def mad_on_zscores(spark, d):
    return rounded(M.top_features(M.median_absolute_deviation(M.zscore(counts(spark, d))), "mad", 20, 6), "mad").select("feature_id", "mad")


_BN = f"(select count(distinct sample_id) from {BETA})"


@query("missing_fraction", f"select feature_id, {r(f'({_BN} - count(value)) / cast({_BN} as double)')} as share_null from {BETA} group by 1")
def missing_fraction(spark, d):
    own = beta(spark, d)
    return rounded(M.missing_filter(own, own.select("sample_id").distinct().count(), 1.0), "share_null")


@query("missing_filter", f"select feature_id from {BETA} group by 1 having ({_BN} - count(value)) / cast({_BN} as double) <= 0.2")
def missing_filter(spark, d):
    own = beta(spark, d)
    return M.missing_filter(own, own.select("sample_id").distinct().count()).select("feature_id")


@query("constant_filter", f"select feature_id, {r('stddev_samp(value)')} as sd from {BETA} group by 1 having stddev_samp(value) > 0")
def constant_filter(spark, d):
    return rounded(M.constant_filter(beta(spark, d)), "sd")


_BGRID = f"(select s.sample_id, f.feature_id, l.value from (select distinct sample_id from {BETA}) s cross join (select distinct feature_id from {BETA}) f left join {BETA} l on l.sample_id = s.sample_id and l.feature_id = f.feature_id)"


@query("densify", f"select sample_id, feature_id, {r('value')} as value from {_BGRID}")
def densify(spark, d):
    return rounded(M.densify(beta(spark, d)), "value").select("sample_id", "feature_id", "value")


@query("impute_feature_median", f"select sample_id, feature_id, {r('coalesce(value, median(value) over (partition by feature_id))')} as value from {_BGRID}")
def impute_feature_median(spark, d):
    return rounded(M.impute_median(M.densify(beta(spark, d))), "value").select("sample_id", "feature_id", "value")


@query("impute_feature_mean", f"select sample_id, feature_id, {r('coalesce(value, avg(value) over (partition by feature_id), 0.0)')} as value from {_BGRID}")
def impute_feature_mean(spark, d):
    return rounded(M.impute_mean(M.densify(beta(spark, d))), "value").select("sample_id", "feature_id", "value")


@query("winsorise", f"select sample_id, feature_id, {r('greatest(least(value, 5.0), -5.0)')} as value from {zscore_sql(COUNTS)}")
def winsorise(spark, d):
    return rounded(M.winsorise(M.zscore(counts(spark, d))), "value").select("sample_id", "feature_id", "value")


def _unit(frame: str) -> str:
    return f"(select sample_id, feature_id, case when nrm = 0 then value else value / nrm end as value from (select *, sqrt(sum(value * value) over (partition by sample_id)) as nrm from {frame}))"


@query("l2_normalise", f"select sample_id, feature_id, {r('value')} as value from {_unit(COUNTS)}")
def l2_normalise(spark, d):
    return rounded(M.unit_samples(counts(spark, d)), "value").select("sample_id", "feature_id", "value")


_COHORT = "(select s_suppkey as sample_id from supplier where s_nationkey < 12)"


@query("load_modality", f"select sample_id, feature_id, {r('value')} as value from {_unit(f'(select sample_id, feature_id, greatest(least(value, 5.0), -5.0) as value from {zscore_sql(COUNTS)} where sample_id in (select sample_id from {_COHORT}))')}")
def load_modality(spark, d):
    cohort = table(spark, d, "supplier").where("s_nationkey < 12").select(F.col("s_suppkey").alias("sample_id"))
    return rounded(M.load_modality(M.zscore(counts(spark, d)), cohort), "value").select("sample_id", "feature_id", "value")


_EXCLUDE = "('f' || cast(p_partkey % 100 as varchar))"
_BKEPT = f"(select * from {BETA} where feature_id not in (select {_EXCLUDE} from part where p_brand = 'Brand#2' and p_size > 45) and not starts_with(feature_id, 'f9'))"
_BFEAT = f"(select feature_id from {_BKEPT} group by 1 having ({_BN} - count(value)) / cast({_BN} as double) <= 0.2)"
_BFULL = f"(select sample_id, feature_id, coalesce(value, median(value) over (partition by feature_id)) as value from (select s.sample_id, f.feature_id, l.value from (select distinct sample_id from {_BKEPT} where feature_id in (select feature_id from {_BFEAT})) s cross join {_BFEAT} f left join {_BKEPT} l on l.sample_id = s.sample_id and l.feature_id = f.feature_id))"
_BMAD = f"(select feature_id, median(abs(value - m)) as mad from (select *, median(value) over (partition by feature_id) as m from {_BFULL}) group by 1)"


@query("beta_prep", f"select sample_id, feature_id, {r('value')} as value from {zscore_sql(f'(select * from {_BFULL} where feature_id in (select feature_id from {_BMAD} order by floor(mad * 1e9 + 0.5) desc, feature_id limit 50))')}")
def beta_prep(spark, d):
    listed = table(spark, d, "part").where("p_brand = 'Brand#2' and p_size > 45").select(F.concat(F.lit("f"), (F.col("p_partkey") % 100).cast("string")).alias("feature_id"))
    return rounded(M.prepare_beta(beta(spark, d), [listed], drop_prefix="f9"), "value").select("sample_id", "feature_id", "value")


@query("concat_blocks", f"select sample_id, count(*) as n_features, {r('sum(value)')} as total from (select sample_id, 'a:' || cast(feature_id as varchar) as f, value from {COUNTS} where sample_id in (select sample_id from {BETA}) union all select sample_id, 'b:' || feature_id, value from {BETA} where sample_id in (select sample_id from {COUNTS})) group by 1")
def concat_blocks(spark, d):
    both = M.concat_blocks({"a": counts(spark, d), "b": beta(spark, d)})
    return both.groupBy("sample_id").agg(F.count("*").alias("n_features"), r6(F.sum("value")).alias("total"))


@query("to_vectors", f"select sample_id, len(v) as n, {r('v[1]')} as first_value, {r('v[len(v)]')} as last_value from (select sample_id, list(value order by feature_id) as v from {COUNTS} group by 1)")
def to_vectors(spark, d):
    own = M.to_vectors(counts(spark, d))
    return own.select("sample_id", F.size("vec").cast("long").alias("n"), r6(F.element_at("vec", 1)).alias("first_value"), r6(F.element_at("vec", -1)).alias("last_value"))


@query("matrix_summary", f"select {r('avg(abs(value))')} as mean_abs, {r('min(value)')} as low, {r('max(value)')} as high, {r('avg(value)')} as mean from {zscore_sql(COUNTS)}")
def matrix_summary(spark, d):
    return M.zscore(counts(spark, d)).agg(r6(F.avg(F.abs("value"))).alias("mean_abs"), r6(F.min("value")).alias("low"), r6(F.max("value")).alias("high"), r6(F.avg("value")).alias("mean"))


QUERIES, ORACLES = query.QUERIES, query.ORACLES
