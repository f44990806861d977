"""The jobs as queries over the whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common, follow_up, term_matrix


def job1_term_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.twice(spark, "job1", lambda out: term_matrix.run(spark, f"{sf_dir}/documents.parquet", out)).select("sample_id", "feature_id", "value")


def job2_follow_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.twice(spark, "job2", lambda out: follow_up.run(spark, f"{sf_dir}/events.parquet", out)).select(F.col("day").cast("string").alias("day"), "sample_id", "feature_id", "n", "total")


_HOW = common.defaults(term_matrix.__file__)
JOB1_SQL = rf"""
with words as (
  select coalesce(source, '(none)') as sample_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) as feature_id from documents where text is not null
), counts as (
  select sample_id, feature_id, count(*)::double as value from words where length(feature_id) >= {_HOW["min_letters"]} group by 1, 2
), size as (
  select count(distinct sample_id) as n from counts
), cpm as (
  select sample_id, feature_id, value / sum(value) over (partition by sample_id) * 1e6 as value from counts
), kept as (
  select feature_id from cpm, size group by feature_id, n having (n - count(*) filter (value >= 1.0)) / n::double <= 0.8
), grid as (
  select s.sample_id, k.feature_id, log2(coalesce(c.value, 0.0) + 1) as value
  from (select distinct sample_id from counts) s cross join kept k left join cpm c on c.sample_id = s.sample_id and c.feature_id = k.feature_id
), mad as (
  select feature_id, median(abs(value - m)) as mad from (select *, median(value) over (partition by feature_id) as m from grid) group by 1
), best as (
  select feature_id from mad order by floor(mad * 1e9 + 0.5) desc, feature_id limit {_HOW["n_top"]}
), scaled as (
  select *, avg(value) over (partition by feature_id) as mean, stddev_pop(value) over (partition by feature_id) as sd from grid where feature_id in (select feature_id from best)
)
select sample_id, feature_id, floor((case when sd = 0 then value - mean else (value - mean) / sd end) * 1e6 + 0.5) / 1e6 as value from scaled
"""
JOB2_SQL = "select cast(cast(ts as date) as varchar) as day, user_id as sample_id, event_type as feature_id, count(*) as n, floor(sum(value) * 1e6 + 0.5) / 1e6 as total from events group by 1, 2, 3"

QUERIES = {"job1_term_matrix": job1_term_matrix, "job2_follow_up": job2_follow_up}
ORACLES = {"job1_term_matrix": JOB1_SQL, "job2_follow_up": JOB2_SQL}
