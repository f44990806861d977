"""Queries that assemble result tables and the frames behind figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from lathework.functions.columns import r6
from lathework.operators import relate as R
from lathework.operators import report as P
from lathework.operators import survival as S
from lathework.plans.base import SURVIVAL, Registry, r, rounded, survival
from lathework.plans.survival_queries import _KM
from lathework.session import table

query = Registry()

_A = "(select 'm' || (l_suppkey % 9) as method, avg(l_tax) as ari from lineitem where l_suppkey % 9 < 7 group by 1)"
_B = "(select 'm' || (o_custkey % 9) as method, avg(o_totalprice) / 1e6 as c from orders where o_custkey % 9 > 2 group by 1)"
_NAME = "case {m} when 'm3' then 'Fused' when 'm4' then 'Single' else {m} end"


def _metrics(spark, d):
    a = table(spark, d, "lineitem").where("l_suppkey % 9 < 7").groupBy(F.concat(F.lit("m"), (F.col("l_suppkey") % 9).cast("string")).alias("method")).agg(F.avg("l_tax").alias("ari"))
    b = table(spark, d, "orders").where("o_custkey % 9 > 2").groupBy(F.concat(F.lit("m"), (F.col("o_custkey") % 9).cast("string")).alias("method")).agg((F.avg("o_totalprice") / 1e6).alias("c"))
    return a, b


@query("master_table", f"select {_NAME.format(m='coalesce(a.method, b.method)')} as method, {r('ari')} as ari, {r('c')} as c from {_A} a full join {_B} b on a.method = b.method")
def master_table(spark, d):
    return rounded(P.master_table(*_metrics(spark, d), {"m3": "Fused", "m4": "Single"}), "ari", "c")


@query("metric_bars", f"select o.position::int as position, o.method, {r('c')} as c from (values (0, 'm5'), (1, 'm1'), (2, 'm8')) o(position, method) left join {_B} b using (method)")
def metric_bars(spark, d):
    return rounded(P.ordered(_metrics(spark, d)[1], "method", ["m5", "m1", "m8"]), "c").select("position", "method", "c")


@query("curve_points", f"select grp, {r('months')} as months, {r('s')} as s from (select distinct grp, 0.0::double as months, 1.0::double as s from {SURVIVAL} union all select grp, time / 30.4375::double, s from {_KM})")
def curve_points(spark, d):
    return rounded(P.curve_points(S.kaplan_meier(survival(spark, d), "grp"), "grp"), "months", "s")


@query("forest_plot", "select grp, v, floor((v - lo) * 1e6 + 0.5) / 1e6 as down, floor((hi - v) * 1e6 + 0.5) / 1e6 as up, cast(row_number() over (order by v desc, grp) - 1 as int) as position from (select event_type as grp, floor(avg(value) * 1e6 + 0.5) / 1e6 as v, quantile_cont(value, 0.025) as lo, quantile_cont(value, 0.975) as hi from events group by 1)")
def forest_plot(spark, d):
    own = table(spark, d, "events").groupBy(F.col("event_type").alias("grp")).agg(r6(F.avg("value")).alias("v"), F.percentile("value", F.lit(0.025)).alias("lo"), F.percentile("value", F.lit(0.975)).alias("hi"))
    return rounded(P.forest(own, "grp", "v", "lo", "hi"), "down", "up")


@query("stacked_shares", f"""select lang, s.status, count(*) filter (d.status = s.status) as n, {r('100.0 * count(*) filter (d.status = s.status) / count(*)')} as pct from (select lang, case quality when 1 then 'Positive' when 0 then 'Negative' else 'Not Evaluated' end as status from documents left join labels using (doc_id)) d,
 (values ('Positive'), ('Negative'), ('Equivocal'), ('Not Evaluated')) s(status) group by 1, 2""")
def stacked_shares(spark, d):
    both = R.left_labels(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), "doc_id")
    status = F.when(F.col("quality") == 1, "Positive").when(F.col("quality") == 0, "Negative").otherwise("Not Evaluated")
    return rounded(P.stacked_shares(both.withColumn("status", status), "lang", "status", ["Positive", "Negative", "Equivocal", "Not Evaluated"]), "pct")


@query("contingency_heatmap", f"select event_type, u, n, {r('n / sum(n) over (partition by event_type)')} as share from (select event_type, user_id % 4 as u, count(*) as n from events group by 1, 2)")
def contingency_heatmap(spark, d):
    own = R.crosstab(table(spark, d, "events").select("event_type", (F.col("user_id") % 4).alias("u")), "event_type", "u")
    return own.withColumn("share", r6(F.col("share") / 100))


@query("sweep_lines", f"select cast(regexp_extract(c, 'K=(\\d+)', 1) as int) as k, {r('avg(v)')} as ari, count(*) as n from (select 'K=' || cast(p_size % 5 * 5 + 5 as varchar) || ' · ' || lower(p_type) as c, p_retailprice / 1e4 as v from part) where contains(c, 'K=') and contains(c, 'promo') group by 1")
def sweep_lines(spark, d):
    own = table(spark, d, "part").select(F.concat(F.lit("K="), (F.col("p_size") % 5 * 5 + 5).cast("string"), F.lit(" · "), F.lower("p_type")).alias("c"), (F.col("p_retailprice") / 1e4).alias("v"))
    some = own.where(F.contains("c", F.lit("K=")) & F.contains("c", F.lit("promo")))
    return some.groupBy(F.regexp_extract("c", r"K=(\d+)", 1).cast("int").alias("k")).agg(r6(F.avg("v")).alias("ari"), F.count("*").alias("n"))


@query("lollipop", "select c_custkey as id, c_name as symbol, c_acctbal as delta, case when c_acctbal > 0 then 'UP' else 'DOWN' end as direction from (select * from (select * from customer order by c_acctbal desc, c_custkey limit 10) union select * from (select * from customer order by c_acctbal, c_custkey limit 10))")
def lollipop(spark, d):
    own = R.extremes(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("symbol"), F.col("c_acctbal").alias("delta")), F.col("delta"), 10, "id")
    return own.withColumn("direction", F.when(F.col("delta") > 0, "UP").otherwise("DOWN"))


QUERIES, ORACLES = query.QUERIES, query.ORACLES
