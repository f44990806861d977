"""Queries on survival data and test statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lathework.frames import global_rank, hash_order
from lathework.functions.columns import r6
from lathework.operators import relate as R
from lathework.operators import survival as S
from lathework.operators import tests as T
from lathework.plans.base import PATIENTS, SURVIVAL, Registry, patients, r, rounded, survival
from lathework.session import table

query = Registry()

_LIFE = f"(select grp, time, d, c, cast(sum(d + c) over (partition by grp order by time rows between current row and unbounded following) as bigint) as n from (select grp, time, cast(count(*) filter (event) as bigint) as d, cast(count(*) filter (not event) as bigint) as c from {SURVIVAL} group by 1, 2))"


@query("life_table", f"select * from {_LIFE}")
def life_table(spark, d):
    return S.life_table(survival(spark, d), "grp")


_KM = f"""(select grp, time, n, d, case when dead = 1 then 0.0 else exp(ls) end as s, sqrt(gv) as v from (select *, max(case when d = n then 1 else 0 end) over w as dead,
 sum(case when d < n then ln(1 - d / cast(n as double)) end) over w as ls, sum(case when d < n then d / (cast(n as double) * (n - d)) end) over w as gv from {_LIFE} where d > 0 window w as (partition by grp order by time rows between unbounded preceding and current row)))"""


@query("kaplan_meier", f"select grp, time, n, d, {r('s')} as s, {r('case when s = 0 then 0.0 else least(1.0, s * exp(-1.959963984540054 * v)) end')} as low, {r('case when s = 0 then 0.0 else least(1.0, s * exp(1.959963984540054 * v)) end')} as high from {_KM}")
def kaplan_meier(spark, d):
    return rounded(S.kaplan_meier(survival(spark, d), "grp"), "s", "low", "high")


@query("median_survival", f"select g.grp, k.median from (select distinct grp from {SURVIVAL}) g left join (select grp, min(time) as median from {_KM} where s <= 0.5 group by 1) k using (grp)")
def median_survival(spark, d):
    return S.median_survival(survival(spark, d), "grp")


def _risk(where: str = "true") -> str:
    own = f"(select * from {SURVIVAL} where {where})"
    return f"""(with own as {own}, cells as (select grp, time, count(*) filter (event) as dg, count(*) as m from own group by 1, 2),
 grid as (select t.time, g.grp, coalesce(dg, 0) as dg, coalesce(m, 0) as m from (select distinct time from own) t cross join (select distinct grp from own) g left join cells c on c.time = t.time and c.grp = g.grp),
 run as (select *, sum(m) over (partition by grp order by time rows between current row and unbounded following) as ng from grid)
 select time, grp, dg, ng::double as ng, sum(dg) over (partition by time)::double as d, sum(ng) over (partition by time)::double as n from run where time in (select time from own where event))"""


@query("log_rank_parts", f"select grp, sum(dg)::double as observed, {r('sum(d * ng / n)')} as expected from {_risk()} group by 1")
def log_rank_parts(spark, d):
    return rounded(S.log_rank_parts(survival(spark, d), "grp"), "expected")


_TWO = "grp in ('BUILDING', 'MACHINERY')"


@query("log_rank_two", f"select o as observed, {r('e')} as expected, {r('v')} as variance, {r('(o - e) * (o - e) / v')} as chi2 from (select sum(dg)::double as o, sum(d * ng / n) as e, sum(case when n > 1 then d * (ng / n) * (1 - ng / n) * (n - d) / (n - 1) else 0 end) as v from {_risk(_TWO)} where grp = 'BUILDING')")
def log_rank_two(spark, d):
    return rounded(S.log_rank_two(survival(spark, d).where(_TWO), "grp"), "expected", "variance", "chi2")


#: All rows in three groups, for which the covariances of two have a closed inverse.
_THREE = "(select * replace (case grp when 'BUILDING' then 'a' when 'MACHINERY' then 'b' else 'c' end as grp) from own0)"


@query("log_rank_many", f"""with x as ({_risk().replace(f'(select * from {SURVIVAL} where true)', f"(with own0 as (select * from {SURVIVAL}) select * from {_THREE})")}),
 y as (select time, any_value(d) as d, any_value(n) as n, max(dg) filter (grp = 'a') as da, max(dg) filter (grp = 'b') as db, max(ng) filter (grp = 'a') as na, max(ng) filter (grp = 'b') as nb from x group by 1),
 s as (select sum(da - d * na / n) as ua, sum(db - d * nb / n) as ub, sum(f * na / n * (1 - na / n)) as vaa, sum(f * nb / n * (1 - nb / n)) as vbb, -sum(f * na * nb / (n * n)) as vab from (select *, case when n > 1 then d * (n - d) / (n - 1) else 0 end as f from y)),
 q as (select (ua * ua * vbb - 2 * ua * ub * vab + ub * ub * vaa) / (vaa * vbb - vab * vab) as chi2 from s)
 select {r('chi2')} as chi2, 2 as df, {r('exp(-chi2 / 2)')} as p from q""")
def log_rank_many(spark, d):
    own = survival(spark, d).withColumn("grp", F.when(F.col("grp") == "BUILDING", "a").when(F.col("grp") == "MACHINERY", "b").otherwise("c"))
    stat, df, p = S.log_rank_many(own, "grp")
    return rounded(spark.createDataFrame([(stat, df, p)], "chi2 double, df int, p double"), "chi2", "p")


_CMP = "a.event and (a.time < b.time or (a.time = b.time and not b.event))"


@query("concordance_index", f"select good as concordant, n as comparable, {r('good / n')} as c from (select sum(case when a.risk > b.risk then 1.0 when a.risk = b.risk then 0.5 else 0 end)::double as good, count(*)::double as n from {PATIENTS} a join {PATIENTS} b on {_CMP})")
def concordance_index(spark, d):
    return rounded(S.concordance(patients(spark, d)), "c")


_B = 1_000
_RANKED = f"(select *, row_number() over (order by pid) - 1 as rank, (pid * 7919 % 1009)::double as other from {PATIENTS})"
#: Each patient's comparisons with all others, and each resample's multiplicities, as lists in rank order: sums over pairs are dot products.
_BOOT = f"""(with p as materialized {_RANKED}, n as (select count(*) as n from p), w as materialized (select b, cast('0x' || substr(md5('b-' || b || '-' || k), 1, 8) as bigint) % n as rank, count(*) as m from (select unnest(range(0, {_B})) as b) x, (select unnest(range(0, (select n from n))) as k) y, n group by 1, 2),
 wl as materialized (select x.b, list(coalesce(m, 0)::double order by p.rank) as wv from (select unnest(range(0, {_B})) as b) x cross join p left join w on w.b = x.b and w.rank = p.rank group by 1),
 gl as materialized (select i, list(c order by j) as nv, list(c * g order by j) as gv, list(c * h order by j) as hv from (select a.rank as i, b.rank as j, case when {_CMP} then 1.0::double else 0.0::double end as c, case when a.risk > b.risk then 1.0::double when a.risk = b.risk then 0.5::double else 0.0::double end as g, case when a.other > b.other then 1.0::double when a.other = b.other then 0.5::double else 0.0::double end as h from p a cross join p b where a.event) group by 1)
 select b, sum(wv[i + 1] * list_dot_product(gv, wv)) / sum(wv[i + 1] * list_dot_product(nv, wv)) as c_risk, sum(wv[i + 1] * list_dot_product(hv, wv)) / sum(wv[i + 1] * list_dot_product(nv, wv)) as c_other from wl cross join gl group by 1)"""


def _boot(spark, d):
    ranked = global_rank(patients(spark, d).withColumn("other", (F.col("pid") * 7919 % 1009).cast("double")), "pid")
    return S.bootstrap_concordance(ranked, ["risk", "other"], _B)


@query("bootstrap_ci", f"select {r('avg(c_risk)')} as mean, {r('quantile_cont(c_risk, 0.025)')} as ci_lower, {r('quantile_cont(c_risk, 0.975)')} as ci_upper, count(*) as n from {_BOOT}")
def bootstrap_ci(spark, d):
    return rounded(S.interval(_boot(spark, d), "c_risk"), "mean", "ci_lower", "ci_upper")


@query("bootstrap_delta", f"select *, (ci_lower > 0 or ci_upper < 0) as ci_excludes_zero, (ci_lower > 0 or ci_upper < 0) and mean >= 0.03 as meets_criterion from (select {r('avg(c_risk - c_other)')} as mean, {r('quantile_cont(c_risk - c_other, 0.025)')} as ci_lower, {r('quantile_cont(c_risk - c_other, 0.975)')} as ci_upper, count(*) as n from {_BOOT})")
def bootstrap_delta(spark, d):
    return rounded(S.delta_interval(_boot(spark, d), "risk", "other"), "mean", "ci_lower", "ci_upper")


_FOLDS = f"(select pid, seed, (row_number() over (partition by seed order by cast('0x' || substr(md5(seed || '-' || pid), 1, 8) as bigint), pid) - 1) % 5 as fold from {PATIENTS}, (select unnest(range(0, 5)) as seed))"


def folds(spark, d):
    own = patients(spark, d).select("pid", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("seed"))
    order = Window.partitionBy("seed").orderBy(hash_order(F.col("seed"), F.col("pid")), "pid")
    return own.withColumn("fold", ((F.row_number().over(order) - 1) % 5).cast("long"))


@query("cv_folds", f"select pid, seed, fold from {_FOLDS}")
def cv_folds(spark, d):
    return folds(spark, d)


@query("oof_assembly", f"select f.pid, case when e.n >= 2 then {r('p.risk / 100')} end as risk from {_FOLDS} f join {PATIENTS} p using (pid) join (select seed, fold, count(*) filter (event) as n from {_FOLDS} join {PATIENTS} using (pid) group by 1, 2) e on e.seed = f.seed and e.fold = f.fold where f.seed = 2")
def oof_assembly(spark, d):
    """Out-of-fold risks of one seed; folds with fewer than two events stay null."""
    own = folds(spark, d).join(patients(spark, d).select("pid", "event", "risk"), "pid")
    enough = own.groupBy("seed", "fold").agg(F.count_if("event").alias("n"))
    return own.where("seed = 2").join(enough, ["seed", "fold"]).select("pid", F.when(F.col("n") >= 2, r6(F.col("risk") / 100)).alias("risk"))


@query("late_fusion_average", f"select pid, {r('avg(x)')} as risk from (select pid, risk as x from {PATIENTS} union all select pid, case when pid % 3 > 0 then time end from {PATIENTS} union all select pid, cast(stage as double) from {PATIENTS}) group by 1")
def late_fusion_average(spark, d):
    """The mean of several models' risks, without those that are missing."""
    own = patients(spark, d)
    risks = own.select("pid", F.explode(F.array("risk", F.when(F.col("pid") % 3 > 0, F.col("time")), F.col("stage").cast("double"))).alias("x"))
    return risks.groupBy("pid").agg(r6(F.avg("x")).alias("risk"))


_GAPS = f"(select f.*, case when f.pid % 5 > 0 then p.risk end as age, case when f.pid % 7 > 0 then p.stage end as stage from {_FOLDS} f join {PATIENTS} p using (pid) where seed = 0)"


@query("infold_impute", f"select t.fold as test_fold, g.pid, {r('coalesce(g.age, t.m)')} as age, {r('coalesce(g.stage, t.s)')} as stage from {_GAPS} g join (select k.fold, median(age) as m, avg(stage) as s from (select unnest(range(0, 5)) as fold) k join {_GAPS} x on x.fold <> k.fold group by 1) t on true")
def infold_impute(spark, d):
    """Covariates for each test fold, with gaps filled from its training rows only: median age, mean stage."""
    own = folds(spark, d).where("seed = 0").join(patients(spark, d), "pid").select("pid", "fold", F.when(F.col("pid") % 5 > 0, F.col("risk")).alias("age"), F.when(F.col("pid") % 7 > 0, F.col("stage")).alias("stage"))
    tests = own.withColumn("test_fold", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    fill = tests.where("fold <> test_fold").groupBy("test_fold").agg(F.median("age").alias("m"), F.avg("stage").alias("s"))
    return tests.join(F.broadcast(fill), "test_fold").select("test_fold", "pid", r6(F.coalesce("age", "m")).alias("age"), r6(F.coalesce(F.col("stage").cast("double"), "s")).alias("stage"))


def _chi(frame: str, a: str, b: str) -> str:
    return f"""(with n as (select {a} as a, {b} as b, count(*) as o from {frame} where {a} is not null and {b} is not null group by 1, 2), ra as (select a, sum(o) as ra from n group by 1), rb as (select b, sum(o) as rb from n group by 1),
 c as (select coalesce(o, 0)::double as o, ra::double * rb::double / (select sum(o) from n)::double as e from ra cross join rb left join n on n.a = ra.a and n.b = rb.b), k as (select (select count(*) from ra) as p, (select count(*) from rb) as q)
 select sum(case when p = 2 and q = 2 then power(abs(o - e) - least(0.5, abs(o - e)), 2) else power(o - e, 2) end / e) as chi2, any_value((p - 1) * (q - 1)) as df, cast(sum(o) as bigint) as n from c, k)"""


@query("chi2_two_by_two", f"select {r('chi2')} as chi2, df, n from {_chi('labels', 'quality', 'toxic')}")
def chi2_two_by_two(spark, d):
    return rounded(T.chi2_independence(table(spark, d, "labels"), "quality", "toxic"), "chi2")


@query("chi2_many_levels", f"select {r('chi2')} as chi2, df, n from {_chi('events', 'event_type', 'user_id % 4')}")
def chi2_many_levels(spark, d):
    return rounded(T.chi2_independence(table(spark, d, "events").select("event_type", (F.col("user_id") % 4).alias("u")), "event_type", "u"), "chi2")


_U = """(select f, v, l, cast(rank() over (partition by f order by v) as double) + (count(*) over (partition by f, v) - 1) / 2.0::double as rk from (select {f} as f, {v} as v, {l} as l from {frame}))"""
_EVENTS_U = _U.format(f="event_type", v="value", l="user_id % 2", frame="events")


@query("rank_sum", f"""with x as {_EVENTS_U}, s as (select f, sum(rk) filter (l = 1) as r1, count(*) filter (l = 1)::double as n1, count(*)::double as n from x group by 1), tt as (select f, sum(m * m * m - m) as ties from (select f, v, count(*)::double as m from x group by 1, 2) group by 1),
 q as (select s.f, n1, n - n1 as n0, r1 - n1 * (n1 + 1) / 2 as u, n1 * (n - n1) / 12 * ((n + 1) - ties / (n * (n - 1))) as var from s join tt using (f))
 select f as event_type, {r('u')} as u, {r('sign(u - n1 * n0 / 2) * greatest(abs(u - n1 * n0 / 2) - 0.5, 0) / sqrt(var)')} as z, cast(n1 as bigint) as n1, cast(n0 as bigint) as n0 from q""")
def rank_sum(spark, d):
    own = table(spark, d, "events").select("event_type", (F.col("user_id") % 2).alias("label"), "value")
    return rounded(T.rank_sum(own, "event_type", "label", "value"), "u", "z")


_DE = "(select l_partkey % 200 as feature_id, l_suppkey % 2 as label, l_extendedprice as value from lineitem)"
_DELTA = f"(select feature_id, avg(value) filter (label = 1) as mean_1, avg(value) filter (label = 0) as mean_0, avg(value) filter (label = 1) - avg(value) filter (label = 0) as delta from {_DE} group by 1)"
_PICK = f"(select * from (select * from {_DELTA} order by floor(delta * 1e4 + 0.5) desc, feature_id limit 20) union select * from (select * from {_DELTA} order by floor(delta * 1e4 + 0.5), feature_id limit 20))"


def _delta(spark, d):
    own = table(spark, d, "lineitem").select((F.col("l_partkey") % 200).alias("feature_id"), (F.col("l_suppkey") % 2).alias("label"), F.col("l_extendedprice").alias("value"))
    return own, R.group_mean_delta(own, "feature_id", "label", "value")


@query("differential_features", f"""with x as {_U.format(f='feature_id', v='value', l='label', frame=f'{_DE} where feature_id in (select feature_id from {_PICK})')}, s as (select f, sum(rk) filter (l = 1) as r1, count(*) filter (l = 1) as n1 from x group by 1)
 select p.feature_id, {r('mean_1', 4)} as mean_1, {r('mean_0', 4)} as mean_0, {r('delta', 4)} as delta, case when delta > 0 then 'UP' else 'DOWN' end as direction, {r('r1 - n1 * (n1 + 1) / 2')} as u, coalesce(n_name, 'part ' || p.feature_id) as symbol from {_PICK} p join s on s.f = p.feature_id left join nation on n_nationkey = p.feature_id""")
def differential_features(spark, d):
    """Largest and smallest differences of group means, the rank-sum statistic only for these, and symbols."""
    own, delta = _delta(spark, d)
    picked = R.extremes(delta, F.floor(F.col("delta") * 1e4 + 0.5), 20, "feature_id")
    u = T.rank_sum(own.join(picked.select("feature_id"), "feature_id", "left_semi"), "feature_id", "label", "value").select("feature_id", "u")
    names = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("feature_id"), "n_name")
    return picked.join(u, "feature_id").join(names, "feature_id", "left").select(
        "feature_id", r6("mean_1", 4).alias("mean_1"), r6("mean_0", 4).alias("mean_0"), r6("delta", 4).alias("delta"), F.when(F.col("delta") > 0, "UP").otherwise("DOWN").alias("direction"), r6("u").alias("u"),
        F.coalesce("n_name", F.concat(F.lit("part "), F.col("feature_id").cast("string"))).alias("symbol"),
    )


@query("deduplicated_loci", f"""with k as (select feature_id, floor(delta / 100 + 0.5) as key from {_DELTA}), q as (select *, row_number() over (partition by key order by feature_id % 3 desc, feature_id) as rn from k)
 select * from (select feature_id, key from q where rn = 1 order by key desc limit 10) union select * from (select feature_id, key from q where rn = 1 order by key limit 10)""")
def deduplicated_loci(spark, d):
    """Features with the same rounded difference are one segment: the best-named one stands for it."""
    _, delta = _delta(spark, d)
    own = delta.select("feature_id", F.floor(F.col("delta") / 100 + 0.5).cast("double").alias("key"))
    once = R.keep_first(own, ["key"], [(F.col("feature_id") % 3).desc(), F.col("feature_id")])
    return R.extremes(once, F.col("key"), 10, "feature_id")


@query("receptor_table", f"""select lang as cluster, count(*) as n, count(*) filter (quality = 1) as q_pos, {r('100.0 * count(*) filter (quality = 1) / count(*)')} as q_pct, count(*) filter (toxic = 1) as t_pos, {r('100.0 * count(*) filter (toxic = 1) / count(*)')} as t_pct,
 count(*) filter (quality = 0 and toxic = 0) as neg, {r('100.0 * count(*) filter (quality = 0 and toxic = 0) / count(*)')} as neg_pct, {r(f"(select chi2 from {_chi('(select d.lang, l.quality from documents d join labels l using (doc_id))', 'lang', 'quality')})")} as q_chi2 from (select d.lang, l.quality, l.toxic from documents d left join labels l using (doc_id)) group by 1""")
def receptor_table(spark, d):
    both = R.left_labels(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), "doc_id")
    n = F.count("*")
    counts = {"q_pos": ("q_pct", F.col("quality") == 1), "t_pos": ("t_pct", F.col("toxic") == 1), "neg": ("neg_pct", (F.col("quality") == 0) & (F.col("toxic") == 0))}
    out = both.groupBy(F.col("lang").alias("cluster")).agg(n.alias("n"), *[c for a, (b, x) in counts.items() for c in (F.count_if(x).alias(a), r6(100 * F.count_if(x) / n).alias(b))])
    return out.crossJoin(F.broadcast(T.chi2_independence(both, "lang", "quality").select(r6("chi2").alias("q_chi2"))))


@query("fold_summary", f"select seed, {r('avg(m)')} as mean, {r('stddev_pop(m)')} as sd from (select seed, fold, avg(risk) as m from {_FOLDS} join {PATIENTS} using (pid) group by 1, 2) group by 1")
def fold_summary(spark, d):
    m = folds(spark, d).join(patients(spark, d).select("pid", "risk"), "pid").groupBy("seed", "fold").agg(F.avg("risk").alias("m"))
    return m.groupBy("seed").agg(r6(F.avg("m")).alias("mean"), r6(F.stddev_pop("m")).alias("sd"))


QUERIES, ORACLES = query.QUERIES, query.ORACLES
