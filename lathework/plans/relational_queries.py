"""Queries on sources, projections, joins, sets, aggregates, windows and top-k."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lathework.frames import quantiles
from lathework.functions import columns as C
from lathework.functions.columns import r6
from lathework.operators import relate as R
from lathework.plans.base import SURVIVAL, Registry, r, survival
from lathework.session import table
from lathework.sources.predicates import all_of

query = Registry()


def t(spark, d, name):
    return table(spark, d, name)


# sources -----------------------------------------------------------------------------------------------------------


@query("pushed_predicates", "select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' and o_orderpriority = '1-URGENT'")
def pushed_predicates(spark, d):
    return t(spark, d, "orders").where(all_of({"o_orderstatus": "F"}, {"o_orderpriority": "1-URGENT"})).select("o_orderkey", "o_totalprice")


@query("flatten_first", "select l_orderkey, coalesce(l_returnflag, '') as first_flag from (select l_orderkey, l_returnflag, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as rn from lineitem) where rn = 1")
def flatten_first(spark, d):
    nested = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag"))).alias("lines"))
    return nested.select("l_orderkey", F.coalesce(F.get("lines", 0)["l_returnflag"], F.lit("")).alias("first_flag"))


@query("json_field", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_field(spark, d):
    return t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("fallback_scan", "select event_id, value from events where event_type = 'absent' union all select event_id, value from events where event_type = 'error' and not exists (select 1 from events where event_type = 'absent')")
def fallback_scan(spark, d):
    own = t(spark, d, "events").select("event_id", "value", "event_type")
    return R.fallback(own.where("event_type = 'absent'"), own.where("event_type = 'error'")).select("event_id", "value")


@query("row_count", "select count(*) as n from lineitem")
def row_count(spark, d):
    return t(spark, d, "lineitem").agg(F.count("*").alias("n"))


@query("truncation_check", "select count(*) as retrieved, max(event_id) + 1 as total, count(*) < max(event_id) + 1 as truncated from events")
def truncation_check(spark, d):
    return t(spark, d, "events").agg(F.count("*").alias("retrieved"), (F.max("event_id") + 1).alias("total"), (F.count("*") < F.max("event_id") + 1).alias("truncated"))


@query("patch_columns", "select e.event_id, coalesce(case when p.k is not null then e.value * 2 end, e.value) as value from events e left join (select distinct event_id as k from events where event_type = 'error') p on e.event_id = p.k")
def patch_columns(spark, d):
    own = t(spark, d, "events").select("event_id", "value", "event_type")
    fix = own.where("event_type = 'error'").select("event_id", (F.col("value") * 2).alias("corrected"))
    return own.join(fix, "event_id", "left").select("event_id", F.coalesce("corrected", "value").alias("value"))


@query("symbol_lookup", "select p.p_partkey, coalesce(n.n_name, split_part(p.p_brand, '#', 2)) as symbol from part p left join nation n on n.n_nationkey = p.p_size")
def symbol_lookup(spark, d):
    names = t(spark, d, "nation").select(F.col("n_nationkey").alias("p_size"), "n_name")
    return t(spark, d, "part").join(names, "p_size", "left").select("p_partkey", F.coalesce("n_name", F.split_part("p_brand", F.lit("#"), F.lit(2))).alias("symbol"))


@query("formatted_sink_frame", f"select event_type, {r('avg(value)', 9)} as full_value, {r('avg(value)', 4)} as short_value from events group by 1")
def formatted_sink_frame(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(r6(F.avg("value"), 9).alias("full_value"), r6(F.avg("value"), 4).alias("short_value"))


# projections -------------------------------------------------------------------------------------------------------


@query("barcode_patient", "select url, split_part(url, '/', 1) || '/' || split_part(url, '/', 2) || '/' || split_part(url, '/', 3) as lead from pages where len(string_split(url, '/')) >= 3")
def barcode_patient(spark, d):
    return t(spark, d, "pages").where(F.size(F.split("url", "/")) >= 3).select("url", C.leading_fields(F.col("url"), "/", 3).alias("lead"))


@query("barcode_site", "select p_partkey, case when contains(p_brand, '#') then split_part(p_brand, '#', 2) else 'UNK' end as site, case when contains(p_name, '#') then split_part(p_name, '#', 2) else 'UNK' end as none from part")
def barcode_site(spark, d):
    return t(spark, d, "part").select("p_partkey", C.field_or(F.col("p_brand"), "#", 2, "UNK").alias("site"), C.field_or(F.col("p_name"), "#", 2, "UNK").alias("none"))


@query("strip_version", "select url, split_part(url, '.', 1) as stem from pages")
def strip_version(spark, d):
    return t(spark, d, "pages").select("url", C.strip_version(F.col("url")).alias("stem"))


@query("prefix_filter", "select p_partkey, p_name from part where (starts_with(p_name, 'small') or starts_with(p_name, 'red')) and not starts_with(p_type, 'PROMO')")
def prefix_filter(spark, d):
    return t(spark, d, "part").where(C.starts_with_any(F.col("p_name"), ["small", "red"]) & ~C.starts_with_any(F.col("p_type"), ["PROMO"])).select("p_partkey", "p_name")


@query("substring_filter", "select p_partkey, p_name from part where contains(p_name, 'r') and contains(p_name, 'ing')")
def substring_filter(spark, d):
    return t(spark, d, "part").where(C.contains_all(F.col("p_name"), ["r", "ing"])).select("p_partkey", "p_name")


@query("literal_replace", "select p_partkey, replace(p_brand, 'Brand#', 'B-') as brand from part")
def literal_replace(spark, d):
    return t(spark, d, "part").select("p_partkey", F.replace("p_brand", F.lit("Brand#"), F.lit("B-")).alias("brand"))


_CONFIG = "('K=' || cast(p_size as varchar) || ' · ' || cast(p_partkey % 7 * 1000 as varchar) || 'feat · ' || lower(p_type))"


@query("parse_config", f"select p_partkey, cast(regexp_extract(c, 'K=(\\d+)', 1) as int) as k, cast(regexp_extract(c, '(\\d+)feat', 1) as int) as n_features, split_part(c, ' · ', 3) as metric from (select p_partkey, {_CONFIG} as c from part)")
def parse_config(spark, d):
    c = F.concat(F.lit("K="), F.col("p_size").cast("string"), F.lit(" · "), (F.col("p_partkey") % 7 * 1000).cast("string"), F.lit("feat · "), F.lower("p_type"))
    own = t(spark, d, "part").select("p_partkey", c.alias("c"))
    return own.select("p_partkey", F.regexp_extract("c", r"K=(\d+)", 1).cast("int").alias("k"), F.regexp_extract("c", r"(\d+)feat", 1).cast("int").alias("n_features"), F.split_part("c", F.lit(" · "), F.lit(3)).alias("metric"))


@query("tolerant_columns", "select p_partkey as id, p_brand as brand, p_size as size from part")
def tolerant_columns(spark, d):
    want = {"p_partkey": "id", "p_brand": "brand", "p_absent": "absent", "p_size": "size"}
    own = t(spark, d, "part")
    return own.select([c for c in want if c in own.columns]).withColumnsRenamed(want)


@query("rename_keys", "select p_partkey, case p_type when 'ECONOMY' then 'Economy line' when 'PROMO' then 'Promotion' else p_type end as kind from part")
def rename_keys(spark, d):
    return t(spark, d, "part").select("p_partkey", F.coalesce(C.recode(F.col("p_type"), {"ECONOMY": "Economy line", "PROMO": "Promotion"}), "p_type").alias("kind"))


@query("lenient_numeric", "select o_orderkey, try_cast(case when o_orderkey % 5 = 0 then '[Not Available]' when o_orderkey % 7 = 0 then '' else cast(o_orderkey as varchar) end as double) as x from orders")
def lenient_numeric(spark, d):
    raw = F.when(F.col("o_orderkey") % 5 == 0, "[Not Available]").when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.col("o_orderkey").cast("string"))
    return t(spark, d, "orders").select("o_orderkey", C.lenient_double(raw).alias("x"))


@query("drop_null_key", "select doc_id, quality from (select d.doc_id, l.quality from documents d left join labels l using (doc_id)) where quality is not null")
def drop_null_key(spark, d):
    return R.left_labels(t(spark, d, "documents").select("doc_id"), t(spark, d, "labels"), "doc_id").dropna(subset=["quality"]).select("doc_id", "quality")


@query("constant_fill", "select d.doc_id, coalesce(l.quality, 2) as quality, coalesce(cast(l.toxic as varchar), 'Unknown') as toxic from documents d left join labels l using (doc_id)")
def constant_fill(spark, d):
    both = R.left_labels(t(spark, d, "documents").select("doc_id"), t(spark, d, "labels"), "doc_id")
    return both.select("doc_id", F.coalesce("quality", F.lit(2)).alias("quality"), F.coalesce(F.col("toxic").cast("string"), F.lit("Unknown")).alias("toxic"))


_SURV = "select o_orderkey, case when o_orderstatus = 'F' then 1 else 0 end as os_event, case when o_orderstatus = 'F' then o_totalprice else cast(o_custkey as double) end as os_time from orders"


@query("survival_endpoint", _SURV)
def survival_endpoint(spark, d):
    dead = F.col("o_orderstatus") == "F"
    return t(spark, d, "orders").select("o_orderkey", dead.cast("int").alias("os_event"), F.when(dead, F.col("o_totalprice")).otherwise(F.col("o_custkey").cast("double")).alias("os_time"))


@query("min_followup", f"select id, time from {SURVIVAL} where time is not null and time >= 30")
def min_followup(spark, d):
    return survival(spark, d).where("time is not null and time >= 30").select("id", "time")


_STAGE = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "4-NOT SPECIFIED": 4}


@query("stage_ordinal", "select o_orderkey, case o_orderpriority when '1-URGENT' then 1 when '2-HIGH' then 2 when '3-MEDIUM' then 3 when '4-NOT SPECIFIED' then 4 end as stage from orders")
def stage_ordinal(spark, d):
    return t(spark, d, "orders").select("o_orderkey", C.recode(F.col("o_orderpriority"), _STAGE).alias("stage"))


@query("composite_flag", "select doc_id, coalesce(quality = 0 and toxic = 0, false) as negative from (select d.doc_id, l.quality, l.toxic from documents d left join labels l using (doc_id))")
def composite_flag(spark, d):
    both = R.left_labels(t(spark, d, "documents").select("doc_id"), t(spark, d, "labels"), "doc_id")
    return both.select("doc_id", F.coalesce((F.col("quality") == 0) & (F.col("toxic") == 0), F.lit(False)).alias("negative"))


@query("days_to_months", f"select id, {r('time / 30.4375')} as months from {SURVIVAL}")
def days_to_months(spark, d):
    return survival(spark, d).select("id", r6(F.col("time") / 30.4375).alias("months"))


@query("guarded_division", f"select l_orderkey, l_linenumber, l_partkey, l_suppkey, {r('case when l_discount = 0 then l_tax else l_tax / l_discount end')} as self, {r('case when l_discount = 0 then 0.0 else l_tax / l_discount end')} as zero from lineitem")
def guarded_division(spark, d):
    a, b = F.col("l_tax"), F.col("l_discount")
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6(C.guarded_ratio(a, b)).alias("self"), r6(C.guarded_ratio(a, b, F.lit(0.0))).alias("zero"))


@query("clip_cosine", f"select vec_id, {r('greatest(least(cast(embedding[1] as double) * 10, 1.0), -1.0)')} as x from embeddings")
def clip_cosine(spark, d):
    return t(spark, d, "embeddings").select("vec_id", r6(C.clip(F.element_at("embedding", 1).cast("double") * 10, -1.0, 1.0)).alias("x"))


@query("round_key", f"select event_id, {r('value / 7', 5)} as key5 from events")
def round_key(spark, d):
    return t(spark, d, "events").select("event_id", r6(F.col("value") / 7, 5).alias("key5"))


_SYM = "case when p_partkey % 4 = 0 then 'ENSG' || cast(p_partkey as varchar) when p_partkey % 4 = 1 then 'LOC' || cast(p_partkey as varchar) when p_partkey % 4 = 2 then p_name end"


@query("symbol_quality", f"select p_partkey, case when s is null or s = '' or starts_with(s, 'ENSG') then 0 when regexp_matches(s, '^(LOC|LINC)') then 1 else 2 end as q, case when s is null or s = '' then cast(p_partkey as varchar) else s end as shown from (select p_partkey, {_SYM} as s from part)")
def symbol_quality(spark, d):
    k = F.col("p_partkey")
    s = F.when(k % 4 == 0, F.concat(F.lit("ENSG"), k.cast("string"))).when(k % 4 == 1, F.concat(F.lit("LOC"), k.cast("string"))).when(k % 4 == 2, F.col("p_name"))
    own = t(spark, d, "part").select("p_partkey", s.alias("s"))
    return own.select("p_partkey", C.symbol_quality(F.col("s")).alias("q"), F.when(F.col("s").isNull() | (F.col("s") == ""), F.col("p_partkey").cast("string")).otherwise(F.col("s")).alias("shown"))


@query("threshold_status", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_tax > 0.05 then 'CORRECTED' when l_tax > 0.02 then 'WARN' else 'OK' end as status from lineitem")
def threshold_status(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", C.threshold_status(F.col("l_tax")).alias("status"))


@query("significance_stars", "select event_id, case when p < 0.001 then '***' when p < 0.01 then '**' when p < 0.05 then '*' else 'ns' end as stars, case when p < 0.001 then 'p<0.001' else 'p=' || format('{:.3f}', p) end as shown from (select event_id, (event_id % 97) / 1021.0::double as p from events)")
def significance_stars(spark, d):
    own = t(spark, d, "events").select("event_id", ((F.col("event_id") % 97) / F.lit(1021.0)).alias("p"))
    return own.select("event_id", C.significance_stars(F.col("p")).alias("stars"), C.p_text(F.col("p")).alias("shown"))


@query("decision_flags", "select id, (low > 0 or high < 0) as ci_excludes_zero, (low > 0 or high < 0) and delta >= 0.03 as meets_delta, delta >= 0.8 as stable from (select event_id as id, value / 100 as delta, value / 100 - 0.05 as low, value / 100 + 0.05 as high from events)")
def decision_flags(spark, d):
    x = F.col("value") / 100
    out = (x - 0.05 > 0) | (x + 0.05 < 0)
    return t(spark, d, "events").select(F.col("event_id").alias("id"), out.alias("ci_excludes_zero"), (out & (x >= 0.03)).alias("meets_delta"), (x >= 0.8).alias("stable"))


@query("direction_labels", "select c_custkey, case when c_acctbal > 0 then 'UP' else 'DOWN' end as direction from customer")
def direction_labels(spark, d):
    return t(spark, d, "customer").select("c_custkey", C.sign_label(F.col("c_acctbal")).alias("direction"))


# joins and sets ----------------------------------------------------------------------------------------------------


@query("hash_lookup", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, s_name from lineitem join (select * from supplier where s_suppkey % 3 <> 0) on l_suppkey = s_suppkey")
def hash_lookup(spark, d):
    names = t(spark, d, "supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return R.lookup(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), names, "l_suppkey")


@query("assemble_outer", "select l_partkey, sum(case when l_returnflag = 'A' then l_quantity end) as a, sum(case when l_returnflag = 'R' then l_quantity end) as r from lineitem where l_returnflag in ('A', 'R') group by 1")
def assemble_outer(spark, d):
    own = t(spark, d, "lineitem")
    a = own.where("l_returnflag = 'A'").select("l_partkey", F.col("l_quantity").alias("a"), F.lit(None).cast("double").alias("r"))
    b = own.where("l_returnflag = 'R'").select("l_partkey", F.lit(None).cast("double").alias("a"), F.col("l_quantity").alias("r"))
    return a.unionByName(b).groupBy("l_partkey").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))


@query("left_join_labels", "select d.doc_id, d.lang, l.quality from documents d left join labels l using (doc_id)")
def left_join_labels(spark, d):
    return R.left_labels(t(spark, d, "documents").select("doc_id", "lang"), t(spark, d, "labels").select("doc_id", "quality"), "doc_id")


@query("semi_join_cohort", "select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def semi_join_cohort(spark, d):
    cohort = t(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return R.restrict(t(spark, d, "orders").select("o_orderkey", "o_custkey"), cohort, "o_custkey")


@query("anti_join_lists", "select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem where not exists (select 1 from part where p_partkey = l_partkey and p_type = 'PROMO') and not exists (select 1 from part where p_partkey = l_partkey and p_size < 10)")
def anti_join_lists(spark, d):
    parts = t(spark, d, "part").withColumnRenamed("p_partkey", "l_partkey")
    return R.exclude(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), parts.where("p_type = 'PROMO'"), parts.where("p_size < 10"), key="l_partkey")


@query("three_way_inner", "select d.doc_id, d.lang, l.quality, length(d.text) as n from documents d join labels l using (doc_id) join (select distinct doc_id from documents where source = 'src1') s using (doc_id)")
def three_way_inner(spark, d):
    docs = t(spark, d, "documents")
    some = docs.where("source = 'src1'").select("doc_id").distinct()
    return docs.select("doc_id", "lang", F.length("text").cast("long").alias("n")).join(t(spark, d, "labels").select("doc_id", "quality"), "doc_id").join(some, "doc_id")


@query("align_ids", "select c_custkey, c_acctbal from customer where c_custkey in (select o_custkey from orders)")
def align_ids(spark, d):
    ids = t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return R.align(t(spark, d, "customer").select("c_custkey", "c_acctbal"), ids, "c_custkey")


@query("outer_metric_tables", f"select coalesce(a.k, b.k) as k, {r('a.m')} as m, b.n from (select l_suppkey % 40 as k, avg(l_tax) as m from lineitem where l_suppkey % 40 < 30 group by 1) a full join (select o_custkey % 40 as k, count(*) as n from orders where o_custkey % 40 >= 10 group by 1) b on a.k = b.k")
def outer_metric_tables(spark, d):
    a = t(spark, d, "lineitem").where("l_suppkey % 40 < 30").groupBy((F.col("l_suppkey") % 40).alias("k")).agg(r6(F.avg("l_tax")).alias("m"))
    b = t(spark, d, "orders").where("o_custkey % 40 >= 10").groupBy((F.col("o_custkey") % 40).alias("k")).agg(F.count("*").alias("n"))
    return R.outer_metrics(a, b, "k")


@query("order_precondition", "select (select count(*) from (select o_custkey from orders except all select o_custkey from orders)) = 0 as same, false as differs")
def order_precondition(spark, d):
    own = t(spark, d, "orders").select("o_custkey")
    return R.same_rows(own, own).crossJoin(R.same_rows(own, own.where("o_custkey > 10")).withColumnRenamed("same", "differs"))


@query("cohort_intersection", "select c_custkey from customer where c_mktsegment = 'BUILDING' intersect select o_custkey from orders intersect select c_custkey from customer where c_nationkey < 15")
def cohort_intersection(spark, d):
    c = t(spark, d, "customer")
    return R.intersect_all([c.where("c_mktsegment = 'BUILDING'").select("c_custkey"), t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), c.where("c_nationkey < 15").select("c_custkey")])


_SETS = {"segment": "select c_custkey as k from customer where c_mktsegment = 'BUILDING'", "orders": "select distinct o_custkey as k from orders", "nation": "select c_custkey as k from customer where c_nationkey < 15"}


@query("overlap_counts", 'select "set", count(*) as n, cast(sum(in_all) as bigint) as n_common, cast(sum(1 - in_all) as bigint) as n_only_some from (select *, case when count(*) over (partition by k) = 3 then 1 else 0 end as in_all from (' + " union all ".join(f"select k, '{n}' as \"set\" from ({q})" for n, q in _SETS.items()) + ")) group by 1")
def overlap_counts(spark, d):
    c = t(spark, d, "customer").withColumnRenamed("c_custkey", "k")
    return R.overlap_counts({"segment": c.where("c_mktsegment = 'BUILDING'"), "orders": t(spark, d, "orders").withColumnRenamed("o_custkey", "k"), "nation": c.where("c_nationkey < 15")}, "k")


@query("set_difference", "select c_custkey from customer except select o_custkey from orders")
def set_difference(spark, d):
    return t(spark, d, "customer").select("c_custkey").subtract(t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")))


@query("row_concat", "select event_id, value from events where event_type = 'error' union all select event_id, value from events where value > 20")
def row_concat(spark, d):
    own = t(spark, d, "events").select("event_id", "value", "event_type")
    return own.where("event_type = 'error'").unionByName(own.where("value > 20")).select("event_id", "value")


# aggregates --------------------------------------------------------------------------------------------------------


@query("value_counts", "select event_type, count(*) as n from events group by 1")
def value_counts(spark, d):
    return R.value_counts(t(spark, d, "events"), "event_type")


@query("numeric_summary", f"select event_type, {r('min(value)')} as low, {r('max(value)')} as high, {r('avg(value)')} as mean, {r('median(value)')} as median, {r('stddev_pop(value)')} as sd from events group by 1")
def numeric_summary(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(r6(F.min("value")).alias("low"), r6(F.max("value")).alias("high"), r6(F.avg("value")).alias("mean"), r6(F.median("value")).alias("median"), r6(F.stddev_pop("value")).alias("sd"))


@query("group_mean_delta", f"select l_partkey, {r('avg(l_extendedprice) filter (l_suppkey % 2 = 1)')} as mean_1, {r('avg(l_extendedprice) filter (l_suppkey % 2 = 0)')} as mean_0, {r('avg(l_extendedprice) filter (l_suppkey % 2 = 1) - avg(l_extendedprice) filter (l_suppkey % 2 = 0)', 5)} as delta from lineitem group by 1")
def group_mean_delta(spark, d):
    own = t(spark, d, "lineitem").select("l_partkey", (F.col("l_suppkey") % 2).alias("label"), "l_extendedprice")
    found = R.group_mean_delta(own, "l_partkey", "label", "l_extendedprice")
    return found.select("l_partkey", r6("mean_1").alias("mean_1"), r6("mean_0").alias("mean_0"), r6(F.col("delta"), 5).alias("delta"))


@query("crosstab", f"select l_returnflag, l_linestatus, n, {r('100.0 * n / sum(n) over (partition by l_returnflag)')} as share from (select l_returnflag, l_linestatus, count(*) as n from lineitem group by 1, 2)")
def crosstab(spark, d):
    return R.crosstab(t(spark, d, "lineitem"), "l_returnflag", "l_linestatus").withColumn("share", r6("share"))


@query("crosstab_wide", "select event_type, count(*) filter (user_id % 4 = 0) as u0, count(*) filter (user_id % 4 = 1) as u1, count(*) filter (user_id % 4 = 2) as u2, count(*) filter (user_id % 4 = 3) as u3 from events group by 1")
def crosstab_wide(spark, d):
    wide = t(spark, d, "events").withColumn("u", F.concat(F.lit("u"), (F.col("user_id") % 4).cast("string"))).groupBy("event_type").pivot("u", ["u0", "u1", "u2", "u3"])
    return wide.agg(F.count(F.lit(1))).na.fill(0)


@query("conditional_percent", f"select lang, count(*) as n, count(*) filter (quality = 1) as n_good, {r('100.0 * count(*) filter (quality = 1) / count(*)')} as pct_good from (select d.lang, l.quality from documents d left join labels l using (doc_id)) group by 1")
def conditional_percent(spark, d):
    both = R.left_labels(t(spark, d, "documents").select("doc_id", "lang"), t(spark, d, "labels"), "doc_id")
    good = F.count_if(F.col("quality") == 1)
    return both.groupBy("lang").agg(F.count("*").alias("n"), good.alias("n_good"), r6(100 * good / F.count("*")).alias("pct_good"))


_ETA = "select 'price' as feature, cast(s_nationkey as int) as g, l_extendedprice as x from lineitem join supplier on l_suppkey = s_suppkey union all select 'tax', cast(s_nationkey as int), l_tax from lineitem join supplier on l_suppkey = s_suppkey"


@query("eta_squared", f"""with x as ({_ETA}), g as (select feature, g, count(x) n, avg(x) m, var_pop(x) * count(x) ss from x group by 1, 2),
 s as (select feature, sum(n) n, count(*) k, sum(ss) w, sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n) b from g group by 1)
 select feature, {r('b / (b + w)')} as eta2, {r('(b - (k - 1) * (w / (n - k))) / (b + w + w / (n - k))')} as omega2 from s""")
def eta_squared(spark, d):
    own = t(spark, d, "lineitem").join(t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("s_nationkey", F.col("l_extendedprice").alias("price"), F.col("l_tax").alias("tax"))
    found = R.eta_squared(own, "s_nationkey", ["price", "tax"])
    return found.select("feature", r6("eta2").alias("eta2"), r6("omega2").alias("omega2"))


@query("distinct_and_singletons", "select count(*) as n_groups, count(*) filter (n = 1) as n_single, cast(sum(n) as bigint) as n_rows from (select l_partkey, l_suppkey, count(*) as n from lineitem group by 1, 2)")
def distinct_and_singletons(spark, d):
    own = t(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    return own.agg(F.count("*").alias("n_groups"), F.count_if(F.col("n") == 1).alias("n_single"), F.sum("n").alias("n_rows"))


@query("percentiles", f"select event_type, {r('quantile_cont(value, 0.025)')} as p025, {r('quantile_cont(value, 0.975)')} as p975, {r('quantile_cont(value, 0.99)')} as p99 from events group by 1")
def percentiles(spark, d):
    names = {"p025": 0.025, "p975": 0.975, "p99": 0.99}
    return quantiles(t(spark, d, "events"), "value", names, ["event_type"]).withColumns({n: r6(n) for n in names})


@query("argmax_first", "select event_type, event_id, value from (select *, row_number() over (partition by event_type order by value desc, event_id) as rn from events) where rn = 1")
def argmax_first(spark, d):
    own = t(spark, d, "events").select("event_type", "event_id", "value")
    return R.best_first(own, F.col("value"), "event_id", ["event_type"])


@query("majority_vote", "select user_id, event_type from (select user_id, event_type, row_number() over (partition by user_id order by count(*) desc, event_type) as rn from events group by 1, 2) where rn = 1")
def majority_vote(spark, d):
    return R.majority(t(spark, d, "events"), "user_id", "event_type")


@query("cluster_sizes", "select l, cast(list(n order by k) as varchar) as sizes from (select vec_id % 3 as l, label as k, count(*) as n from embeddings group by 1, 2) group by 1")
def cluster_sizes(spark, d):
    n = t(spark, d, "embeddings").groupBy((F.col("vec_id") % 3).alias("l"), F.col("label").alias("k")).agg(F.count("*").alias("n"))
    sizes = F.transform(F.array_sort(F.collect_list(F.struct("k", "n"))), lambda s: s["n"].cast("string"))
    return n.groupBy("l").agg(F.concat(F.lit("["), F.array_join(sizes, ", "), F.lit("]")).alias("sizes"))


@query("range_check", f"select {r('max(m) - min(m)')} as spread, max(m) - min(m) < 0.10 as stable from (select l_suppkey % 6 as k, avg(l_discount) as m from lineitem group by 1)")
def range_check(spark, d):
    own = t(spark, d, "lineitem").groupBy(F.col("l_suppkey") % 6).agg(F.avg("l_discount").alias("m"))
    return own.agg(r6(F.max("m") - F.min("m")).alias("spread"), (F.max("m") - F.min("m") < 0.10).alias("stable"))


@query("event_rate", f"select grp, {r('100 * avg(case when event then 1.0::double else 0.0::double end)')} as rate from {SURVIVAL} group by 1")
def event_rate(spark, d):
    return survival(spark, d).groupBy("grp").agg(r6(100 * F.avg(F.col("event").cast("double"))).alias("rate"))


# windows and top-k -------------------------------------------------------------------------------------------------


@query("dedup_keep_first", "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderkey) as rn from orders) where rn = 1")
def dedup_keep_first(spark, d):
    return R.keep_first(t(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], [F.col("o_orderkey")])


@query("dedup_by_delta", f"select p_partkey, key5 from (select *, row_number() over (partition by key5 order by p_size desc, p_partkey) as rn from (select p_partkey, p_size, {r('(p_retailprice % 97) / 7', 5)} as key5 from part)) where rn = 1")
def dedup_by_delta(spark, d):
    own = t(spark, d, "part").select("p_partkey", "p_size", r6((F.col("p_retailprice") % 97) / 7, 5).alias("key5"))
    return R.keep_first(own, ["key5"], [F.col("p_size").desc(), F.col("p_partkey")]).select("p_partkey", "key5")


@query("consecutive_gap", f"select user_id, event_id, {r('lead(value) over (partition by user_id order by event_id) - value')} as gap from events")
def consecutive_gap(spark, d):
    return t(spark, d, "events").select("user_id", "event_id", r6(F.lead("value").over(Window.partitionBy("user_id").orderBy("event_id")) - F.col("value")).alias("gap"))


@query("average_ranks", "select event_id, cast(rank() over (partition by user_id order by value) as double) + (count(*) over (partition by user_id, value) - 1) / 2.0::double as rnk from events")
def average_ranks(spark, d):
    order, ties = Window.partitionBy("user_id").orderBy("value"), Window.partitionBy("user_id", "value")
    return t(spark, d, "events").select("event_id", (F.rank().over(order).cast("double") + (F.count("*").over(ties) - 1) / F.lit(2.0)).alias("rnk"))


@query("row_share", f"select user_id, event_type, {r('n / sum(n) over (partition by user_id)')} as share from (select user_id, event_type, count(*) as n from events group by 1, 2)")
def row_share(spark, d):
    n = t(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return n.select("user_id", "event_type", r6(F.col("n") / F.sum("n").over(Window.partitionBy("user_id"))).alias("share"))


@query("top_and_bottom", "select * from (select c_custkey, c_acctbal from customer order by c_acctbal desc, c_custkey limit 20) union select * from (select c_custkey, c_acctbal from customer order by c_acctbal, c_custkey limit 20)")
def top_and_bottom(spark, d):
    return R.extremes(t(spark, d, "customer").select("c_custkey", "c_acctbal"), F.col("c_acctbal"), 20, "c_custkey")


@query("top_categories", "select case when p_brand in (select p_brand from (select p_brand, count(*) as n from part group by 1 order by n desc, p_brand limit 12)) then p_brand else 'Other' end as p_brand, count(*) as n from part group by 1")
def top_categories(spark, d):
    return R.value_counts(R.top_categories(t(spark, d, "part").select("p_brand"), "p_brand", 12), "p_brand")


QUERIES, ORACLES = query.QUERIES, query.ORACLES
