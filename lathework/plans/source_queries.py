"""Queries that land driver tables as files in the shared folder and scan them back through the sources."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lathework.functions.columns import r6
from lathework.operators import spectral as L
from lathework.plans.base import COUNTS, Registry, counts, r
from lathework.session import shared_dir, table
from lathework.sources import files, rest
from lathework.sources.store import Store

query = Registry()


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _per_sample(df: DataFrame, path: str, header: bool) -> None:
    """A folder of TSV files per sample, written by as many tasks as a shuffle has: small tables would be put together into one task, and their time is in the files."""
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    df.repartition(tasks, "file_id").write.partitionBy("file_id").csv(path, sep="\t", header=header, nullValue="", emptyValue="")


@query("scan_counts", "select 'file_id=' || l_suppkey as file_id, 'g' || (l_partkey % 50) as feature_id, count(*)::double as value from lineitem where l_partkey % 50 > 3 group by 1, 2")
def scan_counts(spark, d):
    """Per-sample count files: key from the folder, summary rows dropped by their prefix."""
    own = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("file_id"), F.when(F.col("l_partkey") % 50 > 3, F.concat(F.lit("g"), (F.col("l_partkey") % 50).cast("string"))).otherwise(F.concat(F.lit("N_"), (F.col("l_partkey") % 50).cast("string"))).alias("gene_id")).agg(F.count("*").alias("unstranded"))
    path = _place(spark, "counts")
    _per_sample(own, path, True)
    return files.counts(spark, path)


@query("scan_two_columns", f"select 'file_id=' || sample_id as file_id, 'p' || feature_id as feature_id, {r('case when value > 100 then null else value end')} as value from {COUNTS}")
def scan_two_columns(spark, d):
    """Headerless key and number files, aligned by key; NA is null."""
    own = counts(spark, d).select(F.col("sample_id").alias("file_id"), F.concat(F.lit("p"), F.col("feature_id").cast("string")).alias("k"), F.when(F.col("value") > 100, F.lit("NA")).otherwise(F.col("value").cast("string")).alias("v"))
    path = _place(spark, "two")
    _per_sample(own, path, False)
    return files.two_columns(spark, path).withColumn("value", r6("value"))


@query("scan_copy_number", f"select 'file_id=' || sample_id as file_id, 'g' || feature_id as feature_id, {r('case when value > 100 then 2.0 else value end')} as value from {COUNTS}")
def scan_copy_number(spark, d):
    """Copy numbers with gaps, which become neutral."""
    own = counts(spark, d).select(F.col("sample_id").alias("file_id"), F.concat(F.lit("g"), F.col("feature_id").cast("string")).alias("gene_id"), F.when(F.col("value") <= 100, F.col("value").cast("string")).alias("copy_number"))
    path = _place(spark, "copy")
    _per_sample(own, path, True)
    return files.copy_number(spark, path).withColumn("value", r6("value"))


@query("scan_records", "select c_name as id, case when c_custkey % 6 > 0 then c_acctbal end as balance, c_mktsegment as segment from customer")
def scan_records(spark, d):
    """A record table with further header lines and sentinels, read as text."""
    own = table(spark, d, "customer").select(F.col("c_name").alias("barcode"), F.when(F.col("c_custkey") % 6 > 0, F.col("c_acctbal").cast("string")).otherwise(F.lit("[Not Available]")).alias("acct"), F.col("c_mktsegment").alias("seg"))
    more = spark.createDataFrame([("barcode", "acct", "seg"), ("CDE_ID:1", "CDE_ID:2", "CDE_ID:3")], own.schema)
    path = _place(spark, "records")
    own.unionByName(more).write.csv(path, sep="\t", header=True)
    return files.records(spark, path, {"barcode": "id", "acct": "balance", "gone": "gone", "seg": "segment"}, "id", "Customer", ("balance",))


@query("scan_annotation", "select p_partkey::varchar as probe, p_type as chrm from part")
def scan_annotation(spark, d):
    """A gzip table of which some columns are wanted, one of them absent; the first glob has no match."""
    path = _place(spark, "annotation")
    table(spark, d, "part").select(F.col("p_partkey").alias("probe"), F.col("p_type").alias("chrm"), F.col("p_size").alias("other")).write.csv(path, sep="\t", header=True, compression="gzip")
    return files.annotation(spark, files.first_glob(spark, f"{path}/*.bz2", f"{path}/*.gz"), ["probe", "chrm", "gone"])


@query("scan_cases", "select c_name as case_id, cast(c_custkey as varchar) as submitter_id, case when c_custkey % 3 = 0 then '' when c_acctbal > 0 then 'Alive' else 'Dead' end as vital_status, case when c_custkey % 3 > 0 and c_acctbal <= 0 then cast(c_nationkey * 10 as varchar) else '' end as days_to_death, case when c_custkey % 3 > 0 and c_acctbal > 0 then cast(c_nationkey * 20 as varchar) else '' end as days_to_last_follow_up, case when c_custkey % 3 > 0 then c_mktsegment else '' end as ajcc_pathologic_stage, case when c_custkey % 4 > 0 then cast(c_nationkey as varchar) else '' end as age_at_index from customer")
def scan_cases(spark, d):
    """Responses of a case service: customers as cases, a response per nation, some without a diagnosis or age."""
    own, k, n = table(spark, d, "customer"), F.col("c_custkey"), F.col("c_nationkey")
    alive = F.col("c_acctbal") > 0
    diagnosis = F.struct(F.when(alive, "Alive").otherwise("Dead").alias("vital_status"), F.when(~alive, n * 10).alias("days_to_death"), F.when(alive, n * 20).alias("days_to_last_follow_up"), F.col("c_mktsegment").alias("ajcc_pathologic_stage"))
    hit = F.struct(F.col("c_name").alias("case_id"), k.cast("string").alias("submitter_id"), F.when(k % 3 > 0, F.array(diagnosis)).alias("diagnoses"), F.when(k % 4 > 0, F.struct(n.alias("age_at_index"))).alias("demographic"))
    path = _place(spark, "cases")
    own.groupBy("c_nationkey").agg(F.struct(F.collect_list(hit).alias("hits")).alias("data")).select("data").write.json(path)
    return files.flatten_cases(spark, path, whole_file=False)


@query("id_list_round_trip", "select c_custkey::varchar as id from customer where c_mktsegment = 'BUILDING'")
def id_list_round_trip(spark, d):
    path = _place(spark, "ids")
    files.write_id_list(table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey"), path)
    return files.id_list(spark, path)


@query("result_table_round_trip", f"select event_type, {r('avg(value)')} as mean, {r('floor(avg(value) * 1e6 + 0.5) / 1e6', 3)} as mean_text from events group by 1")
def result_table_round_trip(spark, d):
    """A TSV in full precision with a formatted column beside it."""
    own = table(spark, d, "events").groupBy("event_type").agg(r6(F.avg("value")).alias("mean"))
    path = _place(spark, "table")
    files.write_table(own, path, {"mean": 3})
    back = spark.read.option("header", True).csv(path, sep="\t")
    return back.select("event_type", F.col("mean").cast("double").alias("mean"), F.col("mean_text").cast("double").alias("mean_text"))


@query("versioned_patch", f"select sample_id, feature_id, {r('case when feature_id % 10 = 0 then value + 1 else value end')} as value from {COUNTS}")
def versioned_patch(spark, d):
    """A stored stage, and a new version of it with some features corrected."""
    store = Store(spark, _place(spark, "store"))
    base = store.stage("matrix", {"of": d}, lambda of: counts(spark, of))
    fix = base.read(spark).where("feature_id % 10 = 0").withColumn("value", F.col("value") + 1)
    done = store.patch("corrected", base, fix, ["sample_id", "feature_id"], "value", {"rule": "plus one"})
    return done.read(spark).select("sample_id", "feature_id", r6("value").alias("value"))


@query("paged_scan", "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, cast(o_orderdate as varchar)[1:10] as o_orderdate from orders")
def paged_scan(spark, d):
    """Orders as the pages of a service, landed, and scanned by the total that the service reports; a page of other length than promised fails."""
    own = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").cast("date").cast("string").alias("o_orderdate"))
    path = _place(spark, "pages")
    rest.land(own, "o_orderkey", path, 2_000)
    rest.register(spark)
    return spark.read.format("paged_json").schema(own.schema).options(url=f"{path}/offset={{offset}}", page_size="2000", pages_per_task="4").load()


@query("paged_truncation", "select least(count(*), 5000)::bigint as retrieved, count(*) as reported, count(*) > 5000 as truncated from orders")
def paged_truncation(spark, d):
    """A scan of the first five pages of 1,000 against the reported total."""
    own = table(spark, d, "orders").select("o_orderkey")
    path = _place(spark, "pages")
    total = rest.land(own, "o_orderkey", path, 1_000)
    rest.register(spark)
    some = spark.read.format("paged_json").schema(own.schema).options(url=f"{path}/offset={{offset}}", page_size="1000", total="5000", short="keep", retries="0").load()
    return rest.truncation(some, total)


@query("pca_scatter")
def pca_scatter(spark, d):
    """First two components with the most frequent groups named and the others together."""
    from lathework.operators.relate import top_categories
    from lathework.plans.base import vectors

    own = vectors(spark, d)
    scores, _ = L.principal_components(own, 64, 2)
    named = top_categories(own.select("id", F.col("label").cast("string").alias("site")), "site", 4)
    return scores.select("id", F.element_at("pc", 1).alias("pc1"), F.element_at("pc", 2).alias("pc2")).join(named, "id")


QUERIES, ORACLES = query.QUERIES, query.ORACLES
