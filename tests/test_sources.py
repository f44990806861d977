"""Readers of landed files, sinks, the stage store, the paged source and the stream."""

import gzip
import json
import pathlib

from pyspark.sql import functions as F

from lathework.plans import catalog, source_queries
from lathework.sources import files, predicates, rest
from lathework.sources.store import Store
from lathework.streaming.incremental import run_available, windowed_counts


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return path


def test_measurement_files(spark, tmp_path):
    write(tmp_path / "c/u1/x.tsv", "# comment\ngene_id\tunstranded\tother\nN_unmapped\t9\t1\ng1\t5\t1\ng2\t0\t1\n")
    write(tmp_path / "c/u2/x.tsv", "# comment\ngene_id\tunstranded\tother\ng1\t7\t1\n")
    write(tmp_path / "m.tsv", "file_id\tfile_name\tcase_id\tsubmitter_id\tsample_type\tsample_id\nu1\tx\tc\tA-B-C-D\tT\ts1\nu2\tx\tc\tA-B-E-D\tT\ts2\nu3\tx\tc\tA-B-C-F\tT\ts0\nu4\tx\tc\t\tT\ts9\n")
    chosen = files.one_file_per_patient(files.manifest(spark, str(tmp_path / "m.tsv")))
    assert {tuple(r) for r in chosen.collect()} == {("u3", "A-B-C"), ("u2", "A-B-E")}
    long = files.counts(spark, str(tmp_path / "c/*/*.tsv"))
    assert {tuple(r) for r in long.collect()} == {("u1", "g1", 5.0), ("u1", "g2", 0.0), ("u2", "g1", 7.0)}
    assert [tuple(r) for r in files.assemble(long, chosen).collect()] == [("A-B-E", "g1", 7.0)]
    write(tmp_path / "b/u1/x.txt", "p1\t0.5\np2\tNA\n")
    assert {tuple(r) for r in files.two_columns(spark, str(tmp_path / "b/*/*.txt")).collect()} == {("u1", "p1", 0.5), ("u1", "p2", None)}
    write(tmp_path / "n/u1/x.tsv", "gene_id\tcopy_number\ng1\t3\ng2\t\n")
    assert {tuple(r) for r in files.copy_number(spark, str(tmp_path / "n/*/*.tsv")).collect()} == {("u1", "g1", 3.0), ("u1", "g2", 2.0)}
    assert files.first_glob(spark, str(tmp_path / "none/*"), str(tmp_path / "n/*")).endswith("n/*")


def test_records_and_annotation(spark, tmp_path):
    write(tmp_path / "r.tsv", "barcode\tage\tstatus\nbarcode\tage\tstatus\nCDE:1\tCDE:2\tCDE:3\nCASE-1\t61\tDead\nCASE-2\t[Not Available]\t[Not Evaluated]\n")
    own = files.records(spark, str(tmp_path / "r.tsv"), {"barcode": "id", "age": "age", "absent": "x", "status": "status"}, "id", "CASE", ("age",))
    assert {tuple(r) for r in own.collect()} == {("CASE-1", 61.0, "Dead"), ("CASE-2", None, "[Not Evaluated]")}
    with gzip.open(tmp_path / "a.tsv.gz", "wt") as f:
        f.write("Probe_ID\tchrm\tmask\np1\tchrX\t1\n")
    assert [tuple(r) for r in files.annotation(spark, str(tmp_path / "a.tsv.gz"), ["Probe_ID", "chrm", "gone"]).collect()] == [("p1", "chrX")]


def test_lists_and_tables(spark, tmp_path):
    files.write_id_list(spark.createDataFrame([("b",), ("a",)], "id string"), str(tmp_path / "ids"))
    assert {r["id"] for r in files.id_list(spark, str(tmp_path / "ids")).collect()} == {"a", "b"}
    files.write_table(spark.createDataFrame([("x", 1e-9, [1, 2])], "k string, p double, sizes array<int>"), str(tmp_path / "t"), {"p": 4})
    row = spark.read.option("header", True).csv(str(tmp_path / "t"), sep="\t").first()
    assert (row["p"], row["p_text"], row["sizes"]) == ("1.0E-9", "0.0000", "[1, 2]")


def test_response(spark, tmp_path):
    body = {"data": {"hits": [{"file_id": "f1", "file_name": "n", "cases": [{"case_id": "c", "submitter_id": "s", "samples": [{"sample_id": "q", "sample_type": "T"}]}]}, {"file_id": "f2", "file_name": "m", "cases": []}]}}
    p = write(tmp_path / "r.json", json.dumps(body))
    assert {tuple(r) for r in files.flatten_response(spark, str(p)).collect()} == {("f1", "n", "c", "s", "T", "q"), ("f2", "m", "", "", "", "")}


def test_cases(spark, tmp_path):
    full = {"case_id": "c", "submitter_id": "s", "diagnoses": [{"vital_status": "Dead", "days_to_death": 12, "ajcc_pathologic_stage": "Stage I"}, {"vital_status": "Alive"}], "demographic": {"age_at_index": 50}}
    p = write(tmp_path / "r.json", json.dumps({"data": {"hits": [full, {"case_id": "d", "diagnoses": [], "demographic": None}]}}))
    assert {tuple(r) for r in files.flatten_cases(spark, str(p)).collect()} == {("c", "s", "Dead", "12", "", "Stage I", "50"), ("d", "", "", "", "", "", "")}


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    make = lambda n: spark.range(n)
    a = store.stage("a", {"n": 3}, make)
    assert not a.reused and store.stage("a", {"n": 3}, make).reused and store.stage("a", {"n": 4}, make).key != a.key
    b = store.stage("b", {}, lambda x: x.withColumn("v", F.col("id").cast("double")), [a])
    c = store.patch("c", b, spark.createDataFrame([(1, 9.0)], "id long, v double"), ["id"], "v")
    assert {tuple(r) for r in c.read(spark).collect()} == {(0, 0.0), (1, 9.0), (2, 2.0)}
    other = store.stage("b", {}, lambda x: x.withColumn("v", F.col("id").cast("double")), [store.stage("a", {"n": 4}, make)])
    assert not other.reused and other.key != b.key


def test_filter_tree(spark):
    tree = {"op": "and", "content": [{"op": "in", "content": {"field": "id", "value": [1, 2, 3]}}, {"op": "not", "content": [{"op": "=", "content": {"field": "id", "value": 2}}]}]}
    assert {r["id"] for r in spark.range(9).where(predicates.from_tree(tree)).collect()} == {1, 3}
    assert {r["id"] for r in spark.range(9).where(predicates.all_of({"id": [1, 5]}, {"id": 5})).collect()} == {5}


def test_paged_source(spark, tmp_path):
    for at in (0, 2):
        write(tmp_path / f"p{at}.json", json.dumps({"data": {"hits": [{"id": at + k, "name": f"n{at + k}"} for k in range(2)]}}))
    rest.register(spark)
    own = spark.read.format("paged_json").schema("id long, name string").options(url=f"file://{tmp_path}/p{{offset}}.json", page_size="2", total="4").load()
    assert {tuple(r) for r in own.where("id > 0").collect()} == {(1, "n1"), (2, "n2"), (3, "n3")}


def test_stream_equals_batch(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    batch.write.parquet(str(tmp_path / "in"))
    run_available(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"), window="1 day", late="0 seconds")
    done = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("start", "sample_id", "feature_id", "n").collect()}
    whole = {tuple(r) for r in windowed_counts(batch, window="1 day").select("start", "sample_id", "feature_id", "n").collect()}
    assert done and done <= whole


def test_scans_write_and_list_in_parallel(spark, sf, tmp_path, monkeypatch):
    """Many small files: several tasks write them, and folders below a root are listed by few tasks, not one each."""
    places = []
    place = source_queries._place
    monkeypatch.setattr(source_queries, "_place", lambda s, name: places.append(place(s, name)) or places[-1])
    for name in ("scan_counts", "scan_two_columns", "scan_copy_number"):
        catalog.QUERIES[name](spark, sf)
    for p in places:
        assert len({f.name.split("-")[1] for f in pathlib.Path(p.removeprefix("file:")).glob("*/part-*.csv")}) > 1, p
    rows = [(k, f"g{q}", k + q) for k in range(100) for q in range(3)]
    root = str(tmp_path / "counts")
    spark.createDataFrame(rows, "file_id int, gene_id string, unstranded int").repartition(1).write.partitionBy("file_id").csv(root, sep="\t", header=True)
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.sparkContext.setJobGroup("listing", "listing")
    got = files.counts(spark, root)
    tracker = spark.sparkContext.statusTracker()
    sizes = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sizes and max(sizes) <= files.LISTERS and spark.conf.get(name) == before
    assert {tuple(r) for r in got.collect()} == {(f"file_id={k}", g, float(v)) for k, g, v in rows} == {tuple(r) for r in files.counts(spark, f"{root}/*/*.csv").collect()}
