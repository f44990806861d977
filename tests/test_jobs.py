"""The jobs: matching SQL, reruns, growing input, failures between a batch's writes, odd rows, the command line."""

import datetime
import json
import logging
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F
from test_oracles import duck, rows_of  # noqa: F401

from jobs import common, follow_up, registry, term_matrix

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_job_equals_sql(spark, sf, duck, name):  # noqa: F811
    kept = lambda: sorted(tuple(r) for r in spark.sql("set").collect() if r[0].startswith("spark.sql."))
    before = kept()
    got, want = registry.QUERIES[name](spark, sf), duck.sql(registry.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(want.columns, want.fetchall())
    assert kept() == before


def test_term_matrix(spark, tmp_path, caplog):
    texts = [(1, "The cat, the CAT and a dog.", "a"), (2, None, "a"), (3, "", "b"), (4, "cat " * 30_000, "b"), (4, "cat " * 30_000, "b"), (5, "dog dog bird", None), (6, "the bird", "c"), (7, "12 !!", "d")]
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.createDataFrame(texts, "doc_id long, text string, source string").withColumn("value", F.lit("clash")).write.parquet(source)
    with caplog.at_level(logging.INFO, "lathework.jobs"):
        first = sorted(map(tuple, term_matrix.run(spark, source, out, {"n_top": 3}).collect()))
    assert "8 rows" in caplog.text and "cells in blocks" in caplog.text
    again = sorted(map(tuple, term_matrix.run(spark, source, out, {"n_top": 3}).collect()))
    assert again == first and len(first) == 3 * 4 and {r[0] for r in first} == {"a", "b", "c", "(none)"}
    sizes = {tuple(r) for r in spark.read.parquet(f"{out}/samples").collect()}
    assert sizes == {("a", 2, 6), ("b", 3, 60_000), ("(none)", 1, 3), ("c", 1, 2), ("d", 1, 0)}
    for term in {r[1] for r in first}:
        values = [r[2] for r in first if r[1] == term]
        assert abs(sum(values)) < 1e-5 and abs(sum(v * v for v in values) / 4 - 1) < 1e-5
    assert all(name.startswith(("block=", "_", ".")) for name in os.listdir(f"{out}/matrix"))
    with pytest.raises(ValueError, match="unknown settings"):
        term_matrix.run(spark, source, out, {"top": 3})


def test_term_matrix_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "text string, source string").write.parquet(f"{tmp_path}/in")
    assert term_matrix.run(spark, f"{tmp_path}/in", f"{tmp_path}/out").count() == 0


def landed(spark, rows, path):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(path)


def wanted(rows):
    out = {}
    for _, ts, user, kind, value in rows:
        key = (ts.date() if ts else None, user, kind)
        n, total = out.get(key, (0, None))
        out[key] = (n + 1, total if value is None else value + (total or 0.0))
    return {(*k, n, None if t is None else round(t, 6)) for k, (n, t) in out.items()}


def standing(frame):
    return {(r["day"], r["sample_id"], r["feature_id"], r["n"], None if r["total"] is None else round(r["total"], 6)) for r in frame.collect()}


def day(k, hour=1):
    return datetime.datetime(2024, 1, k, hour)


def test_follow_up_takes_only_what_is_new(spark, tmp_path, caplog):
    """Input that grows between runs: new days, late rows of old days, nulls, repeated rows; days that nothing landed for are not rewritten."""
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    first = [(1, day(1), 1, "a", 1.5), (2, day(1), 1, "a", 2.5), (2, day(1), 1, "a", 2.5), (3, day(2), None, "b", None), (4, None, 1, None, 3.0), (5, day(3), 2, "a", 0.25)]
    landed(spark, first, source)
    assert standing(follow_up.run(spark, source, out)) == wanted(first)
    files = {f for f in os.listdir(f"{out}/counts/day=2024-01-03") if f.endswith("parquet")}
    with caplog.at_level(logging.INFO, "lathework.jobs"):
        assert standing(follow_up.run(spark, source, out)) == wanted(first)
        assert "0 new rows in 0 batches" in caplog.text
        more = [(6, day(1, 23), 1, "a", 1.0), (7, day(4), 9, "c", 4.0), (8, None, 1, None, 1.0)]
        landed(spark, more, source)
        assert standing(follow_up.run(spark, source, out)) == wanted(first + more)
        assert "3 new rows in 1 batches" in caplog.text
    assert {f for f in os.listdir(f"{out}/counts/day=2024-01-03") if f.endswith("parquet")} == files
    # many files at once, taken in several batches
    rest = [(10 + k, day(1 + k % 5), k % 3, "ab"[k % 2], k / 4) for k in range(40)]
    for k in range(5):
        landed(spark, rest[k::5], source)
    assert standing(follow_up.run(spark, source, out, {"files_per_batch": 2})) == wanted(first + more + rest)
    assert standing(follow_up.run(spark, source, out)) == wanted(first + more + rest)


def test_follow_up_goes_on_after_a_failure(spark, tmp_path, monkeypatch):
    """A batch that fails after its parts are written is run again; nothing counts twice."""
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    rows = [(1, day(1), 1, "a", 1.5), (2, day(2), 1, "a", 2.5)]
    landed(spark, rows, source)
    merge = follow_up.merged_counts

    def broken(parts):
        raise RuntimeError("lost")

    monkeypatch.setattr(follow_up, "merged_counts", broken)
    with pytest.raises(Exception, match="lost"):
        follow_up.run(spark, source, out)
    monkeypatch.setattr(follow_up, "merged_counts", merge)
    more = [(3, day(2), 1, "a", 1.0)]
    landed(spark, more, source)
    assert standing(follow_up.run(spark, source, out)) == wanted(rows + more)


def test_command_line(tmp_path, sf):
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"files_per_batch": 1}))
    done = subprocess.run(
        [sys.executable, "jobs/follow_up.py", "--input", f"{sf}/events.parquet", "--output", f"{tmp_path}/out", "--config", str(config), "--master", "local[2]"], cwd=ROOT, capture_output=True, text=True, timeout=300
    )
    assert done.returncode == 0, done.stderr[-2_000:]
    assert "new rows in 1 batches" in done.stderr and os.path.isdir(tmp_path / "out" / "counts")
    assert common.defaults(follow_up.__file__)["files_per_batch"] == 64
