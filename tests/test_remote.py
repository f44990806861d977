"""The paged source and the fetcher against a service on this machine that fails, cuts off and refuses."""

import hashlib
import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark.sql import functions as F

from lathework.sources import rest
from lathework.sources.fetch import fetch
from lathework.sources.remote import Refused, retried

ROWS = [{"id": k, "name": f"n{k}", "tags": [{"t": k}] if k % 2 else None} for k in range(23)]
FILES = {"a": b"gene\t1\n", "b": b"", "c": b"x" * 70_000}


class Service(BaseHTTPRequestHandler):
    asked: Counter = Counter()

    def log_message(self, *_):
        pass

    def do_GET(self):
        at = urlsplit(self.path)
        own = Service.asked
        own[self.path] += 1
        first = own[self.path] == 1
        body, code = b"", 200
        if at.path == "/pages":
            q = parse_qs(at.query)
            start, size = int(q["from"][0]), int(q["size"][0])
            body = json.dumps({"data": {"hits": ROWS[start : start + size], "pagination": {"total": len(ROWS)}}}).encode()
            if start == 5 and first:
                code = 503
            if start == 10 and first:
                body = body[:20]
        elif at.path == "/no":
            code = 403
        elif at.path.startswith("/file/"):
            body = FILES.get(at.path[6:], b"")
            code = 200 if at.path[6:] in FILES else 404
            if at.path == "/file/c" and first:
                body = body[:100]
        self.send_response(code)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)


@pytest.fixture()
def service():
    Service.asked.clear()
    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def pages(spark, service, **options):
    rest.register(spark)
    how = {"url": f"{service}/pages?from={{offset}}&size={{size}}", "page_size": "5", "backoff": "0.01"} | options
    return spark.read.format("paged_json").schema("id long, name string, tags string").options(**how).load()


def test_total_from_the_service_and_pages_that_fail_once(spark, service):
    own = pages(spark, service, pages_per_task="2")
    got = [tuple(r) for r in own.orderBy("id").collect()]
    assert got == [(r["id"], r["name"], json.dumps(r["tags"]) if r["tags"] else None) for r in ROWS]
    assert own.rdd.getNumPartitions() == 3
    # pages can be read again
    assert own.count() == 23
    assert Service.asked["/pages?from=5&size=5"] >= 2


def test_total_too_large_fails_or_is_reported(spark, service):
    with pytest.raises(Exception, match="3 rows at 20, 5 by the total of 25"):
        pages(spark, service, total="25").collect()
    kept = pages(spark, service, total="40", short="keep")
    assert [tuple(r) for r in rest.truncation(kept, 40).collect()] == [(23, 40, True)]
    assert [tuple(r) for r in rest.truncation(kept, 23).collect()] == [(23, 23, False)]


def test_errors_that_stay(spark, service):
    with pytest.raises(Exception, match="403"):
        pages(spark, service, url=f"{service}/no?{{offset}}", total="5", short="keep").collect()
    assert Service.asked["/no?0"] <= 4 and Service.asked["/no?5"] == 0
    with pytest.raises(Exception, match="no total"):
        pages(spark, service, total_path="data.count").collect()
    calls = []

    def never():
        calls.append(1)
        raise OSError("down")

    with pytest.raises(OSError):
        retried(never, 2, 0.001)
    assert len(calls) == 3

    def refused():
        calls.append(1)
        raise Refused("no")

    with pytest.raises(Refused):
        retried(refused, 2, 0.001)
    assert len(calls) == 4


@pytest.mark.parametrize("n", [0, 1, 10, 11])
def test_landed_pages_come_back(spark, tmp_path, n):
    rows = spark.range(n).select((F.col("id") * 3).alias("k"), F.when(F.col("id") % 2 == 0, F.lit('q"\n')).alias("t"))
    path = f"file://{tmp_path}/pages"
    assert rest.land(rows, "k", path, 5) == n
    rest.register(spark)
    back = spark.read.format("paged_json").schema(rows.schema).options(url=f"{path}/offset={{offset}}", page_size="5").load()
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def test_fetch_continues_and_checks(spark, service, tmp_path):
    md5 = {k: hashlib.md5(v).hexdigest() for k, v in FILES.items()}
    rows = [("u1", "a.tsv", f"{service}/file/a", 7, md5["a"]), ("u2", "b.tsv", f"{service}/file/b", 0, None), ("u3", "c.tsv", f"{service}/file/c", 70_000, md5["c"]), ("u4", "d.tsv", f"{service}/file/d", None, None), ("u1", "a.tsv", f"{service}/file/a", 7, md5["a"]), ("u5", "e.tsv", f"{service}/file/a", 7, md5["c"])]
    manifest = spark.createDataFrame(rows, "file_id string, file_name string, url string, size long, md5 string")
    root = f"file://{tmp_path}/raw"
    first = {r["file_id"]: r for r in fetch(manifest, root, retries=2, backoff=0.01).collect()}
    assert {k: r["status"] for k, r in first.items()} == {"u1": "fetched", "u2": "fetched", "u3": "fetched", "u4": "failed", "u5": "failed"}
    assert (tmp_path / "raw/u3/c.tsv").read_bytes() == FILES["c"] and first["u3"]["md5"] == md5["c"]
    assert Service.asked["/file/c"] == 2 and Service.asked["/file/d"] == 1 and "404" in first["u4"]["error"]
    assert not list((tmp_path / "raw").glob("u5/*"))
    (tmp_path / "raw/u1/a.tsv").write_bytes(b"changed")
    again = {r["file_id"]: r["status"] for r in fetch(manifest, root, retries=0, backoff=0.01).collect()}
    assert again == {"u1": "fetched", "u2": "present", "u3": "present", "u4": "failed", "u5": "failed"}
    assert (tmp_path / "raw/u1/a.tsv").read_bytes() == FILES["a"]
    # what is fetched is read by glob
    assert spark.read.text(f"{root}/*/a.tsv").count() == 1
    # a manifest without sizes, and an empty one
    assert fetch(manifest.drop("size", "md5"), root, retries=0).where("status = 'present'").count() == 3
    assert fetch(manifest.limit(0), root).count() == 0
