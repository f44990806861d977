"""A paged JSON service as a Spark data source.

``spark.read.format("paged_json")`` with a schema and the options

``url``
    may hold ``{offset}``, ``{size}`` and ``{filters}``; http(s), or landed pages on
    any file system that pyarrow knows (a file, or a folder with the page in it)
``page_size``
    rows asked for at a time (1000)
``hits``
    path to the rows in an answer (``data.hits``)
``total``
    how many rows there are; without it the first page is read for what the
    service reports at ``total_path`` (``data.pagination.total``)
``short``
    ``fail`` (default): a page with other than the number of rows that the total
    promises is an error, so that no scan is silently incomplete. ``keep``: rows are
    taken as they come and a page that isn't there is empty, so a count below the total
    shows the gap (``truncation``)
``pages_per_task``, ``retries``, ``backoff``
    pages read one after the other in a partition (1), tries after the first
    (3) and seconds before the second (1)
``push``
    ``true``: equality filters are passed to the service as a filter tree

A page is asked for by its offset alone, so a task that runs again reads the same
rows. Objects and lists in a text column are given as JSON.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.types import StringType, StructType

from lathework.sources.remote import Missing, read, retried


class Pages(InputPartition):
    def __init__(self, offsets: list[int], total: int):
        self.offsets, self.total = offsets, total


def _at(body: dict, path: str):
    for part in path.split("."):
        body = (body or {}).get(part)
    return body


def _value(v, text: bool):
    return json.dumps(v) if text and isinstance(v, (dict, list)) else v


class PagedReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.schema = options, schema
        self.size = int(options.get("page_size", 1000))
        self.keep = options.get("short", "fail") == "keep"
        if options.get("short", "fail") not in ("fail", "keep"):
            raise ValueError("short is fail or keep")
        self.leaves: list[dict] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and self.options.get("push", "false") == "true":
                self.leaves.append({"op": "=", "content": {"field": ".".join(f.attribute), "value": f.value}})
            else:
                yield f

    def _page(self, offset: int) -> dict:
        filters = json.dumps({"op": "and", "content": self.leaves}) if self.leaves else ""
        url = self.options["url"].replace("{offset}", str(offset)).replace("{size}", str(self.size)).replace("{filters}", quote(filters))
        # an answer that was cut off doesn't parse, and is asked for again
        return retried(lambda: json.loads(read(url)), int(self.options.get("retries", 3)), float(self.options.get("backoff", 1.0)))

    def partitions(self) -> list[InputPartition]:
        total = self.options.get("total")
        if total is None:
            path = self.options.get("total_path", "data.pagination.total")
            total = _at(self._page(0), path)
            if total is None:
                raise ValueError(f"no total at {path}; give one")
        offsets, run = list(range(0, int(total), self.size)), int(self.options.get("pages_per_task", 1))
        return [Pages(offsets[k : k + run], int(total)) for k in range(0, len(offsets), run)] or [Pages([], 0)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        texts = [(f.name, isinstance(f.dataType, StringType)) for f in self.schema.fields]
        for offset in partition.offsets:
            try:
                rows = _at(self._page(offset), self.options.get("hits", "data.hits")) or []
            except Missing:
                if not self.keep:
                    raise
                rows = []
            promised = min(self.size, partition.total - offset)
            if len(rows) != promised and not self.keep:
                raise ValueError(f"{len(rows)} rows at {offset}, {promised} by the total of {partition.total}")
            for row in rows:
                yield tuple(_value(row.get(name), text) for name, text in texts)


class PagedJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        raise ValueError("give a schema")

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedJson)


def truncation(rows: DataFrame, reported: int) -> DataFrame:
    """``(retrieved, reported, truncated)``: whether a scan has fewer rows than the service says there are."""
    return rows.agg(F.count("*").alias("retrieved")).select("retrieved", F.lit(reported).cast("long").alias("reported"), (F.col("retrieved") < reported).alias("truncated"))


def land(rows: DataFrame, order: str, path: str, page_size: int = 1000) -> int:
    """Rows as the pages of such a service below ``path`` (``offset=0``, ``offset=1000``, ...), in the order of a numeric column without ties; how many rows there are.

    A page is one JSON answer with its rows and the total. There is a first page even without rows.
    """
    from lathework.frames import global_rank

    total = rows.count()
    own = global_rank(rows, order, "_at").withColumn("offset", F.floor(F.col("_at") / page_size) * page_size)
    hit = F.struct(*rows.columns)
    # a page's rows meet in one group: page_size of them
    pages = own.groupBy("offset").agg(F.array_sort(F.collect_list(F.struct("_at", hit.alias("hit"))))["hit"].alias("hits"))
    if not total:
        pages = rows.sparkSession.range(1).select(F.lit(0).cast("long").alias("offset"), F.array().cast("array<struct<x: int>>").alias("hits"))
    answer = F.struct(F.struct("hits", F.struct(F.lit(total).alias("total")).alias("pagination")).alias("data"))
    pages.select("offset", F.to_json(answer, {"ignoreNullFields": "false"}).alias("value")).repartition("offset").write.partitionBy("offset").text(path)
    return total
