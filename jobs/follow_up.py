"""Follow-up counts: measurements that keep landing, as a matrix per day that is kept up to date.

Takes the files of a folder (or glob) that no earlier run has taken, as a file
stream that ends when nothing new is left. Below the output folder are

* ``checkpoint/``: which files have been taken,
* ``parts/day=.../batch=.../``: each batch's counts and sums,
* ``counts/day=.../`` with ``sample_id, feature_id, n, total``: the sums over
  all batches; a batch rewrites the days that it has rows for and no others.

A batch that is run again after a failure replaces its own parts and the same
days, so nothing counts twice. Rows without a time belong to the null day.

    python jobs/follow_up.py --input 'landing/*.parquet' --output out [--config follow_up.json]
"""

from __future__ import annotations

import os
import sys

if __package__ in (None, ""):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

from jobs import common  # noqa: E402
from lathework.functions.columns import r6  # noqa: E402
from lathework.streaming.incremental import daily_counts, merged_counts  # noqa: E402


def _schema(rows: DataFrame, how: dict, *more: str) -> T.StructType:
    """Of counts of ``rows`` as written: the sample's and feature's own types."""
    kind = lambda c: rows.schema[how[c]].dataType.simpleString()
    return T._parse_datatype_string(", ".join([f"sample_id {kind('sample')}", f"feature_id {kind('feature')}", "n long", "total double", "day date", *more]))


def _glob(path: str) -> str:
    """A pattern that only ``path`` matches: a stream takes a plain path for a folder, a pattern may match a single file too."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, source: str, output: str, given: dict | None = None) -> DataFrame:
    """Take what is new, bring its days up to date; the counts as they stand in ``output``, sums rounded to six places."""
    how = common.settings(__file__, given)
    like = spark.read.parquet(source)
    part_schema, schema = _schema(like, how, "batch long"), _schema(like, how)
    parts, counts = f"{output}/parts", f"{output}/counts"
    dynamic = {"partitionOverwriteMode": "dynamic"}

    def take(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        own = daily_counts(batch, how["time"], how["sample"], how["feature"], how["value"]).withColumn("batch", F.lit(number))
        own.repartition("day").write.mode("overwrite").options(**dynamic).partitionBy("day", "batch").parquet(parts)
        all_parts = session.read.schema(part_schema).parquet(parts)
        days = all_parts.where(F.col("batch") == number).select(F.col("day").alias("_day")).distinct()
        touched = all_parts.join(days, F.col("day").eqNullSafe(F.col("_day")), "left_semi")
        merged_counts(touched).repartition("day").write.mode("overwrite").options(**dynamic).partitionBy("day").parquet(counts)
        common.log.info("batch %d: wrote %s and the days of %s that it touches", number, parts, counts)

    stream = (
        spark.readStream.schema(like.schema)
        .option("maxFilesPerTrigger", how["files_per_batch"])
        .option("maxFileAge", "36500d")  # a file that lands late may be older than those taken
        .parquet(_glob(source))
    )
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{output}/checkpoint").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    common.log.info("read %s: %d new rows in %d batches", source, sum(p.numInputRows for p in query.recentProgress), sum(p.numInputRows > 0 for p in query.recentProgress))
    return spark.read.schema(schema).parquet(counts).withColumn("total", r6("total"))


if __name__ == "__main__":
    sys.exit(common.command_line(__file__, "Follow-up counts of what has landed since the last run.", run))
