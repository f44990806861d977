"""Term matrix: free text of many sites as one more modality of a cohort study.

Reads a table of texts, counts each sample's terms, and prepares the counts as
any count matrix is prepared for integration: per million, low-count filter,
log2, the most variable terms, z-scores over all samples. Writes, below the
output folder,

* ``matrix/block=.../`` with ``sample_id, feature_id, value``, a row per cell,
* ``samples/`` with ``sample_id, n_texts, n_terms``.

Every run reads the whole input and replaces both, so it can be repeated; an
input that did not change gives the same rows.

    python jobs/term_matrix.py --input documents.parquet --output out [--config term_matrix.json]
"""

from __future__ import annotations

import os
import sys

if __package__ in (None, ""):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import Column, DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from jobs import common  # noqa: E402
from lathework.functions.columns import r6  # noqa: E402
from lathework.operators import matrix  # noqa: E402
from lathework.session import materialize  # noqa: E402

#: Texts without a sample belong to this one.
NO_SAMPLE = "(none)"
#: Columns of the matrix as written.
MATRIX = "sample_id string, feature_id string, value double, block int"


def terms(text: Column, min_letters: int) -> Column:
    """Lower-case runs of ASCII letters of at least ``min_letters``; null texts have none."""
    return F.filter(F.split(F.lower(text), "[^a-z]+"), lambda t: F.length(t) >= min_letters)


def term_counts(texts: DataFrame, min_letters: int) -> DataFrame:
    """``(sample_id, feature_id, value)`` of ``texts (sample_id, text)``: how often each term occurs in the texts of each sample."""
    return texts.select("sample_id", F.explode(terms(F.col("text"), min_letters)).alias("feature_id")).groupBy("sample_id", "feature_id").agg(F.count("*").cast("double").alias("value"))


def run(spark: SparkSession, source: str, output: str, given: dict | None = None) -> DataFrame:
    """Read, count, prepare, write; the matrix as it stands in ``output``."""
    how = common.settings(__file__, given)
    texts = spark.read.parquet(source).select(F.coalesce(F.col(how["sample"]).cast("string"), F.lit(NO_SAMPLE)).alias("sample_id"), F.col(how["text"]).alias("text"))
    common.log.info("read %s: %d rows", source, texts.count())
    counts = materialize(term_counts(texts, how["min_letters"]), "term_counts")
    sizes = texts.groupBy("sample_id").agg(F.count("*").alias("n_texts"))
    samples = sizes.join(matrix.library_size(counts), "sample_id", "left").select("sample_id", "n_texts", F.coalesce("library_size", F.lit(0.0)).cast("long").alias("n_terms"))
    samples.write.mode("overwrite").parquet(f"{output}/samples")
    common.log.info("wrote %s/samples: %d rows", output, spark.read.schema(samples.schema).parquet(f"{output}/samples").count())

    cells = matrix.prepare_counts(counts, how["n_top"]).select("sample_id", "feature_id", r6("value").alias("value"))
    cells = cells.withColumn("block", F.pmod(F.xxhash64("feature_id"), F.lit(how["blocks"])).cast("int"))
    cells.repartition("block").write.mode("overwrite").partitionBy("block").parquet(f"{output}/matrix")
    written = spark.read.schema(MATRIX).parquet(f"{output}/matrix")
    common.log.info("wrote %s/matrix: %d cells in blocks of terms", output, written.count())
    return written


if __name__ == "__main__":
    sys.exit(common.command_line(__file__, "Term matrix of a table of texts.", run))
