"""Landed files: manifests, per-sample measurement files, record tables, id lists; and their sinks.

Every reader has an explicit schema, reads all files of a glob in parallel and
takes keys from file paths where the files have none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "file_id string, file_name string, case_id string, submitter_id string, sample_type string, sample_id string"
SENTINELS = ("[Not Available]", "[Not Applicable]")


def exists(spark: SparkSession, pattern: str) -> bool:
    """Whether a path or glob matches anything, in whatever store Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def first_glob(spark: SparkSession, *patterns: str) -> str:
    """The first pattern with a match."""
    for p in patterns:
        if exists(spark, p):
            return p
    raise FileNotFoundError(f"nothing matches {patterns}")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).csv(path, sep="\t", header=True)


def one_file_per_patient(manifest: DataFrame, key: str = "submitter_id") -> DataFrame:
    """``(file_id, patient_id)``: the first file of each patient, by sample then file id; rows without a key go."""
    from lathework.functions.columns import leading_fields
    from lathework.operators.relate import keep_first

    own = manifest.where(F.col(key).isNotNull() & (F.col(key) != "")).withColumn("patient_id", leading_fields(F.col(key)))
    return keep_first(own, ["patient_id"], [F.col("sample_id"), F.col("file_id")]).select("file_id", "patient_id")


def flatten_response(spark: SparkSession, path: str) -> DataFrame:
    """A landed JSON response ``{"data": {"hits": [...]}}`` as manifest rows; the first case and sample of each hit."""
    schema = "data struct<hits: array<struct<file_id: string, file_name: string, cases: array<struct<case_id: string, submitter_id: string, samples: array<struct<sample_id: string, sample_type: string>>>>>>, pagination: struct<total: bigint, count: bigint>>"
    hits = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("data.hits").alias("h"))
    case = F.get(F.col("h.cases"), 0)
    sample = F.get(case["samples"], 0)
    text = lambda c: F.coalesce(c, F.lit(""))
    return hits.select(F.col("h.file_id").alias("file_id"), F.col("h.file_name").alias("file_name"), text(case["case_id"]).alias("case_id"), text(case["submitter_id"]).alias("submitter_id"), text(sample["sample_type"]).alias("sample_type"), text(sample["sample_id"]).alias("sample_id"))


def flatten_cases(spark: SparkSession, path: str, whole_file: bool = True) -> DataFrame:
    """Landed JSON responses of cases, a row each: ids, survival and stage of the first diagnosis, age; what is absent is empty.

    A file is one response, or without ``whole_file`` one in each line.
    """
    diagnosis = ("vital_status", "days_to_death", "days_to_last_follow_up", "ajcc_pathologic_stage")
    schema = f"data struct<hits: array<struct<case_id: string, submitter_id: string, diagnoses: array<struct<{', '.join(f'{c}: string' for c in diagnosis)}>>, demographic: struct<age_at_index: string>>>>"
    case = spark.read.schema(schema).json(path, multiLine=whole_file).select(F.explode("data.hits").alias("h"))
    text = lambda c: F.coalesce(c, F.lit(""))
    first = F.get(F.col("h.diagnoses"), 0)
    return case.select(*[text(F.col(f"h.{c}")).alias(c) for c in ("case_id", "submitter_id")], *[text(first[c]).alias(c) for c in diagnosis], text(F.col("h.demographic.age_at_index")).alias("age_at_index"))


#: Tasks that list folders: one for each folder would take longer to start than to list.
LISTERS = 64


def _csv(spark: SparkSession, place: str, schema: str | None = None, **options) -> DataFrame:
    """The tab-separated files of a glob, or those at any depth below a folder.

    The driver expands a glob folder by folder; the folders below a given one are listed by ``LISTERS`` tasks.
    """
    read = spark.read.options(**options) if schema is None else spark.read.schema(schema).options(**options)
    if any(c in place for c in "*?[{"):
        return read.csv(place, sep="\t")
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), LISTERS)))
    try:
        return read.options(recursiveFileLookup=True).csv(place, sep="\t")
    finally:
        spark.conf.set(name, before)


def _file_key() -> F.Column:
    """The name of the folder that a file is in."""
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)


def counts(spark: SparkSession, pattern: str, value: str = "unstranded", skip_prefix: str = "N_") -> DataFrame:
    """``(file_id, feature_id, value)`` from per-sample count tables with comment lines and summary rows."""
    raw = _csv(spark, pattern, header=True, comment="#")
    return raw.select(_file_key().alias("file_id"), F.col("gene_id").alias("feature_id"), F.col(value).cast("long").cast("double").alias("value")).where(~F.startswith("feature_id", F.lit(skip_prefix)))


def two_columns(spark: SparkSession, pattern: str) -> DataFrame:
    """``(file_id, feature_id, value)`` from headerless files of a key and a number; aligned by key, not by line."""
    raw = _csv(spark, pattern, "feature_id string, value double", nullValue="NA")
    return raw.select(_file_key().alias("file_id"), "feature_id", "value")


def copy_number(spark: SparkSession, pattern: str, neutral: float = 2.0) -> DataFrame:
    """``(file_id, feature_id, value)``; missing numbers become neutral."""
    raw = _csv(spark, pattern, header=True)
    return raw.select(_file_key().alias("file_id"), F.col("gene_id").alias("feature_id"), F.coalesce(F.col("copy_number").try_cast("double"), F.lit(neutral)).alias("value"))


def assemble(long: DataFrame, files: DataFrame) -> DataFrame:
    """``(sample_id, feature_id, value)``: files to patients; files without a patient are skipped."""
    return long.join(files.select("file_id", F.col("patient_id").alias("sample_id")), "file_id").select("sample_id", "feature_id", "value")


def records(spark: SparkSession, path: str, columns: dict[str, str], key: str, key_prefix: str, numeric: tuple[str, ...] = ()) -> DataFrame:
    """A record table with extra header lines, read as text: wanted columns that are there, renamed; other lines go by their key.

    Numbers are read leniently, so sentinels become null.
    """
    raw = spark.read.option("header", True).csv(path, sep="\t")
    have = [c for c in columns if c in raw.columns]
    own = raw.select(*[F.col(c).alias(columns[c]) for c in have]).where(F.startswith(key, F.lit(key_prefix)))
    return own.withColumns({c: F.col(c).try_cast("double") for c in numeric if c in own.columns})


def annotation(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Chosen columns of a (compressed) table; absent ones are left out."""
    raw = spark.read.option("header", True).csv(path, sep="\t")
    return raw.select(*[c for c in columns if c in raw.columns])


def id_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''")


def write_id_list(ids: DataFrame, path: str) -> None:
    """One sorted text file of a cohort's ids."""
    ids.select(F.col(ids.columns[0]).cast("string").alias("value")).orderBy("value").coalesce(1).write.text(path)


def write_table(df: DataFrame, path: str, digits: dict[str, int] | None = None) -> None:
    """A TSV of a result table, in full precision; ``digits`` adds a formatted column ``<name>_text`` to each named one."""
    for c, n in (digits or {}).items():
        df = df.withColumn(f"{c}_text", F.format_string(f"%.{n}f", c))
    arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    df = df.withColumns({c: F.concat(F.lit("["), F.array_join(F.col(c).cast("array<string>"), ", "), F.lit("]")) for c in arrays})
    df.coalesce(1).write.csv(path, sep="\t", header=True)
