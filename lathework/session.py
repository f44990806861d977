"""Session settings and shared-storage helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "lathework") -> SparkSession:
    """A session with the settings the engine is tested under."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset and everything runs on this machine (tests) is a local folder made for it.
    """
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = getattr(spark.sparkContext, "_lathework_dir", None)
    if own is None:
        own = tempfile.mkdtemp(prefix="lathework-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext._lathework_dir = own
    return "file://" + own


def materialize(df: DataFrame, name: str = "step", replaces: DataFrame | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts lineage: what is lost with an executor is read again from the folder.
    ``replaces`` is an earlier result of this function, say of the round before,
    that nothing will read any more: its files go once the new ones are there.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    old = getattr(replaces, "_lathework_path", None)
    if old:
        place = spark._jvm.org.apache.hadoop.fs.Path(old)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    out = spark.read.schema(df.schema).parquet(path)
    out._lathework_path = path
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
