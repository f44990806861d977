"""What the jobs share: configuration, the command line, logging, and their place in the shared folder when run as queries."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lathework.session import shared_dir

log = logging.getLogger("lathework.jobs")


def defaults(job_file: str) -> dict:
    """The settings in the JSON file beside a job's module."""
    with open(os.path.splitext(job_file)[0] + ".json", encoding="utf-8") as f:
        return json.load(f)


def settings(job_file: str, given: dict | None) -> dict:
    """The defaults with what is given in their place; unknown names are an error."""
    known = defaults(job_file)
    unknown = sorted((given or {}).keys() - known.keys())
    if unknown:
        raise ValueError(f"unknown settings {unknown}; known are {sorted(known)}")
    return known | (given or {})


def command_line(job_file: str, about: str, run: Callable, argv: list[str] | None = None) -> int:
    """Parse paths and an optional config file, make a session, run, stop the session."""
    p = argparse.ArgumentParser(description=about)
    p.add_argument("--input", required=True, help="path or glob of the table to read, in any store Spark reads")
    p.add_argument("--output", required=True, help="folder to write to; a later run with the same folder goes on from there")
    p.add_argument("--config", help="JSON file whose settings replace the defaults beside the job")
    p.add_argument("--master", help="Spark master, if spark-submit does not give one")
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO, stream=sys.stderr, format="%(asctime)s %(name)s %(message)s")
    given = None
    if a.config:
        with open(a.config, encoding="utf-8") as f:
            given = json.load(f)
    builder = SparkSession.builder.appName(os.path.splitext(os.path.basename(job_file))[0])
    spark = (builder.master(a.master) if a.master else builder).getOrCreate()
    try:
        run(spark, a.input, a.output, given)
    finally:
        spark.stop()
    return 0


def twice(spark: SparkSession, name: str, once: Callable[[str], DataFrame]) -> DataFrame:
    """A job run two times into one new folder of the shared place; what the second run leaves."""
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    once(folder)
    return once(folder)
