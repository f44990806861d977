"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lathework.frames import range_parts  # noqa: F401

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bounded_broadcast(df: DataFrame, max_rows: int) -> tuple[DataFrame, bool]:
    """``df`` marked for broadcast if it has at most ``max_rows`` rows (counted), and whether it is."""
    small = few(df, max_rows)
    return (F.broadcast(df) if small else df), small


def meet_groups(rows: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner", max_rows: int = 5_000, copies: int = 32, small: bool | None = None) -> DataFrame:
    """Rows with their group's values, a row per group.

    Up to ``max_rows`` groups are broadcast and the rows stay where they are. More
    of them are joined by key, each group's row once for each value
    0..``copies``-1 of the rows' column ``salt``, which deals a hot group out.
    Groups are counted, unless the caller has done so and says in ``small``
    whether they are that few.
    """
    if small is None:
        small = few(groups, max_rows)
    if small:
        return rows.join(F.broadcast(groups), keys, how)
    return rows.join(groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))), [*keys, "salt"], how)


def few(df: DataFrame, max_rows: int = 5_000) -> bool:
    return df.limit(max_rows + 1).count() <= max_rows


def hash_sample(rows: DataFrame, most: int, n: int, *columns: str) -> DataFrame:
    """``most`` of ``n`` rows: those with the smallest hashes of ``columns``.

    Rows are first thinned to about one and a half times as many by a bound on
    the hash, in the scan, so that what meets in one task doesn't grow with the
    input. Columns that tell rows apart must be among those hashed.
    """
    key = F.xxhash64(*columns)
    if n > 3 * most:
        rows = rows.where(key <= F.lit(-(1 << 63) + int((1 << 64) * 1.5 * most / n)))
    return rows.orderBy(key, *columns).limit(most)


def map_texts(df: DataFrame, keep: list[str], text: str, make: Callable[[], Callable[[list], list[list]]], fields: list[tuple[str, str]], rows: int = 512) -> DataFrame:
    """The columns ``keep`` of ``df`` unchanged, and ``fields`` that a function makes from the texts.

    ``make`` is called once in each task and returns the function: a list of
    texts in, one list per field out. Batches are cut into ``rows`` rows, which
    bounds what a task holds; there is no shuffle.
    """
    schema = T.StructType([df.schema[c] for c in keep] + T._parse_datatype_string(", ".join(f"`{n}` {t}" for n, t in fields)).fields)
    kinds = to_arrow_schema(schema)
    n = len(keep)
    at_text = keep.index(text) if text in keep else n  # a text that is kept is not sent twice
    held = lambda a, kind: a if a.type == kind else a.cast(kind)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                made = of(part.column(at_text).to_pylist())
                arrays = [held(part.column(k), kinds.field(k).type) for k in range(n)] + [pa.array(x, type=kinds.field(n + k).type) for k, x in enumerate(made)]
                yield pa.RecordBatch.from_arrays(arrays, schema=kinds)

    return df.select(*keep, *([] if text in keep else [F.col(text).alias("_text")])).mapInArrow(work, schema)
