"""Sharding by a keyed permutation of global row numbers.

Rows are numbered 0..N-1 by ascending id (ties by text). A Feistel network
over the mixed-radix domain a x b, a = ceil(sqrt(N)), b = ceil(N / a), permutes
the numbers; a result outside 0..N-1 is fed back until it falls inside (cycle
walking), which keeps it a permutation. Permuted number p goes to shard
``p % n`` at slot ``p / n``: shard counts differ by at most one, slots have no
gaps, and a row's place can be computed from its number alone.

The row numbers need no global sort in one task: ids are cut into ranges at
approximate quantiles, rows are numbered within a range, and the ranges' counts
give the offsets. The numbers don't depend on where the cuts fall. Only ids,
sizes and checksums are shuffled, never texts.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lathework.llm.common import documents, range_parts
from lathework.session import materialize

ROUNDS, PRIME = 6, 2_147_483_647
#: Multiplier and addend of each round, below PRIME.
KEYS = [((48_271 * (k + 1) ** 5 + 1_234_567 * k) % PRIME, (69_621 * (k + 3) ** 4 + 7_654_321) % PRIME) for k in range(ROUNDS)]
#: Steps of the cycle walk. Fewer than a numbers lie outside, so this many always do for N up to 4,096 and,
#: at a chance under 1 / a for each, for any larger N.
WALK = 66


def domain(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def mix(x: int, k: int, seed: int) -> int:
    """The round function: two multiplications modulo a prime."""
    m, c = KEYS[k]
    y = ((x % PRIME) * m + c + seed) % PRIME
    return y * y % PRIME


def permute(x: int, n: int, seed: int = 0) -> int:
    """The place of row number ``x`` of ``n``; the plain form of ``permuted``."""
    a, b = domain(n)
    while True:
        left, right = x // b, x % b
        for k in range(ROUNDS):
            if k % 2 == 0:
                left = (left + mix(right, k, seed)) % a
            else:
                right = (right + mix(left, k, seed)) % b
        x = left * b + right
        if x < n:
            return x


def feistel_sql(x: str, n: int, seed: int) -> list[tuple[str, str]]:
    """The permutation's steps as ``(name, SQL)``: each may use the names before it; the last is the result."""
    a, b = domain(n)
    steps = [("l0", f"({x}) div {b}"), ("r0", f"({x}) % {b}")]
    left, right = "l0", "r0"
    for k in range(ROUNDS):
        m, c = KEYS[k]
        source = right if k % 2 == 0 else left
        steps.append((f"y{k}", f"(({source} % {PRIME}L) * {m}L + {c + seed}L) % {PRIME}L"))
        if k % 2 == 0:
            steps.append((f"l{k + 1}", f"({left} + (y{k} * y{k}) % {PRIME}L) % {a}L"))
            left = f"l{k + 1}"
        else:
            steps.append((f"r{k + 1}", f"({right} + (y{k} * y{k}) % {PRIME}L) % {b}L"))
            right = f"r{k + 1}"
    return [*steps, ("out", f"{left} * {b}L + {right}")]


def _apply(df: DataFrame, source: str, target: str, n: int, seed: int) -> DataFrame:
    """One pass of the permutation, a projection for each step: nothing is written out twice."""
    names = []
    for name, sql in feistel_sql(source, n, seed):
        df = df.withColumn(f"_{name}", F.expr(_prefixed(sql)))
        names.append(f"_{name}")
    return df.withColumn(target, F.col("_out")).drop(*names)


def _prefixed(sql: str) -> str:
    return re.sub(r"\b([lry]\d+)\b", r"_\1", sql)


def permuted(df: DataFrame, number: str, target: str, n: int, seed: int = 0) -> DataFrame:
    """``df`` with the place of each row number; ``n`` must be the number of rows."""
    first = _apply(df, number, "_once", n, seed)
    a, b = domain(n)
    if a * b == n:
        return first.withColumnRenamed("_once", target)
    # the walk: rare rows (fewer than one in sqrt(n)) go on inside one expression
    body = "v"
    nested = feistel_sql("v", n, seed)
    for name, sql in reversed(nested[:-1]):
        body = f"aggregate(array(0), {sql}, (s, e) -> s, {name} -> {nested[-1][1] if body == 'v' else body})"
    walk = f"aggregate(sequence(1, {WALK}), _once, (v, e) -> if(v < {n}L, v, {body}))"
    out = first.withColumn(target, F.expr(f"if(_once < {n}L, _once, {walk})"))
    return out.withColumn(target, F.expr(f"if({target} < {n}L, {target}, raise_error('cycle walk did not end'))").cast("long")).drop("_once")


def row_numbers(rows: DataFrame, order: list[str], target: str, per_range: int = 50_000, max_ranges: int = 4_096) -> tuple[DataFrame, int]:
    """``rows`` with global numbers 0..N-1 by ``order`` (its first column a number; nulls first), and N.

    The cuts are approximate quantiles of the first column, about ``per_range``
    rows apart and at most ``max_ranges``, which bounds what the driver holds. The
    numbers are those of one global sort.
    """
    part, _ = range_parts(rows, order[0], per_range, max_ranges)
    dealt = rows.withColumn("_part", part)
    counts = dict(dealt.groupBy("_part").agg(F.count("*")).collect())  # a row per range
    ahead, total = [], 0
    for p in range(max(counts, default=0) + 1):
        ahead.append(total)
        total += counts.get(p, 0)
    w = Window.partitionBy("_part").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    number = F.row_number().over(w) - 1 + F.element_at(F.lit(ahead), F.col("_part") + 1)
    return dealt.withColumn(target, number.cast("long")).drop("_part"), total


def shards(docs: DataFrame, n_shards: int = 16, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``row_number``.

    Size is the text's UTF-8 bytes plus one; a null text counts as empty. Ids
    are numbers; null ones come first. Equal ids are ordered by checksum and
    size; rows equal in all three take neighbouring numbers in any order. Other
    columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    own = materialize(own, "sizes")
    numbered, n = row_numbers(own, [id_col, "text_crc32", "size"], "row_number")
    placed = permuted(numbered, "row_number", "_place", n, seed) if n else numbered.withColumn("_place", F.col("row_number"))
    return placed.select(
        id_col, "size", "text_crc32", F.lit("rows").alias("law"), (F.col("_place") % n_shards).cast("int").alias("shard"),
        F.expr(f"_place div {n_shards}").alias("slot"), "row_number",
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shards(documents(spark, sf_dir))
    return found.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
