"""Frames without row order: global ranks by ranges, and hash-based draws."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lathework.session import materialize


def global_rank(df: DataFrame, order: str, target: str = "rank", per_range: int = 100_000) -> DataFrame:
    """``df`` with ranks 0..n-1 by a numeric column without nulls and without ties, and no sort in a single task.

    Values are cut into ranges at approximate quantiles; ranks are counted
    inside a range and offset by the sizes of the ranges before.
    """
    part, _ = range_parts(df, order, per_range, 4_096)
    dealt = df.withColumn("_part", part)
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row per range
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return dealt.withColumn("_in", inside).join(F.broadcast(before), "_part").withColumn(target, (F.col("_in") + F.col("_before")).cast("long")).drop("_part", "_in", "_before")


def running(df: DataFrame, keys: list[str], order: str, sums: dict[str, Column | str], reverse: bool = False, per_range: int = 100_000) -> DataFrame:
    """``df`` with running sums by ``order`` within ``keys``, the own row included; with ``reverse`` from the last row back.

    A scan on two levels, so that no window covers a whole group: ``order`` is cut
    into ranges, sums of the ranges before (a row per group and range) offset the
    sums inside a range. Rows that agree in keys and order must be aggregated
    beforehand; ``order`` has no nulls. Nulls in the summed columns add nothing.
    """
    part, ranges = range_parts(df, order, per_range, 4_096)
    own = df.withColumns({"_part": part.cast("int")} | {f"_{k}": F.col(c) if isinstance(c, str) else c for k, c in sums.items()})
    along = (lambda c: F.col(c).desc()) if reverse else (lambda c: F.col(c).asc())
    inside = Window.partitionBy(*keys, "_part").orderBy(along(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scanned = own.withColumns({f"_in_{k}": F.coalesce(F.sum(f"_{k}").over(inside), F.lit(0)) for k in sums})
    if ranges == 1:
        return scanned.withColumns({k: F.col(f"_in_{k}") for k in sums}).drop("_part", *[f"_{k}" for k in sums], *[f"_in_{k}" for k in sums])
    before = Window.partitionBy(*keys).orderBy(along("_part")).rowsBetween(Window.unboundedPreceding, -1)
    totals = own.groupBy(*keys, "_part").agg(*[F.sum(f"_{k}").alias(f"_all_{k}") for k in sums])
    offsets = totals.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_part").alias("_of"), *[F.coalesce(F.sum(f"_all_{k}").over(before), F.lit(0)).alias(f"_off_{k}") for k in sums])
    same = F.col("_part") == F.col("_of")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    out = scanned.join(offsets, same).withColumns({k: F.col(f"_in_{k}") + F.col(f"_off_{k}") for k in sums})
    return out.drop("_part", "_of", *[f"_key_{k}" for k in keys], *[f"{x}{k}" for k in sums for x in ("_", "_in_", "_off_")])


def quantiles(df: DataFrame, value: str, wanted: dict[str, float], keys: list[str] | None = None, per_range: int = 100_000) -> DataFrame:
    """``(keys..., names...)``: exact interpolated quantiles of a numeric column, a row per group with a value.

    Equal values are counted once; running counts over ranges of values say which
    value stands at a rank. No task holds a group's values. Nulls are left out.
    Without keys there is one row, of nulls if there are no values.
    """
    keys = keys or []
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_value")).agg(F.count("*").alias("_m"))
    cells = materialize(counted, "values")
    ranked = running(cells, keys, "_value", {"_upto": "_m"}, per_range=per_range)
    sizes = cells.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(F.sum("_m").alias("_n"))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    met = ranked.join(sizes, same) if keys else ranked.crossJoin(F.broadcast(sizes))  # a row
    at = lambda rank: F.max(F.when((F.col("_upto") - F.col("_m") <= rank) & (rank < F.col("_upto")), F.col("_value")))
    found = []
    for name, q in wanted.items():
        place = F.lit(float(q)) * (F.col("_n") - 1)
        found += [at(F.floor(place)).alias(f"_low_{name}"), at(F.ceil(place)).alias(f"_high_{name}"), F.max(place - F.floor(place)).alias(f"_part_{name}")]
    between = lambda n: (1 - F.col(f"_part_{n}")) * F.col(f"_low_{n}") + F.col(f"_part_{n}") * F.col(f"_high_{n}")
    return met.groupBy(*keys).agg(*found).select(*keys, *[between(n).alias(n) for n in wanted])


def hash_draw(n: Column | int, *parts: Column | str) -> Column:
    """A draw from 0..n-1 by the first 32 bits of the MD5 of the joined parts: the same in any engine."""
    columns = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("-", *columns)), 1, 8), 16, 10).cast("long") % n


#: MD5's shifts and constants.
_SHIFTS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_SINES = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint32)


def md5_words(messages: np.ndarray) -> np.ndarray:
    """The first 32 bits of the MD5 of each row of bytes, all equally long and 55 at most."""
    n, size = messages.shape
    if size > 55:
        raise ValueError(f"{size} bytes; one block takes 55")
    block = np.zeros((n, 64), np.uint8)
    block[:, :size], block[:, size] = messages, 0x80
    block[:, 56:64] = np.frombuffer((8 * size).to_bytes(8, "little"), np.uint8)
    words = np.ascontiguousarray(block.view("<u4").T)
    first = [np.uint32(v) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(n, v) for v in first)
    for i in range(64):
        turn = i // 16
        if turn == 0:
            f, g = d ^ (b & (c ^ d)), i
        elif turn == 1:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif turn == 2:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += _SINES[i]
        if 4 * g <= size or g == 14:  # other words are zero
            f += words[g]
        s = _SHIFTS[turn][i % 4]
        a, d, c, b = d, c, b, b + (f << np.uint32(s) | f >> np.uint32(32 - s))
    return (a + first[0]).byteswap()


def hash_draws(seed: str, b: np.ndarray, k: np.ndarray, n: int) -> np.ndarray:
    """``hash_draw(n, seed, b, k)`` of numbers that are not negative, for many at a time."""
    digits = lambda v: np.searchsorted(10 ** np.arange(1, 19), v, side="right") + 1
    sizes = digits(b) * 32 + digits(k)
    out, head = np.empty(len(b), np.int64), np.frombuffer(f"{seed}-".encode(), np.uint8)
    for size in np.unique(sizes):
        found = np.flatnonzero(sizes == size)
        wide_b, wide_k = divmod(int(size), 32)
        for at in range(0, len(found), 2**14):  # few at a time, so that they stay in the cache
            rows = found[at : at + 2**14]
            text = np.empty((len(rows), len(head) + wide_b + 1 + wide_k), np.uint8)
            text[:, : len(head)], text[:, len(head) + wide_b] = head, ord("-")
            for value, wide, end in ((b[rows], wide_b, len(head) + wide_b), (k[rows], wide_k, text.shape[1])):
                for place in range(wide):
                    value, rest = np.divmod(value, 10)
                    text[:, end - 1 - place] = rest + ord("0")
            out[rows] = md5_words(text).astype(np.int64) % n
    return out


def hash_order(*parts: Column | str) -> Column:
    """The first 32 bits of the same hash, to order rows by."""
    columns = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("-", *columns)), 1, 8), 16, 10).cast("long")


def range_parts(df: DataFrame, key: str, per_range: int, max_ranges: int = 20_000) -> tuple[Column, int]:
    """A column that numbers ranges of ``key`` in ascending order (nulls in the first), and how many there are at most.

    The cuts are approximate quantiles about ``per_range`` rows apart; there are
    at most ``max_ranges``, which bounds what the driver and the plan hold. A row
    finds its range by binary search. Equal keys share a range.
    """
    cuts = cut_points(df, key, per_range, max_ranges)
    if not cuts:
        return F.lit(0), 1
    return cut_position(F.col(key), cuts), len(cuts) + 1


def cut_points(df: DataFrame, key: str, per_range: int, max_ranges: int) -> list:
    """Ascending approximate quantiles of ``key`` about ``per_range`` rows apart, fewer than ``max_ranges``; none for a single range."""
    ranges = min(max_ranges, max(1, -(-df.count() // per_range)))
    if ranges == 1:
        return []
    found = df.agg(F.percentile_approx(key, [k / ranges for k in range(1, ranges)], 10 * max(1_000, ranges))).first()[0]
    return sorted(set(found or []))


def cut_position(key: Column, cuts: list) -> Column:
    """How many of ``cuts`` are below ``key``, by binary search; 0 for null."""
    half = lambda s: F.floor((s["l"] + s["h"]) / 2).cast("int")
    state = lambda low, high: F.struct(low.cast("int").alias("l"), high.cast("int").alias("h"))
    step = lambda s, _: F.when(s["l"] >= s["h"], s).when(key > F.element_at(F.lit(cuts), half(s) + 1), state(half(s) + 1, s["h"])).otherwise(state(s["l"], half(s)))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(len(cuts).bit_length() + 1)), state(F.lit(0), F.lit(len(cuts))), step, lambda s: s["l"])
    return F.coalesce(F.when(key.isNotNull(), found), F.lit(0))
