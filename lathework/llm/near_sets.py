"""Near-duplicates by SimHash blocks over shares of the shingles, verified by Hamming distance and by whole sets.

One SimHash over all shingles can't promise anything at a similarity of 0.8: its
bits differ by 15 per cent and by chance. Here a hash deals a set's shingles into
shares and each share has a SimHash of its own; the fingerprint is the row of
these blocks. Two sets of similarity ``t`` or more differ in at most
``d = (1 - t) / (1 + t) * (n + m)`` shingles, and each of these touches one block.
With ``d + 1`` blocks one stays untouched by the pigeonhole principle. Fewer do
for large sets, as shingles fall into the same blocks: the number is the least
that leaves all blocks touched with a chance of ``MISS`` at the most that two sets
of the range may differ, and less the more alike they are. The number depends on
a range of sizes; a set near a range's lower edge has blocks in the range below as
well. Sets under ``SMALL`` shingles, whose blocks may be empty, take single shingles
as blocks: the first ``n - ceil(t n) + 1`` in the order of hashes, of which two alike
sets share one. A block holds several shingles, so chance meetings stay few
whatever the number of texts.

Texts that share a block are verified: first by the Hamming distance of
fingerprints of ``64 * WORDS`` parity bits, where a shingle that one set has flips
one bit at most, so that no pair of ``t`` is ruled out; then by the similarity of
the whole sets, made from the texts of the pairs that are left. Sets are not
stored. Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lathework.llm.common import bounded_broadcast, map_texts
from lathework.llm.simhash import SEED, components
from lathework.session import materialize

SIMILARITY = 0.8
#: The chance that a pair at the limit shares no block; sets below SMALL shingles have none such; the ratio of a range's edges.
MISS, SMALL, RANGE = 1e-4, 40, 1.6
#: Blocks with more texts are compared in numpy, in pieces of CHUNK.
DENSE, CHUNK = 64, 1_024
#: Parity bits of a set, in 64s.
WORDS = 16
#: Rows of 16 to 32 bytes that are sent to every task at most.
MAX_SENT = 1_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct shingles' hashes, sorted; of a shorter text all its words are one. Lower case and words are as in ``simhash``."""
    own = (text or "").encode("utf-8", "replace").lower().split()
    if not own:
        return np.zeros(0, np.int64)
    digest = xxhash.xxh64_intdigest
    hashes = [digest(b" ".join(x), SEED) for x in zip(*(own[k:] for k in range(words)), strict=False)] if len(own) > words else [digest(b" ".join(own), SEED)]
    return np.unique(np.array(hashes, np.uint64).view(np.int64))


def parity(shingles: np.ndarray) -> np.ndarray:
    odd = np.bincount(shingles & (64 * WORDS - 1), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _may_be(differ, n, m, similarity: float):
    """Whether sets of n and m shingles whose parity differs in so many bits can be alike."""
    return differ * (1 + similarity) <= (1 - similarity) * (n + m) + 1e-9


def _alike(both, n, m, similarity: float):
    return both * (1 + similarity) >= similarity * (n + m) - 1e-9


@functools.cache
def block_count(most: int, similarity: float, miss: float = MISS) -> int:
    """Blocks for pairs whose smaller set has at most ``most`` shingles."""
    d = math.floor((1 - similarity) / (1 + similarity) * (most + math.floor(most / similarity)) + 1e-9)
    low, high = 1, d + 1
    while low < high:
        n = (low + high) // 2
        if (1 - (1 - 1 / n) ** d) ** n <= miss:
            high = n
        else:
            low = n + 1
    return low


@functools.cache
def range_edge(k: int) -> int:
    """The least size in range ``k``."""
    return SMALL if k == 0 else math.ceil(range_edge(k - 1) * RANGE)


def _range_of(n: int) -> int:
    k = 0
    while range_edge(k + 1) <= n:
        k += 1
    return k


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * _MIX
        return x ^ (x >> np.uint64(29))


def majority(words: np.ndarray, starts: np.ndarray, held: np.ndarray) -> np.ndarray:
    """SimHash of each run of 64-bit words: the bits that over half of its words have set.

    Counts of all 64 bits are kept side by side, a word for each binary digit.
    """
    order = np.argsort(-held, kind="stable")
    first, size = starts[order], held[order]
    most = int(size[0])
    digits = [np.zeros(len(size), np.uint64) for _ in range(most.bit_length())]
    left = np.searchsorted(-size, -np.arange(1, most + 1), side="right")
    for k in range(most):
        m = left[k]
        carry = words[first[:m] + k]
        for c in digits[: (k + 1).bit_length()]:
            c[:m], carry = c[:m] ^ carry, c[:m] & carry
    over, equal = np.zeros(len(size), np.uint64), np.full(len(size), 0xFFFFFFFFFFFFFFFF, np.uint64)
    half = (size // 2).astype(np.uint64)
    for b in range(len(digits) - 1, -1, -1):
        bar = np.uint64(0) - (half >> np.uint64(b) & np.uint64(1))
        over |= equal & digits[b] & ~bar
        equal &= ~(digits[b] ^ bar)
    out = np.empty(len(size), np.uint64)
    out[order] = over
    return out


def blocks(sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[np.ndarray]:
    """The block keys of each set of sorted shingle hashes."""
    out: list[list[np.ndarray]] = [[] for _ in sets]
    jobs = []  # (set, range)
    for k, s in enumerate(sets):
        n = len(s)
        least = math.ceil(n * similarity - 1e-9)  # sizes of sets that may be alike: from here on
        if 0 < n and least < SMALL:
            out[k].append(_mixed(s[: n - least + 1].view(np.uint64)))
        if n >= SMALL:
            jobs += [(k, q) for q in sorted({_range_of(n), _range_of(max(SMALL, least))})]
    if jobs:
        sizes = np.array([len(sets[k]) for k, _ in jobs])
        counts = np.array([block_count(range_edge(q + 1) - 1, similarity) for _, q in jobs], np.uint64)
        seeds = np.array([q + 1 for _, q in jobs], np.uint64)
        sh = np.concatenate([sets[k] for k, _ in jobs]).view(np.uint64)
        owner = np.repeat(np.arange(len(jobs)), sizes)
        share = ((_mixed(sh) >> np.uint64(32)) * counts[owner]) >> np.uint64(32)
        order = np.argsort(owner * (1 << 32) + share.astype(np.int64), kind="stable")
        share, owner, sh = share[order], owner[order], sh[order]
        starts = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (share[1:] != share[:-1])]))
        held = np.diff(np.append(starts, len(sh)))
        prints = majority(sh, starts, held)
        with np.errstate(over="ignore"):
            keys = _mixed(prints ^ _mixed(seeds[owner[starts]] * np.uint64(1 << 40) + share[starts]))
        cut = np.searchsorted(owner[starts], np.arange(len(jobs) + 1))
        for (k, _), a, b in zip(jobs, cut[:-1], cut[1:], strict=True):
            out[k].append(keys[a:b])
    return [np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in out]


def links(sets: DataFrame, full_sets, similarity: float = SIMILARITY) -> DataFrame:
    """Links ``(u, v)``, u < v, between distinct sets ``(id, n, blocks, bits)`` of ``similarity`` or more.

    ``full_sets`` is called with ids and gives their sets as ``(id, sh)``. All
    returned pairs are within ``similarity``. Texts of a block with over ``DENSE``
    of them are compared ``CHUNK`` by ``CHUNK``; a comparison returns a spanning
    forest of its links, never the pairs. Blocks with the same texts are compared once.
    """
    keyed = sets.select("id", "n", F.explode("blocks").alias("key")).repartition("key")
    own = Window.partitionBy("key")
    met = materialize(keyed.select("*", F.count("*").over(own).alias("c"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).over(own).alias("who")).where("c > 1"), "met_blocks")
    # of keys with the same texts one stands for all
    shared = materialize(met.join(met.groupBy("c", "who").agg(F.min("key").alias("key")).select("key"), "key", "left_semi").drop("who"), "shared_blocks", met)
    some = shared.where(F.col("c") <= DENSE)
    pairs = (
        some.select("key", F.col("id").alias("u"), F.col("n").alias("nu"))
        .join(some.select("key", F.col("id").alias("v"), F.col("n").alias("nv")), "key")
        .where(F.expr("u < v") & _alike(F.least("nu", "nv"), F.col("nu"), F.col("nv"), similarity))
        .select("u", "v")
        .distinct()
    )
    bits = materialize(sets.select("id", "n", "bits").join(shared.select("id").distinct(), "id", "left_semi"), "parity")
    differ = F.aggregate(F.zip_with("bu", "bv", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    pairs = (
        pairs.join(bits.select(F.col("id").alias("u"), F.col("n").alias("nu"), F.col("bits").alias("bu")), "u")
        .join(bits.select(F.col("id").alias("v"), F.col("n").alias("nv"), F.col("bits").alias("bv")), "v")
        .where(_may_be(differ, F.col("nu"), F.col("nv"), similarity))
    )
    pairs = materialize(pairs.select("u", "v"), "pairs")
    many = shared.where(F.col("c") > DENSE).select("key", "id", F.ceil(F.col("c") / CHUNK).cast("int").alias("parts"))
    many = many.withColumn("part", F.pmod(F.xxhash64("id", "key"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    meets = many.select("key", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "id").join(bits, "id")
    meets = materialize(meets.groupBy("key", "x", "y").applyInArrow(_meeting(similarity), "key long, x int, y int, id long"), "meetings")
    needed = pairs.select(F.col("u").alias("id")).union(pairs.select("v")).union(meets.select("id")).distinct()
    full = materialize(full_sets(needed), "needed_sets")
    both = F.size(F.array_intersect("su", "sv"))
    verified = (
        pairs.join(full.select(F.col("id").alias("u"), F.col("sh").alias("su")), "u")
        .join(full.select(F.col("id").alias("v"), F.col("sh").alias("sv")), "v")
        .where(_alike(both, F.size("su"), F.size("sv"), similarity))
        .select("u", "v")
    )
    meets = meets.join(full, "id")
    return verified.union(meets.groupBy("key", "x", "y").applyInArrow(_forest(similarity), "u long, v long")).distinct()


def _meeting(similarity: float):
    """The texts of a comparison that parity does not keep apart from all others."""

    def work(group: pa.Table) -> pa.Table:
        n = group.column("n").to_numpy()
        lists = group.column("bits").combine_chunks()
        bits = lists.flatten().to_numpy().view(np.uint64).reshape(-1, WORDS)
        stay = np.zeros(len(n), bool)
        for k in range(len(n) - 1):
            differ = np.bitwise_count(bits[k + 1 :] ^ bits[k]).sum(axis=1, dtype=np.int64)
            may = _may_be(differ, n[k + 1 :], n[k], similarity)
            stay[k] |= may.any()
            stay[k + 1 :] |= may
        return group.select(["key", "x", "y", "id"]).filter(pa.array(stay))

    return work


def _forest(similarity: float):
    def work(group: pa.Table) -> pa.Table:
        ids = group.column("id").to_numpy()
        sets = group.column("sh").combine_chunks()
        edge = sets.offsets.to_numpy()
        values = np.unique(sets.values.to_numpy(), return_inverse=True)[1]
        size = np.diff(edge)
        owner = np.repeat(np.arange(len(ids)), size)
        # the texts of each shingle, so that a set meets only those that share some
        order = np.argsort(values, kind="stable")
        texts, starts = owner[order], np.searchsorted(values[order], np.arange(values.max() + 2 if len(values) else 1))
        root = np.arange(len(ids))
        out = []
        for k in range(len(ids) - 1):
            if (root[k + 1 :] == root[k]).all():
                continue
            mine = values[edge[k] : edge[k + 1]]
            shared = np.bincount(np.concatenate([texts[starts[v] : starts[v + 1]] for v in mine]), minlength=len(ids))
            near = np.nonzero((root != root[k]) & (shared * (1 + similarity) >= similarity * (size + size[k]) - 1e-9))[0]
            for q in near[near > k]:
                if root[q] != root[k]:
                    root[root == root[q]] = root[k]
                    out.append((min(ids[k], ids[q]), max(ids[k], ids[q])))
        return pa.table({"u": pa.array([a for a, _ in out], pa.int64()), "v": pa.array([b for _, b in out], pa.int64())})

    return work


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text_key, group, component_id)`` for every row: texts whose sets of ``words``-word shingles have a Jaccard
    similarity of ``similarity`` or more are linked, groups are what links connect.

    ``group`` numbers the groups; ``component_id`` is the smallest id in it, null
    only if it has none. ``text_key`` is the text's XXH64, by which rows of one id
    with different texts are told apart. Null texts count as empty; texts without
    words are alike. Rows repeat as in ``docs``; other columns are ignored.
    """

    def make():
        def of(texts: list) -> list[list]:
            sets = [shingle_set(x, words) for x in texts]
            return [[xxhash.xxh64_intdigest(s.tobytes(), SEED) - (1 << 63) for s in sets], [len(s) for s in sets], blocks(sets, similarity), [parity(s) for s in sets]]

        return of

    plain = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t")).withColumn("text_key", F.xxhash64("_t"))
    own = map_texts(plain, ["_id", "text_key"], "_t", make, [("id", "long"), ("n", "int"), ("blocks", "array<long>"), ("bits", "array<long>")])
    own = materialize(own.withColumn("row", F.monotonically_increasing_id()), "set_blocks")
    # of rows with equal sets one takes part
    reps = materialize(own.groupBy("id").agg(F.min(F.struct("row", "text_key")).alias("rep"), F.count("*").alias("c")).select("id", "c", "rep.*"), "representatives")
    spare, _ = bounded_broadcast(own.select("id", "row").join(reps.where("c > 1").select("id", F.col("row").alias("first")), "id").where("row <> first").select("row"), MAX_SENT)
    distinct = own.join(spare, "row", "left_anti").select("id", "n", "blocks", "bits")

    def full_sets(needed: DataFrame) -> DataFrame:
        keys, _ = bounded_broadcast(materialize(reps.join(needed, "id").select("text_key").distinct(), "needed"), MAX_SENT)
        texts = plain.join(keys, "text_key", "left_semi").dropDuplicates(["text_key"])
        return map_texts(texts, ["text_key"], "_t", lambda: lambda found: [[shingle_set(x, words) for x in found]], [("sh", "array<long>")]).join(reps.select("id", "text_key"), "text_key").select("id", "sh")

    roots = components(links(distinct, full_sets, similarity))
    own = materialize(own.select("_id", "text_key", "id"), "near_ids", own)  # the blocks go
    named = own.groupBy("id").agg(F.min("_id").alias("rep")).join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    named = materialize(named, "near_roots")
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    return own.join(named.join(least, "root").select("id", F.col("root").alias("group"), "component_id"), "id").select(F.col("_id").alias(id_col), "text_key", "group", "component_id")


def keep_one(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of ``found``: the smallest id's (nulls last), of its texts the one with the smallest key.

    Of rows equal in id and text one stays. Texts move only where rows repeat,
    or where over ``MAX_SENT`` rows go.
    """
    order = F.struct(F.col(id_col).isNull(), id_col, "text_key")
    rows = materialize(found.groupBy(id_col, "text_key").agg(F.first("group").alias("group"), F.count("*").alias("c")), "near_rows")
    best = rows.groupBy("group").agg(F.min(order).alias("best"))
    marks = rows.join(best, "group").select(F.col(id_col).alias("_i"), F.col("text_key").alias("_k"), F.when(order == F.col("best"), F.when(F.col("c") > 1, "one")).otherwise("go").alias("_mark"))
    marks, _ = bounded_broadcast(materialize(marks.where("_mark is not null"), "near_marks"), MAX_SENT)
    packed = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_key"))
    met = packed.join(marks, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_key") == F.col("_k")), "left")
    repeated = met.where("_mark = 'one'").dropDuplicates(["_id", "_key"])
    return met.where("_mark is null").unionByName(repeated).select("_row.*")
