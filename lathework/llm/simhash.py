"""SimHash near-duplicate detection by pigeonhole blocks.

A fingerprint has 64 bits. Two fingerprints that differ in at most ``d`` bits
agree in at least two of ``d + 2`` blocks, so every link is found by joining on
pairs of blocks and verifying the Hamming distance. Only distinct fingerprints
are joined: copies share one.

Blocks with more than ``dense_block`` distinct fingerprints are not joined with
themselves. Their members go through an exact linear way: fingerprints are
within ``d`` bits iff the balls of radius ``floor(d/2)`` and ``ceil(d/2)``
around them meet, so each member is sent to the points of its ball and linked
there to the smallest member. The links are the same up to connectivity.
"""

from __future__ import annotations

import itertools

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lathework.llm.common import documents, map_texts
from lathework.session import materialize

SEED = 42


def fingerprint_one(text: str | None, words: int = 3, seed: int = SEED) -> int:
    """The fingerprint of one text as an unsigned integer; 0 if it has no words."""
    own = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not own:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(own) <= words:
        hashes = [digest(b" ".join(own), seed)]
    else:
        hashes = [digest(b" ".join(x), seed) for x in zip(*(own[k:] for k in range(words)), strict=False)]
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    majority = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(majority, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """``(id, fp)``: the fingerprint as a signed long (two's complement of the 64 bits)."""

    def make():
        return lambda texts: [np.array([fingerprint_one(x, words) for x in texts], dtype=np.uint64).view(np.int64)]

    return map_texts(docs, [id_col], text_col, make, [("fp", "long")])


def block_masks(max_bits: int) -> list[int]:
    """Masks of all pairs of the ``max_bits + 2`` blocks of 64 bits."""
    n = max_bits + 2
    edge = [round(64 * k / n) for k in range(n + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(edge)]
    return [x | y for x, y in itertools.combinations(block, 2)]


def ball(radius: int) -> list[int]:
    """All masks of at most ``radius`` bits."""
    return [sum(1 << b for b in c) for r in range(radius + 1) for c in itertools.combinations(range(64), r)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(_signed(v)).cast("long") for v in values])


def links(fps: DataFrame, max_bits: int = 2, dense_block: int = 1000) -> DataFrame:
    """Links ``(u, v)``, u < v, that connect exactly the distinct fingerprints ``fp`` within ``max_bits`` bits.

    Every returned pair is within ``max_bits``; inside blocks of over
    ``dense_block`` fingerprints pairs may be represented by a path.
    """
    masks = block_masks(max_bits)
    keyed = fps.select("fp", F.posexplode(_longs(masks)).alias("k", "mask")).select("fp", "k", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    size = keyed.groupBy("k", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(keyed.join(size, ["k", "key"]), "blocks")
    some = shared.where(F.col("n") <= dense_block)
    pairs = (
        some.select("k", "key", F.col("fp").alias("u"))
        .join(some.select("k", "key", F.col("fp").alias("v")), ["k", "key"])
        .where("u < v and bit_count(u ^ v) <= %d" % max_bits)
        .select("u", "v")
    )
    low, high = max_bits // 2, max_bits - max_bits // 2
    dense = shared.where(F.col("n") > dense_block).select("fp").distinct()
    near = ball(low)
    points = dense.select("fp", F.posexplode(_longs(ball(high))).alias("at", "mask")).select("fp", (F.col("at") < len(near)).alias("inner"), F.col("fp").bitwiseXOR(F.col("mask")).alias("point"))
    least = points.where("inner").groupBy("point").agg(F.min("fp").alias("least"))
    stars = points.join(least, "point").where("fp <> least").select(F.least("fp", "least").alias("u"), F.greatest("fp", "least").alias("v"))
    return pairs.union(stars).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges (u, v)``; root is the smallest node that it reaches.

    Alternating large-star and small-star steps; each round's edges are written
    to the shared folder, so the plan stays short and nothing is collected.
    """
    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: all edges point down; the smaller neighbours of u are linked to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        seen = Observation()
        after = small.union(least.select("u", F.col("m").alias("v"))).distinct().observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("sum"))
        edges = materialize(after, "edges", edges)
        now = dict(seen.get)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def near_duplicates(docs: DataFrame, words: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp, component_id)`` for every row of ``docs``; other columns are ignored.

    A null text counts as empty and an empty text has fingerprint zero, linked
    like any other. A null id never becomes a component id unless the whole
    component has none. Repeated rows are returned as often as they occur.
    """
    own = materialize(fingerprints(docs, words, id_col, text_col).withColumnRenamed(id_col, "_id"), "fingerprints")
    reps = own.groupBy("fp").agg(F.min("_id").alias("rep"))
    roots = components(links(reps.select("fp"), max_bits))
    named = reps.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = materialize(named, "classes")
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    return own.join(named.join(least, "root").select("fp", "component_id"), "fp").select(F.col("_id").alias(id_col), "fp", "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, two bits, over all documents."""
    found = near_duplicates(documents(spark, sf_dir), words=3, max_bits=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
