"""From raw documents to token ids in five stages, each over all that the one before kept.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)``
and returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathework.llm import bpe, langid, linedup, mixing, near_sets
from lathework.session import materialize

#: Documents whose best language is less likely than this are rejected.
MIN_LANGUAGE_SCORE = 0.3
#: Near-duplicates are alike in their sets of five-word shingles: 0.8 or more.
NEAR_WORDS, NEAR_SIMILARITY = 5, near_sets.SIMILARITY


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay; a null ``lang`` is filled with the prediction.

    Null texts, texts without letters and uncertain ones go. Without any
    labelled row nothing can be told apart, and all texts with letters stay.
    """
    model = langid.train(docs.where(~langid.held_out()))
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("_rest"), "text")
    found = langid.identify(rows, model, keep=["_rest", "text"], names=("_lang", "_sure"))
    sure = (F.col("_sure") >= MIN_LANGUAGE_SCORE) & (F.col("_lang") != langid.UNKNOWN) if model.classes else F.regexp_count("text", F.lit(r"\p{L}")) > 0
    own = {"text": F.col("text"), "lang": F.coalesce("_rest.lang", F.nullif(F.col("_lang"), F.lit(langid.UNKNOWN))).alias("lang")}
    return found.where(sure).select(*[own[c] if c in own else F.col(f"_rest.`{c}`").alias(c) for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that spread over many sources are taken out of the texts; ``n_chars`` follows."""
    others = [c for c in docs.columns if c not in ("text", "source", "n_chars")]
    found = linedup.remove_boilerplate(docs.select("text", "source", F.struct(*[F.col(f"`{c}`") for c in others]).alias("_rest")))
    own = {"text": F.col("text"), "source": F.col("source"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")}
    return found.select(*[own[c] if c in own else F.col(f"_rest.`{c}`").alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    found = near_sets.near_duplicates(docs, NEAR_WORDS, NEAR_SIMILARITY)
    return near_sets.keep_one(docs, found)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice. Texts stay where they are."""
    return mixing.apply_plan(docs, mixing.plan(docs.select("doc_id", "text", "source")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids``, and the SHA-256 of what the ids decode to."""
    return bpe.encode_documents(docs, hash_decoded=True)


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("mixing to target weights", mixture),
    ("byte-level BPE", tokens),
]

#: Language ID and SimHash can't be said in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, "stage")
    return docs
