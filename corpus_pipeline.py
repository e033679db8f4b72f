"""The corpus pipeline: stages over ``documents``, each written and read again before the next.

Rows: columns other than those of ``documents`` go; null ids, languages, sources and counts stay null;
repeated rows are one group of copies, of which one stays; empty tables give empty tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnrank.llm import common

#: Columns of ``documents`` that every stage but the last returns.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised; null text and text without a letter go.

    A document's own label is kept; a missing one is filled with the predicted language. With no
    label to learn from, no document is recognised and all go.
    """
    from tarnrank.llm import language_id as op

    prototypes = op.learn(docs.where(~op.held_out()))
    found = op.predict(docs.select(*COLUMNS), prototypes, keep_text=True)
    return found.where(F.col("lang_pred") != op.UND).select("doc_id", "text", F.coalesce("lang", "lang_pred").alias("lang"), "source", "n_chars")


def _version():
    """The hash that tells apart rows of one id, as the operators take it."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies one row, of the smallest id (null ids only where there is no other).

    Of several texts with that id in a group, the one with the least hash stays.
    """
    from tarnrank.llm import simhash as op

    docs = docs.select(*COLUMNS)
    found = common.materialize(op.near_duplicates(docs))
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min(F.struct("doc_id", "version")).alias("kept"))
    first = first.select(F.col("kept.doc_id").alias("kept_id"), F.col("kept.version").alias("kept_version"))
    out = docs.join(first, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (_version() == F.col("kept_version")), "left_semi")
    repeated = found.groupBy("doc_id", "version").agg(F.count("*").alias("n")).where("n > 1")
    # texts are only shuffled once more if rows repeat as a whole
    return out.dropDuplicates(["doc_id", "text"]) if repeated.limit(1).count() else out


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents: those with benchmark passages in a twentieth of their words or more. Without benchmark items none go."""
    from tarnrank.llm import decontamination as op

    docs = docs.select(*COLUMNS)
    found = op.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = common.materialize(found.where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("version").alias("bad_version")).distinct())
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("bad_id")) & (_version() == F.col("bad_version")), "left_anti")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark; all documents stay, and n_chars follows the text.

    All texts are scanned, each distinct one once; where the session names a kept ledger (``secret_scan.SETTING``), new texts only.
    """
    from tarnrank.llm import secret_scan as op

    return op.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the hashes of ids and of the bytes they decode to.

    Workers keep less than the operator's default, as the earlier stages' memory is still held.
    """
    import public_tokenizers

    from tarnrank.llm import byte_bpe as op

    return op.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True, cached=50_000, steps=150_000)


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_copies),
    ("benchmark decontamination", decontaminate),
    ("secret scans", secrets),
    ("byte-level BPE encoding and decoding", encode),
]
#: Model-based and iterative stages have no SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``."""
    docs = common.documents(spark, sf_dir)
    base = f"{common.work_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = common.materialize(stage(spark, docs, sf_dir), f"{base}/{k}")
    return docs
