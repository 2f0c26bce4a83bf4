"""From raw documents to packed training sequences, in stages.

Every stage works on all that the one before it kept, is written as Parquet and
read again; all but the last return the columns of documents.  Null and empty texts,
repeated rows, ties, very long texts and an empty table are handled as the operators'
docstrings say: an empty text is scored, deduplicated, kept and packed like any other.
Extra columns, whatever their names, go through to the last stage, which drops them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.llm import common, decontaminate, near_dup, packing, quality, secrets
from ledgerleaf.llm.tokens import vocabulary


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more."""
    model = quality.fit(docs, common.table(spark, sf_dir, "labels"))
    return docs.where(quality.scores(spark, model, common.text_of("text")) >= 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_dup.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminate.without_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mask; n_chars follows the text."""
    return secrets.redact(docs, vocabulary_path=vocabulary("word_bpe_49k.json")).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), documents=packing.DOCUMENTS)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: Trained scores, minimum-hash signatures and byte-pair tokens are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`."""
    docs = common.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.stored(docs, f"stage-{name}")
    return docs
