"""The corpus pipeline: documents in, a deduplicated, clean, mixed and tokenized corpus out.

Each stage gets what the one before it wrote as Parquet and returns the rows that it keeps; all but
the last return the columns of documents.  The last adds n_pieces and pieces.

A null text counts as empty and is rejected by the quality rules; an empty table passes through all
stages as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from petrograph.llm import mixing, neardup, pieces, quality, secret_scan
from petrograph.llm.common import discard, documents, read_table, saved


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or the likelihood ratio go."""
    return quality.kept_documents(docs, read_table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each near-duplicate group stays."""
    return neardup.deduplicated(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret in a text is replaced by a mask."""
    return secret_scan.redacted(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that each source has its target of words."""
    return mixing.mixture(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids are added to each row."""
    return pieces.encoded(docs)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("secret_scans", secret_scans),
          ("source_mix", source_mix), ("tokens", tokens)]

#: MinHash components, hashed n-gram ratios and BPE have no SQL form; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        after = saved(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        docs = before = after
    return docs
