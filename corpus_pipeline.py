"""A corpus cleaned end to end: quality rules, near duplicates, benchmark leaks, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has kept. All but the
last return the columns of documents; each result is written as Parquet and read again. Extra columns are
carried along. An empty table stays empty in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegraph.llm import op4_quality, op6_neardup, op8_bpe, op9_secrets, op10_decontaminate
from pagegraph.llm.common import drop_table, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines above the limits are cut from the others. Null and empty texts are rejected; repeated rows are judged as one document and each stays or goes."""
    return op4_quality.filtered(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that of the smallest doc_id. Of rows that share a doc_id all stay, and so do those without, and null texts."""
    gone = op6_neardup.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, with all rows of their doc_id. Null texts stay; without items all stay."""
    return op10_decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text of each row; a null text stays null."""
    return op9_secrets.masked(docs)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text, of each row; a null text is empty."""
    return op8_bpe.round_trip(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret scan", secret_scan),
    ("bpe tokens", bpe_tokens),
]

#: Several stages go beyond SQL (signatures, p-values, merges); tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        kept = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        if k:
            drop_table(docs)  # the stage before, which nothing reads any more
        docs = kept
    return docs
