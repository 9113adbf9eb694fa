"""A training corpus made from documents in five stages, each reading what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from annalist.llm.common import settle, table
from annalist.llm.jaccard import keep_one
from annalist.llm.mixing import mix_documents
from annalist.llm.packing import pack
from annalist.llm.quality import filter_quality
from annalist.llm.secrets import redact_secrets


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules keep."""
    return filter_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by five-word shingles at a similarity of 0.8."""
    return keep_one(docs, words=5, percent=80)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets found in their texts redacted."""
    return redact_secrets(docs)


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their fitted rates say: toxic ones go, low ones are thinned, good ones stay."""
    return mix_documents(docs, table(spark, sf_dir, "labels"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids with their sequences and offsets."""
    return pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram jaccard join", near_duplicates),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", target_mix),
    ("packing", packing),
]

#: Secrets in nested encodings, the fitted mix and byte-pair ids aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs, f"stage-{k}")
    return docs
