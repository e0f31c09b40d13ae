"""A cleaning pipeline over documents: quality, near duplicates, decontamination, PII, encoding.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and returns a
DataFrame; all but the last return the columns of docs. They take null and empty texts, repeated rows,
empty tables and further columns as the operators they call do.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cadenza.llm import common, decontaminate, pii, piece_codec, quality, shingle_join


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.kept(docs, common.table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group linked by 5-word shingles at 0.8.

    Of rows with that doc_id and text all stay; rows without a doc_id stay.
    """
    return shingle_join.distinct(docs, 5, 80, 100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the benchmark's passages."""
    return decontaminate.cleaned(docs, common.table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked."""
    return pii.masked(docs)


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id with the text's token count and the digests of its ids and of the decoded text."""
    return piece_codec.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), ["n_tokens", "ids_sha256", "decoded_sha256"])


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("piece encoding", piece_encoding),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.saved(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
