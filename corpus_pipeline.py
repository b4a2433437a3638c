"""The corpus pipeline: quality rules, exact dedup, near-dedup, secret redaction, packing.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and reread as
the next one's docs. All but the last return the columns of documents. No table but docs is read.

Defined results of every stage: an empty table gives an empty table; extra columns, whatever their names, are kept by
all stages but the last; rows are told apart by their place, not by their id, so repeated and null ids are harmless.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verdictflow.llm import common, exact, packing, quality, secrets, simhash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; failing lines of the others go. Null and empty texts have no words and are rejected;
    equal rows are judged alike; texts are judged whole, however long."""
    return quality.clean(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the row with the largest doc_id stays, of rows that share it one; a null id
    is less than any other; a null text equals an empty one."""
    return exact.deduplicate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the least doc_id stays, of rows that share it the
    first; a null id is larger than any other; texts without words are one group."""
    return simhash.deduplicate(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked, but for widely copied examples; every document stays, null and empty texts as they are."""
    return secrets.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece with its token ids (little-endian 32-bit) and place; a null or empty text is one piece with
    the end token alone."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", near_dedup),
    ("secret_scans", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Fingerprints and tokens have no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
