"""Training-data pipeline over documents: reject toxic ones, keep one of each group of near copies, mask secrets, mix
sources to their target weights, and pack what is left into sequences.

Defined cases: a null text stays null through the filters and has no words to mix, so the mix drops it, as it does empty texts; a
null doc_id is linked with nothing and kept; of rows that repeat a doc_id the n-gram Jaccard stage keeps the one of smallest
text; a document that the mix takes more than once is as many rows; extra columns come along up to packing, which
returns pieces; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from temporis.llm import common, jaccard, mixing, packing, secrets, toxicity


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score under one half, by a machine trained on the labels outside the held-out fold."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingle similarity of 0.8 or more, the one of smallest doc_id."""
    return jaccard.keep_firsts(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, each secret in it replaced by a mark."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes; a text holds the words taken of it, repeated or cut as the quotas say."""
    return mixing.apply_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document: its sequence and place there."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("secret scans", mask_secrets),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]
#: Trained models, token ids and packing are not for SQL; tests compare stages with plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.replace(docs, stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
