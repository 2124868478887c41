"""The corpus pipeline: stages applied one after another to documents.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept.  All but the last return the columns of documents.  ``run`` writes every
stage's result to the shared folder and reads it back for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rubato.llm import byte_bpe, mixing, near_copies, quality_classifier, quality_rules, simhash
from rubato.llm.common import materialise, table


#: Bytes of rows that go to a Python worker at a time.  By Spark's default of 64 MB, each of an executor's tasks holds such
#: a batch in the JVM, doubled as it grows, and again in Python.
BATCH_BYTES = "4m"


def in_small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in batches of ``BATCH_BYTES``, from here on in this session, as results are lazy."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the certified quality rules reject go."""
    in_small_batches(spark)
    return quality_rules.accepted_documents(docs, table(spark, sf_dir, "labels"))


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 go.

    The model is fitted on labelled rows of the whole documents table: what the
    rules left over holds too few bad documents to learn from.
    """
    in_small_batches(spark)
    model = quality_classifier.fit_on(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_classifier.accepted_documents(docs, model)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one of the smallest doc_id.

    Near are texts whose sets of 5-word shingles have Jaccard similarity 0.8 or
    more; op10's setting (3 words, 3 bits) binds that query alone.
    """
    in_small_batches(spark)
    return simhash.one_of_each_group(docs, near_copies.set_prints, near_copies.set_links)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or repeated so that sources come near their targets."""
    return mixing.mixed_rows(docs)


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become token ids; digests of the ids and of the decoded bytes go along."""
    in_small_batches(spark)
    return byte_bpe.encoded_digests(docs, with_ids=True)


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", byte_bpe_stage),
]

#: Learned models, near-duplicate components and BPE are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
