"""From raw documents to a training mix: the stages, and all of them in turn."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.llm import decontaminate, mixing, near_dedup, pii, quality
from tripleloom.llm.common import crc_bucket, drop, shared_dir, table

#: Five-word shingles and a similarity of 0.8, repetitions hashed anew for each model of language: no SQL expresses the classifier or the sanitisation.
ORACLE_SQL = None


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble doesn't reject, learnt from the labels outside of the held-out fold.

    A null text counts as the empty one; without labels all documents stay.
    """
    labels = table(spark, sf_dir, "labels").filter(crc_bucket(F.col("doc_id"), 5) != 0)
    return quality.keep_good(docs, quality.fit(docs, labels))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least id; those without text or without id all stay."""
    return near_dedup.keep_one_of_each(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; those without an id stay, an empty benchmark drops none."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data generalised and ``n_chars`` set anew; a null text stays null."""
    return pii.sanitise(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of the documents, each source to the same share, in a random order; the null source is one of them."""
    return mixing.mix_sources(docs)


STAGES = [
    ("quality_classifier", quality_filter),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontaminate_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each but the last is written and read again.

    What a stage was given is deleted once its result is written.  Null and
    empty texts go or stay as the classifier scores the empty text, and pass all
    other stages.  Rows that repeat a text, or an id, become one.  Very long
    texts are read whole.  Other columns ride along, whatever their names, but
    for ``copy`` and ``shuffle_key``, which the last stage sets.  No documents
    give no rows.
    """
    docs, path = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        given, path = path, f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if given:
            drop(spark, given)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
