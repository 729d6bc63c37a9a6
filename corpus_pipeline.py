"""From ``documents`` to packed training batches: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limewash.catalog.registry import query
from limewash.llm import decontamination, minhash, packing, suffixes, toxicity
from limewash.llm.common import documents
from limewash.session import materialise, release, scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled ones that are not held out."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, documents(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the least id stays."""
    return minhash.drop_near_duplicates(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes or more that stand earlier go; every document stays, if only as an empty text."""
    return suffixes.drop_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share too much with a benchmark go."""
    return decontamination.decontaminate(docs, documents(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents left, in length buckets and batches."""
    return packing.pack(docs, "doc_id", packing.word_count(F.col("text")))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash", drop_near_duplicates),
    ("suffixes", drop_repeated_passages),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: A classifier, connected components and an optimal choice of buckets are not for SQL; the stages are
#: tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in their order; what a stage stores beside its result is removed as soon as that is written."""
    docs, written = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = materialise(stage(spark, docs, sf_dir), name, keep=True)
        if written is not None:
            release(written)
        written = docs
    return STAGES[-1][1](spark, docs, sf_dir)


query("pipeline", ORACLE_SQL)(run)
