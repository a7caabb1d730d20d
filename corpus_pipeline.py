"""A corpus pipeline of five stages, each one of the training-data operators.

Language identification drops documents without an identified language; line
dedup drops recurring log-template lines; near-dedup keeps one document of each
group linked by 5-word Jaccard similarity of 0.8 or more; mixing repeats or thins sources towards their targets; best-fit
packing lays what remains out in bins. Each stage works on all that the one
before kept, is written as Parquet and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lakeweave.llm import language_id, line_dedup, mixing, packing, simhash_dedup
from lakeweave.llm.common import ensure_checkpoint_dir, read_table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; null texts, texts without a letter and texts that no mixture fits go."""
    return language_id.keep_identified(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their recurring lines of any length (long ones from two documents on), n_chars brought up to date; one that so loses its last word goes."""
    return line_dedup.keep_cleaned(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: SimHashes linked by vantage-point trees, decided and completed by exact Jaccard similarity."""
    return simhash_dedup.keep_one_by_jaccard(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's repetition rate says."""
    return mixing.mix(docs)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their bins and places."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", dedup_documents),
    ("mixing", mix_sources),
    ("packing", pack_bins),
]

#: SQL can express neither mixture inference nor the packing; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared checkpoint folder and read again.

    A stage's table is removed once the next one is written, the last one's when the process ends.
    """
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.deleteOnExit(path(folder))
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            files.delete(path(f"{folder}/{before}"), True)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
