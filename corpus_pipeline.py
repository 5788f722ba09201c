"""The corpus pipeline: five stages, each applied to all that the stage before it kept.

Defined results: null texts count as empty and are judged like any other; of rows that repeat id and
text one stays; rows of one id are accepted by the classifier if any of them is; a null id is an id in
exact dedup and linked with nothing in near-dedup; a null source is a source like any other.  All
columns of the documents pass, whatever their names, but for one named ``ids``, which the last stage
replaces.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrylight.llm import exact_dedup, mixing, near_dedup, pieces, quality
from quarrylight.llm.scratch import Scratch


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it learns from the labels of those that are there."""
    return quality.drop_rejected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return exact_dedup.keep_one_of_each(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, a similarity of 0.8 or more) the smallest id stays."""
    return near_dedup.keep_one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are replicated to equal weights, as many rows as there were; a document may come several times."""
    return mixing.mix_sources(docs, copy_col=None)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the ids of each text."""
    return pieces.encode(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources", mix),
    ("SentencePiece encoding", encode),
]

#: The classifier, near-dedup and encoding are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again by the next; what a stage wrote on its way goes when it is done."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        before = len(Scratch.made())
        docs = scratch.keep(f"stage-{i}", stage(spark, docs, sf_dir))
        Scratch.drop_since(before)
        if i:
            scratch.drop(f"stage-{i - 1}")
    return docs
