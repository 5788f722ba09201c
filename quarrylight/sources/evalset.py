"""Questions with expected places, for retrieval evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import USER, CorpusError
from ..operators.patterns import holding
from .corpus import document_files

CASE = "q string, repo string, mode string, expect array<string>"


def parse(lines: DataFrame, strict: bool = True) -> DataFrame:
    """Cases from JSON lines (column ``value``, and ``line`` for messages); empty lines and ``//`` comments are skipped."""
    own = lines.where("trim(value) <> '' and not startswith(trim(value), '//')")
    parsed = own.withColumn("c", F.from_json("value", CASE + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    if strict and "line" in lines.columns:
        bad = parsed.where("c is null or c._corrupt is not null").agg(F.min("line")).first()[0]
        if bad is not None:
            raise CorpusError(USER, f"line {bad} is no evaluation case", "each line is a JSON object with q and expect")
    return parsed.where("c is not null and c._corrupt is null").select("c.q", "c.repo", "c.mode", "c.expect")


def read(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path)
    return parse(text.withColumn("line", F.monotonically_increasing_id() + 1))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sentence of each benchmark item: item_id, q."""
    return questions(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def questions(items: DataFrame) -> DataFrame:
    """item_id, q: the first sentence of each item (item_id, text), as a user would ask for it."""
    first = F.regexp_extract("text", r"^([^.\n]*)", 1)
    return items.select("item_id", F.trim(first).alias("q")).where("q <> ''")


def expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id and each place (repo:path) whose text holds the whole item."""
    return places(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), document_files(spark, sf_dir))


def places(items: DataFrame, files: DataFrame) -> DataFrame:
    """item_id and each place (repo:path) of the files whose text holds the whole item; all items are looked for in one scan."""
    found = holding(files, items.select(F.col("item_id").alias("query"), F.col("text").alias("pattern")))
    return found.select(F.col("query").alias("item_id"), F.concat_ws(":", "repo", "path").alias("place")).distinct()
