"""The catalog of repositories: reading, writing and tagging."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import NOT_FOUND, USER, CorpusError

SCHEMA = (
    "name string, url string, ref string, pinned boolean, sha string, categories array<string>, added_at timestamp, updated_at timestamp"
)
VERSION = 1


def document_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of ``documents`` as repositories; categories follow from the number in their names."""
    sources = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source").distinct()
    n = F.regexp_extract("source", "([0-9]+)", 1).try_cast("int")
    kinds = F.filter(F.array(F.when(n % 2 == 0, "even"), F.when(n % 3 == 0, "third"), F.when(n % 7 == 0, "seventh")), lambda x: x.isNotNull())
    at = F.lit("2026-01-05 10:00:00").cast("timestamp")
    return sources.select(
        F.col("source").alias("name"),
        F.concat(F.lit("https://example.com/corpus/"), "source").alias("url"),
        F.lit("main").alias("ref"),
        F.coalesce(n % 5 == 0, F.lit(False)).alias("pinned"),
        F.sha1("source").alias("sha"),
        F.array_sort(kinds).alias("categories"),
        at.alias("added_at"),
        F.date_trunc("second", at + F.make_interval(hours=F.coalesce(n, F.lit(0)))).alias("updated_at"),
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """A catalog file; a missing one is an empty catalog, a broken one an error."""
    if not os.path.exists(path):
        return spark.createDataFrame([], SCHEMA)
    table = spark.read.schema(f"schema_version int, repos array<struct<{SCHEMA.replace(' ', ':').replace(',:', ',')}>>, broken string")
    rows = table.option("multiLine", "true").option("columnNameOfCorruptRecord", "broken").json(path)
    if rows.where("broken is not null or schema_version is null").count():
        raise CorpusError(USER, f"{path} is not a catalog", "restore it from a backup or delete it")
    return rows.select(F.inline("repos"))


def write(repos: DataFrame, path: str) -> None:
    """Replaces a catalog file in one step.  A catalog has a row per repository and fits the driver."""
    rows = [json.loads(r) for r in repos.orderBy("name").toJSON().collect()]
    folder = os.path.dirname(os.path.abspath(path))
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False) as f:
        json.dump({"schema_version": VERSION, "repos": rows}, f)
    os.replace(f.name, path)


def put(repos: DataFrame, changed: DataFrame) -> DataFrame:
    """``changed`` rows replace those of the same name."""
    return repos.join(changed.select("name"), "name", "left_anti").unionByName(changed)


def tag(repos: DataFrame, name: str, categories: list[str], remove: bool = False) -> DataFrame:
    """Adds categories to a repository or takes them off; categories stay sorted."""
    given = F.array(*map(F.lit, categories)).cast("array<string>")
    new = F.array_except("categories", given) if remove else F.array_union("categories", given)
    return repos.withColumn("categories", F.when(F.col("name") == name, F.array_sort(new)).otherwise(F.col("categories")))


def resolve(names: list[str], wanted: str) -> str:
    """A repository by its name, its name in other case, or the only name that holds it or is held by it."""
    low = wanted.lower()
    near = [n for n in names if low in n.lower() or n.lower() in low]
    exact = [n for n in names if n == wanted] or [n for n in names if n.lower() == low]
    if exact or len(near) == 1:
        return (exact or near)[0]
    if near:
        raise CorpusError(NOT_FOUND, f"repo {wanted!r} is ambiguous", "use one of: " + ", ".join(near))
    raise CorpusError(NOT_FOUND, f"repo {wanted!r} not found", "list the repositories or add it")
