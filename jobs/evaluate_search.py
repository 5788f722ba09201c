"""Measures how well searches answer a table of questions, under several configurations at once.

    python jobs/evaluate_search.py jobs/evaluate_search.json [--documents PATH] [--benchmark PATH] [--output PATH]

Input: Parquet files with the columns of ``documents`` (doc_id, text, lang, source) and of ``benchmark`` (item_id, text).
An item's first sentence is its question; the documents that hold the whole item are the right answers.

A configuration has a name, a mode (``concept``: words ranked by BM25 and heuristics; ``exact``: the question as a fixed text),
``lines_per_chunk``, ``per_file`` (hits of a file that count; concept only), ``stem`` and ``limit``.  All questions are searched
as one batch: nothing is done once for each question.  Output, partitioned by configuration:

* ``answers``: query, place, repo, path, start_line, score, right (whether the document is a right answer)
* ``metrics``: cases, hit1, hit5, mrr over the items that a document answers

``_staged`` below it holds what the last run's shortlists were made from.

A run replaces the partitions of its configurations and leaves others as they are, so it can be run again.
"""

from __future__ import annotations

import argparse
import json
import logging
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from quarrylight.functions import constants as C  # noqa: E402
from quarrylight.functions import paths, text  # noqa: E402
from quarrylight.functions.sizes import broadcast_if_small  # noqa: E402
from quarrylight.operators import batch, index, patterns, ranking  # noqa: E402
from quarrylight.sources import corpus, evalset  # noqa: E402

log = logging.getLogger("evaluate_search")

#: Hits that are looked at for each question.
LIMIT = 10
MODES = ("concept", "exact")
ANSWERS = "query bigint, repo string, path string, place int, start_line bigint, score double, right boolean, configuration string"
CONFIGURATIONS = json.loads((Path(__file__).resolve().parent / "evaluate_search.json").read_text())["configurations"]


def shortlist(chunks: DataFrame, asked: DataFrame, stem: bool, staged: str) -> DataFrame:
    """query, repo, path, start_line, bm25 of the shortlist of each question (query, terms), stored at ``staged``."""
    terms = asked.select("query", F.explode("terms").alias("term"))
    if stem:
        stems = index.stems(terms.select(F.col("term").alias("word")))
        terms = terms.withColumnRenamed("term", "word").join(stems, "word").select("query", "term")
    batch.best(chunks, terms, C.SHORTLIST, f"{staged}/rows", stem).write.mode("overwrite").parquet(f"{staged}/shortlist")
    return chunks.sparkSession.read.parquet(f"{staged}/shortlist")


def concept(files: DataFrame, shortlisted: DataFrame, asked: DataFrame, per_file: int) -> DataFrame:
    """query, repo, path, start_line, score, flags of what is shortlisted for each question."""
    own = broadcast_if_small(shortlisted).join(files.select("repo", "path", "flags"), ["repo", "path"]).withColumns({"symbol": F.lit(""), "kind": F.lit("block")})
    return ranking.cap_per_file(ranking.concept_score(own, asked), per_file)


def exact(files: DataFrame, chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """The same of the chunks that hold a question as it stands."""
    groups = patterns.groups_of_many(patterns.grep_many(files, asked.select("query", F.col("q").alias("pattern"))), chunks)
    own = groups.join(files.select("repo", "path", "flags"), ["repo", "path"])
    return own.withColumn("score", (1 + F.log(1 + F.col("n").cast("double"))) * paths.penalty(F.col("flags"), ""))


def run(spark: SparkSession, documents: str, benchmark: str, output: str, configurations: list[dict] | None = None) -> DataFrame:
    """Writes answers and metrics of the configurations and returns all metrics that stand at ``output``."""
    configurations = CONFIGURATIONS if configurations is None else configurations
    if wrong := [c for c in configurations if c["mode"] not in MODES]:
        raise ValueError(f"mode {wrong[0]['mode']!r} is none of {', '.join(MODES)}")
    files = corpus.as_files(spark.read.parquet(documents))
    items = spark.read.parquet(benchmark)
    write(evalset.places(items, files), f"{output}/expected")
    expected = spark.read.parquet(f"{output}/expected")
    asked = evalset.questions(items).select(F.col("item_id").alias("query"), "q", text.words(F.col("q")).alias("terms"))
    log.info("%s: %d questions; %s: %d documents; %d right answers", benchmark, asked.count(), documents, files.count(), expected.count())
    with_words, shortlists = asked.where(F.size("terms") > 0), {}
    for c in configurations:
        window, stem = c.get("lines_per_chunk", C.WINDOW), c.get("stem", False)
        chunks = corpus.window_chunks(files, window, True)
        if c["mode"] == "concept":
            # configurations with the same chunks and words share a shortlist
            if (window, stem) not in shortlists:
                shortlists[window, stem] = shortlist(chunks, with_words, stem, f"{output}/_staged/{window}-{stem}")
            hits = concept(files, shortlists[window, stem], with_words, c.get("per_file", C.PER_FILE))
        else:
            hits = exact(files, chunks, asked)
        hits = ranking.top(hits, c.get("limit", LIMIT)).select("query", "place", "repo", "path", F.col("start_line").cast("bigint"), F.round("score", 9).alias("score"))
        right = expected.select(F.col("item_id").alias("query"), F.split_part("place", F.lit(":"), F.lit(1)).alias("repo"), F.split_part("place", F.lit(":"), F.lit(2)).alias("path"))
        right = right.withColumn("right", F.lit(True))
        hits = hits.join(right, ["query", "repo", "path"], "left").withColumn("right", F.coalesce("right", F.lit(False)))
        write(hits.withColumn("configuration", F.lit(c["name"])), f"{output}/answers", "configuration")
        found = spark.read.schema(ANSWERS).parquet(f"{output}/answers").where(F.col("configuration") == c["name"])
        ranks = found.where("right").groupBy("query").agg(F.min("place").alias("rank"))
        own = expected.select(F.col("item_id").alias("query")).distinct().join(ranks, "query", "left").agg(
            F.count(F.lit(1)).alias("cases"),
            *(F.round(F.avg(F.coalesce(x, F.lit(0.0))), 9).alias(n) for n, x in (("hit1", (F.col("rank") <= 1).cast("double")), ("hit5", (F.col("rank") <= 5).cast("double")), ("mrr", 1 / F.col("rank")))),
        )
        write(own.withColumn("configuration", F.lit(c["name"])), f"{output}/metrics", "configuration")
        log.info("%s: %s: %d answers written", output, c["name"], found.count())
    metrics = spark.read.parquet(f"{output}/metrics")
    for row in metrics.orderBy("configuration").collect():
        log.info("%s", row.asDict())
    return metrics


def write(rows: DataFrame, path: str, *by: str) -> None:
    """Replaces a table, or the partitions that the rows are in."""
    out = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (out.partitionBy(*by) if by else out).parquet(path)


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Measures how well searches answer a table of questions.")
    parser.add_argument("config", help="JSON file, see evaluate_search.json")
    for name in ("documents", "benchmark", "output"):
        parser.add_argument(f"--{name}", help="instead of the config's")
    given = parser.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("evaluate_search").getOrCreate()
    try:
        config = json.loads("\n".join(r[0] for r in spark.read.text(given.config).collect()))
        config |= {k: v for k in ("documents", "benchmark", "output") if (v := getattr(given, k))}
        run(spark, **config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
