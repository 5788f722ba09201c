"""Keeps a search index up to date with a growing folder of documents.

    python jobs/refresh_index.py jobs/refresh_index.json [--documents PATH] [--output PATH] [--checkpoint PATH]

Input: Parquet files with the columns of ``documents`` (doc_id, text, lang, source).  A later file may bring a document
again: its text replaces the one before, a null text removes it.  Later is by the file's time of modification.

The stream's checkpoint knows which files have been read, so a run takes only new ones and a run without new ones writes
nothing.  Each micro-batch becomes a segment of the index (``quarrylight.streaming.segments``): its files, chunks, symbols
and postings, partitioned by segment.  A run that was cut off repeats its last batch into the same partitions.
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

from quarrylight.sources import corpus  # noqa: E402
from quarrylight.streaming.segments import Segments, refresh  # noqa: E402

log = logging.getLogger("refresh_index")

DOCUMENTS = "doc_id bigint, text string, lang string, source string"


def described(docs: DataFrame) -> DataFrame:
    """Documents as files with a version; the file they came in says when that was."""
    version = F.unix_millis(F.col("_metadata.file_modification_time")).alias("version")
    return corpus.as_files(docs.select("doc_id", "text", "lang", "source", version), "version")


def segments_of(spark: SparkSession, output: str, lines_per_chunk: int, stem: bool) -> Segments:
    return Segments(spark, output, lambda files: (corpus.window_chunks(files, lines_per_chunk, True), corpus.line_symbols(files)), stem)


def run(
    spark: SparkSession, documents: str, output: str, checkpoint: str, lines_per_chunk: int = 8, stem: bool = True, files_per_batch: int = 100, merge: bool = True
) -> Segments:
    """Brings the index at ``output`` up to date and returns it."""
    segments = segments_of(spark, output, lines_per_chunk, stem)
    stream = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", files_per_batch).parquet(documents)
    query = refresh(described(stream), segments, checkpoint)
    query.awaitTermination()
    read = sum(p["numInputRows"] for p in query.recentProgress)
    log.info("%s: read %d new rows in %d batches", documents, read, sum(1 for p in query.recentProgress if p["numInputRows"]))
    if merge and (merged := segments.merge()):
        log.info("%s: merged segments %s", output, merged)
    for name in ("files", "chunks", "symbols", "postings"):
        rows = segments.stored(name).groupBy("segment").count().orderBy("segment").collect()
        log.info("%s/%s: %s", output, name, ", ".join(f"segment {r['segment']}: {r['count']} rows" for r in rows) or "empty")
    return segments


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Keeps a search index up to date with a growing folder of documents.")
    parser.add_argument("config", help="JSON file, see refresh_index.json")
    for name in ("documents", "output", "checkpoint"):
        parser.add_argument(f"--{name}", help="instead of the config's")
    given = parser.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("refresh_index").getOrCreate()
    try:
        config = json.loads("\n".join(r[0] for r in spark.read.text(given.config).collect()))
        config |= {k: v for k in ("documents", "output", "checkpoint") if (v := getattr(given, k))}
        run(spark, **config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
