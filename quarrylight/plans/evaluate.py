"""Retrieval quality of the engine: each case is searched under each configuration, one after the other, as a user would."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..operators import ranking
from .engine import Engine

#: Hits that are looked at for each case.
LIMIT = 10
HITS = "query int, place int, repo string, path string, start_line int, end_line int"


def evaluate(engine: Engine, cases: DataFrame, scorers: dict[str, ranking.Scorer | None] | None = None) -> DataFrame:
    """config, cases, hit1, hit5, mrr, avg_ms and cost for each configuration, by default keywords alone.

    Cases (q, repo, mode, expect) are a file that people write.  Time is that of the search alone, in whole milliseconds.
    """
    spark, rows = engine.spark, cases.collect()
    own = spark.createDataFrame([(i,) for i in range(len(rows))], "query int")
    expected = spark.createDataFrame([(i, p) for i, r in enumerate(rows) for p in r["expect"] or ()], "query int, place string")
    out = None
    for name, scorer in (scorers or {"keyword": None}).items():
        searched = Engine(engine.files, engine.chunks, engine.symbols, engine.stem, scorer, engine.blend)
        searched.postings, searched.tokens, searched.statistics = engine.postings, engine.tokens, engine.statistics
        searched.grams, searched.blocks, searched.names = engine.grams, engine.blocks, engine.names
        hits, took, cost = [], [], 0.0
        for i, r in enumerate(rows):
            began = time.monotonic()
            found = searched.search(r["q"], r["mode"] or "auto", [r["repo"]] if r["repo"] else None, limit=LIMIT)
            hits += [(i, h["place"], h["repo"], h["path"], h["start_line"], h["end_line"]) for h in found.hits.where(F.col("place") <= LIMIT).collect()]
            took.append(int(1000 * (time.monotonic() - began)))
            cost += found.cost
        row = ranking.metrics(own, spark.createDataFrame(hits, HITS), expected)
        row = row.select(F.lit(name).alias("config"), "*", F.lit(sum(took) // max(1, len(took))).alias("avg_ms"), F.lit(cost).alias("cost"))
        out = row if out is None else out.unionByName(row)
    return out


GUIDE = f"""Which search for which question
  concept   words of a question, ranked by BM25 over definitions; add --deep for more judged hits
  symbol    the name of a definition: parseConfig, Client.Retry
  exact     text as it stands, in quotes
  regex     a pattern over lines
  auto      chooses among these by the form of the query (default)
Capitals in an exact text or a pattern make it sensitive to case.  Results show at most {C.BUDGET} bytes of excerpts;
"next" names the command that leads on, "show REPO:PATH:FROM-TO" the lines themselves.
Narrow down by --repos, --langs, --path (a glob) and --categories.
"""
