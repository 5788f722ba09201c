"""Postings in blocks with their greatest contribution, so that one question reads only blocks that can reach its shortlist.

Chunks are numbered in order of place, and WIDTH consecutive numbers are a range of chunks.  Tables below a folder:

* ``blocks``: term, block (which range), n, best, rows (number, tf, dl): the postings of a term in a range, sorted by term and block.
  ``best`` is the greatest contribution of one of them to a score, but for the term's weight
* ``terms``: term, n: in how many chunks it is, sorted by term
* ``places``: what is known of each chunk but its body, with language and flags of its file, sorted by number

Ranges are the same for all terms, so what a chunk of a range can score at most is the sum of the bests of the terms there.
The ranges with the greatest bounds are scored first; their k-th best score is a threshold, and of the other ranges only those
whose bound reaches it are scored, too.  The result is that of scoring everything, ties included.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from .index import CHUNK

#: Chunks of a range.
WIDTH = 128
#: Ranges that are scored before there is a threshold.
FIRST = 128
#: Ranges whose numbers the driver holds; where more of them reach the threshold, they are found by a join.
LISTED = 2048
#: Scores are equal where they are so to nine digits, so a bound may be short of the threshold by as much.
_SLACK = 1e-8


def within(column: str, values: list[int]) -> Column:
    """``isin`` in groups of ten, each of which Parquet's readers compare with the bounds of row groups (of longer lists only the ends)."""
    own = sorted(values)
    tens = [f"{column} IN ({', '.join(map(str, own[i : i + 10]))})" for i in range(0, len(own), 10)]
    return F.expr(" OR ".join(tens) or "false")


def numbered(chunks: DataFrame) -> DataFrame:
    """Chunks in order of place with ``number``, which grows in that order; to be written before it is used."""
    return chunks.repartitionByRange(*CHUNK).sortWithinPartitions(*CHUNK).withColumn("number", F.monotonically_increasing_id())


def _contribution(tf: Column, dl: Column, avgdl: float) -> Column:
    return tf * (C.K1 + 1) / (tf + C.K1 * (1 - C.B + C.B * dl / avgdl))


def write(postings: DataFrame, chunks: DataFrame, files: DataFrame, statistics: DataFrame, folder: str, width: int = WIDTH) -> None:
    """From stored tables: postings (term, tf, dl, number), numbered chunks, their files, and the statistics of the index."""
    total = statistics.first()
    avgdl = max(total["n_tokens"], 1) / max(total["n_docs"], 1)
    own = postings.select("term", F.floor(F.col("number") / width).cast("bigint").alias("block"), "number", "tf", "dl")
    # the ranges hold all postings of a term and a block, so these meet without another exchange
    rows = own.repartitionByRange("term", "block").groupBy("term", "block").agg(
        F.count(F.lit(1)).alias("n"), F.max(_contribution(F.col("tf"), F.col("dl"), avgdl)).alias("best"), F.collect_list(F.struct("number", "tf", "dl")).alias("rows")
    )
    rows.sortWithinPartitions("term", "block").write.mode("overwrite").parquet(f"{folder}/blocks")
    stored = postings.sparkSession.read.parquet(f"{folder}/blocks")
    counts = stored.groupBy("term").agg(F.sum("n").alias("n"))
    counts.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/terms")
    known = files.select("repo", "path", "lang", "flags")
    own = chunks.select("number", *CHUNK, "end_line", "symbol", "kind").join(known, ["repo", "path"], "left")
    own.repartitionByRange("number").sortWithinPartitions("number").write.mode("overwrite").parquet(f"{folder}/places")


class Blocks:
    def __init__(self, spark: SparkSession, folder: str, statistics: DataFrame):
        self.spark = spark
        self.blocks, self.terms, self.places = (spark.read.parquet(f"{folder}/{t}") for t in ("blocks", "terms", "places"))
        total = statistics.first()
        self.n_docs, self.avgdl = total["n_docs"], max(total["n_tokens"], 1) / max(total["n_docs"], 1)
        #: Of the last question: ranges that hold one of its terms (as far as they were listed), and those that were scored.
        self.looked_at = (0, 0)

    def _weights(self, terms: list[str]) -> dict[str, float]:
        """The weight of each term that is there, as often as it is asked for."""
        found = self.terms.where(F.col("term").isin(sorted(set(terms)))).collect()  # as many rows as the question has terms
        idf = {r["term"]: math.log((self.n_docs - r["n"] + 0.5) / (r["n"] + 0.5)) for r in found}
        return {t: (v if v > 0 else C.LEAST_IDF) * terms.count(t) for t, v in idf.items()}

    def _scored(self, rows: DataFrame, weight: Column, k: int) -> list[tuple[int, float]]:
        """The k best chunks of some blocks: (number, score)."""
        own = rows.select(weight.alias("weight"), F.explode("rows").alias("r")).select("weight", "r.*")
        scores = own.groupBy("number").agg(F.sum(F.col("weight") * _contribution(F.col("tf"), F.col("dl"), self.avgdl)).alias("bm25"))
        return [tuple(r) for r in scores.orderBy(F.desc(F.round("bm25", 9)), "number").limit(k).collect()]

    def best(self, terms: list[str], k: int = C.SHORTLIST, first: int = FIRST, listed: int = LISTED) -> list[tuple[int, float]]:
        """The k chunks with the greatest scores for the terms (each an index term): (number, score), the best first."""
        weights = self._weights(terms)
        if not weights:
            return []
        weight = F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("term"))
        own = self.blocks.where(F.col("term").isin(sorted(weights)))
        bounds = own.groupBy("block").agg(F.sum(weight * F.col("best")).alias("bound"))
        tops = bounds.orderBy(F.desc("bound"), "block").limit(listed).collect()
        now = [r["block"] for r in tops[:first]]
        everything = len(tops) <= first
        out = self._scored(own if everything else own.where(within("block", now)), weight, k)
        least = out[-1][1] - _SLACK if len(out) == k else -math.inf
        more = [r["block"] for r in tops[first:] if r["bound"] >= least]
        self.looked_at = (len(tops), len(now) + len(more))
        if len(tops) == listed and tops[-1]["bound"] >= least:
            others = bounds.where(F.col("bound") >= least).select("block").where(~F.col("block").isin(now))
            more_rows = own.join(others, "block", "left_semi")
        elif more:
            more_rows = own.where(within("block", more))
        else:
            return out
        return sorted(out + self._scored(more_rows, weight, k), key=lambda x: (-round(x[1], 9), x[0]))[:k]

    def described(self, listed: list[tuple[int, float]]) -> DataFrame:
        """query (0), bm25 and what is known of the chunks of a shortlist, which only they are read for; all in one partition."""
        number, score = ([x[i] for x in listed] for i in (0, 1))
        scores = self.spark.createDataFrame(pa.table({"number": pa.array(number, pa.int64()), "bm25": pa.array(score, pa.float64())}))
        own = self.places.where(within("number", number)).join(F.broadcast(scores), "number")
        return own.select(F.lit(0).alias("query"), "bm25", *CHUNK, "end_line", "symbol", "kind", "lang", "flags").coalesce(1)
