"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

A source with target weight w and n rows is to give w / sum(weights) * total rows, so each of its
rows is drawn with rate ``target / n``.  A row's count is the inverse of the Poisson distribution
with that rate at a number in [0, 1) hashed from the seed and the row's id: the same rows, seed and
weights give the same mixture whatever the partitioning, and no row waits for another.  Rows are
exploded by their count and dealt out and sorted by a hash of seed, id and copy.

Only counts per source are aggregated.  Rates above ``LARGEST_RATE`` are drawn as a sum of several
draws, so the table of a source's distribution stays below a few hundred numbers.

Defined results
---------------
* A null source is a source like any other.  Sources without a weight, or with one that is null,
  zero or negative, give no rows; weights of a source that is listed twice add up.  Without weights
  each source in the table gets the same weight.
* Rows with the same id and source draw the same count; null ids draw as the text ``null``.
* ``copy`` (or what ``copy_col`` names) runs from 1; a column of that name in the input is replaced.  All other columns pass, whatever their names.
* An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

LARGEST_RATE = 64.0
#: Rates of so many sources are broadcast, at most some 30 MB; beyond it Spark sorts and merges.
BROADCAST_SOURCES = 10_000


def _uniform(*parts: str) -> str:
    """SQL for a number in [0, 1) with 52 bits of the MD5 of the parts, joined by colons."""
    return f"(cast(conv(substr(md5(concat_ws(':', {', '.join(parts)})), 1, 13), 16, 10) as double) / 4503599627370496D)"


def source_rates(docs: DataFrame, source_col: str, weights: DataFrame | None, total: float | None) -> DataFrame:
    """__source, __draws (how many numbers a row draws) and __cdf (of one draw), for each source with a weight."""
    counts = docs.groupBy(F.col(f"`{source_col}`").alias("__source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weighted = counts.withColumn("weight", F.lit(1.0))
    else:
        w = weights.select(F.col("source").alias("__w"), F.col("weight").cast("double").alias("weight")).where("weight > 0")
        w = w.groupBy("__w").agg(F.sum("weight").alias("weight"))
        weighted = counts.join(w, F.col("__source").eqNullSafe(F.col("__w"))).drop("__w")
    sums = weighted.agg(F.sum("weight").alias("weights")).crossJoin(counts.agg(F.sum("n").alias("rows")))  # one row
    whole = "rows" if total is None else f"{float(total)}D"
    return (
        weighted.crossJoin(F.broadcast(sums))
        .withColumn("rate", F.expr(f"weight / weights * {whole} / n"))
        .withColumn("draws", F.expr(f"cast(greatest(1, ceil(rate / {LARGEST_RATE}D)) as int)"))
        .withColumn("__r", F.expr("rate / draws"))
        .withColumn(
            "cdf",
            F.expr(
                "aggregate(sequence(1, cast(ceil(__r + 12 * sqrt(__r) + 30) as int)),"
                " named_struct('p', exp(-__r), 'c', exp(-__r), 'a', array(exp(-__r))),"
                " (s, k) -> named_struct('p', s.p * __r / k, 'c', s.c + s.p * __r / k, 'a', array_append(s.a, s.c + s.p * __r / k)),"
                " s -> s.a)"
            ),
        )
        .select("__source", F.col("draws").alias("__draws"), F.col("cdf").alias("__cdf"))
    )


def mix_sources(
    docs: DataFrame,
    weights: DataFrame | None = None,
    total: float | None = None,
    seed: int = 42,
    id_col: str = "doc_id",
    source_col: str = "source",
    copy_col: str | None = "copy",
) -> DataFrame:
    """The mixture: all columns of ``docs`` and, if it has a name, the number of the copy.

    ``total`` is the number of rows aimed at, by default the input's.
    """
    rates = Scratch(docs.sparkSession, "mix").keep("rates", source_rates(docs, source_col, weights, total))
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    drawn = _uniform(f"'{seed}'", "ident", "cast(i as string)")
    # documents travel as one column, so their names can't clash with those used here
    kept = [c for c in docs.columns if c != copy_col]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"),
        F.col(f"`{source_col}`").alias("source"),
        F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")).alias("ident"),
    )
    drawn_rows = rows.join(rates, F.col("source").eqNullSafe(F.col("__source"))).select(
        "row", "ident", F.expr(f"aggregate(transform(sequence(1, __draws), i -> size(filter(__cdf, c -> c <= {drawn}))), 0, (a, x) -> a + x)").alias("n")
    )
    copies = drawn_rows.where("n > 0").select("row", "ident", F.explode(F.expr("sequence(1, n)")).alias("copy"))
    copies = copies.select("row", "copy", F.expr(f"md5(concat_ws(':', '{seed}', 'order', ident, cast(copy as string)))").alias("place"))
    return copies.repartition("place").sortWithinPartitions("place").select("row.*", *([F.col("copy").alias(copy_col)] if copy_col else []))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = f"""
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (
  SELECT source, rate, greatest(1, ceil(rate / {LARGEST_RATE}))::INT AS draws
  FROM (SELECT source, 1.0::DOUBLE / count(*) OVER () * sum(n) OVER () / n AS rate FROM n)
),
cdf AS (
  SELECT source, k, sum(exp(-r + k * ln(r) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c
  FROM (SELECT source, rate / draws AS r FROM rates), (SELECT unnest(range(0, 200)) AS k)
),
draws AS (
  SELECT d.doc_id, d.source, ('0x' || substr(md5('42:' || d.doc_id || ':' || i), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS u
  FROM documents d JOIN rates r ON r.source IS NOT DISTINCT FROM d.source, unnest(range(1, r.draws + 1)) AS t(i)
),
counts AS (
  SELECT d.doc_id, count(c.c) AS n FROM draws d LEFT JOIN cdf c ON c.source IS NOT DISTINCT FROM d.source AND c.c <= d.u GROUP BY d.doc_id
)
SELECT d.*, unnest(range(1, n + 1))::INT AS copy FROM documents d JOIN counts USING (doc_id) WHERE n > 0
"""
