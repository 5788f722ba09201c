"""The jobs as queries over the given tables: each is run twice into a new folder, and what stands there then is returned."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import constants as C
from quarrylight.plans import oracles
from quarrylight.sources.shared import new_folder

from . import evaluate_search, refresh_index

LINES = oracles.TILE


def job1_refresh_index(spark: SparkSession, sf: str) -> DataFrame:
    """The live postings of the index after two runs; the second finds nothing new.

    The pattern fits the one file or folder of documents: a stream's path has to be a folder or a pattern.
    """
    folder = new_folder(spark, "jobs/job1")
    for _ in range(2):
        index = refresh_index.run(spark, f"{sf}/document?.parquet", f"{folder}/index", f"{folder}/checkpoint", LINES, stem=False)
    return index.live("postings").select("term", "repo", "path", "start_line", "tf", "n", "dl", F.size("places").cast("bigint").alias("n_places"))


JOB1_SQL = f"""{oracles.BASE}, {oracles.DOCS}
SELECT term, repo, path, start_line, sum(w)::DOUBLE AS tf, count(*) AS n, any_value(dl) AS dl, count(*) AS n_places FROM occ GROUP BY ALL"""


def job2_evaluate_search(spark: SparkSession, sf: str) -> DataFrame:
    """The answers of every configuration, with its metrics in each row."""
    folder = new_folder(spark, "jobs/job2")
    for _ in range(2):
        metrics = evaluate_search.run(spark, f"{sf}/documents.parquet", f"{sf}/benchmark.parquet", folder)
    return spark.read.parquet(f"{folder}/answers").join(F.broadcast(metrics), "configuration")  # a row for each configuration


def _concept(c: dict) -> str:
    return f"""
hits AS (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, repo, path, start_line) AS place FROM (
    SELECT *, row_number() OVER (PARTITION BY query, repo, path ORDER BY round(score, 9) DESC, start_line) AS in_file FROM scored
  ) WHERE in_file <= {c.get("per_file", C.PER_FILE)}
)"""


EXACT = f"""
grouped AS (
  SELECT m.query, m.repo, m.path, coalesce(c.start_line, greatest(1, m.line - 5)) AS start_line, count(*) AS n
  FROM many m LEFT JOIN chunks c ON c.repo = m.repo AND c.path = m.path AND m.line BETWEEN c.start_line AND c.end_line GROUP BY 1, 2, 3, 4
),
hits AS (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, repo, path, start_line) AS place FROM (
    SELECT g.query, g.repo, g.path, g.start_line, (1 + ln(1 + n::DOUBLE)) * {oracles.PENALTY} AS score FROM grouped g JOIN files f USING (repo, path)
  )
)"""


def _configuration(c: dict) -> str:
    """The answers of one configuration, as a subquery with its own tables."""
    begin = f"WITH {oracles.FILES}, {oracles.LINE_LISTS}, {oracles.LINES}, {oracles.chunks(c['lines_per_chunk'])}, {oracles.DOCS}, {oracles.ASKED}"
    if c["mode"] == "concept":
        scored = oracles.scored().removeprefix(oracles.CONCEPT)
        middle = f", {oracles.BM25}{scored}, {_concept(c)}"
    else:
        middle = f", {oracles.MANY}, {EXACT}"
    name = oracles.q(c["name"])
    return f"""({begin}{middle}, {oracles.CONTAINED},
answers AS (
  SELECT query, place, repo, path, start_line, round(score, 9) AS score,
         EXISTS (SELECT 1 FROM expected e WHERE e.item_id = h.query AND e.place = h.repo || ':' || h.path) AS "right"
  FROM hits h WHERE place <= {c.get("limit", evaluate_search.LIMIT)}
),
ranks AS (
  SELECT item_id, min(a.place) AS rank FROM (SELECT DISTINCT item_id FROM expected) LEFT JOIN answers a ON a.query = item_id AND a."right" GROUP BY item_id
),
measured AS (
  SELECT count(*) AS cases, round(avg((coalesce(rank, 99) <= 1)::INT)::DOUBLE, 9) AS hit1, round(avg((coalesce(rank, 99) <= 5)::INT)::DOUBLE, 9) AS hit5,
         round(avg(coalesce(1.0 / rank, 0))::DOUBLE, 9) AS mrr FROM ranks
)
SELECT {name} AS configuration, answers.*, measured.* FROM answers, measured)"""


JOB2_SQL = "\nUNION ALL\n".join(_configuration(c) for c in evaluate_search.CONFIGURATIONS)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"job1_refresh_index": job1_refresh_index, "job2_evaluate_search": job2_evaluate_search}


def oracle_sql() -> dict[str, str]:
    return {"job1_refresh_index": JOB1_SQL, "job2_evaluate_search": JOB2_SQL}
