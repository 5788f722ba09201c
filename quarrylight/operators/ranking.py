"""BM25, heuristic scores, caps, excerpts, reranking and evaluation."""

from __future__ import annotations

import math
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import constants as C
from ..functions import paths
from ..functions.sizes import SMALL, broadcast_if_small
from .index import CHUNK

ORDER = ["repo", "path", "start_line"]


def bm25(rows: DataFrame, terms: DataFrame, statistics: DataFrame) -> DataFrame:
    """Scores of chunks for batches of queries: query, repo, path, start_line, bm25.

    ``rows`` are postings (term, repo, path, start_line, tf, dl) of all terms; ``terms`` has query and term,
    repeated terms counting again; ``statistics`` is one row over the whole index.  Postings are cut down to
    query terms by a broadcast of those terms (if they are few enough) before anything is shuffled.  They
    are read twice, by the counts of terms and by the sums of chunks, so they are dealt out by chunk once.
    """
    own = rows.join(broadcast_if_small(terms.select("term").distinct()), "term")
    return score_postings(own.repartition(*CHUNK), terms, statistics)


def score_postings(rows: DataFrame, terms: DataFrame, statistics: DataFrame, one_query: bool = False) -> DataFrame:
    """The same from postings (term, repo, path, start_line, tf, dl) of the queries' terms; those of one query need not be counted."""
    df = rows.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    s = statistics.select("n_docs", (F.col("n_tokens") / F.col("n_docs")).alias("avgdl"))
    idf = F.log((F.col("n_docs") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    weights = df.crossJoin(F.broadcast(s)).select("term", "avgdl", F.when(idf > 0, idf).otherwise(C.LEAST_IDF).alias("idf"))
    asked = terms.join(weights, "term")
    tf = F.col("tf") * (C.K1 + 1) / (F.col("tf") + C.K1 * (1 - C.B + C.B * F.col("dl") / F.col("avgdl")))
    asked = F.broadcast(asked) if one_query or terms.limit(SMALL + 1).count() <= SMALL else asked  # as many rows as terms
    return rows.join(asked, "term").groupBy("query", *CHUNK).agg(F.sum(F.col("idf") * tf).alias("bm25"))


def shortlist(scored: DataFrame, k: int = C.SHORTLIST) -> DataFrame:
    """The k best chunks of each query, in a total order."""
    best = Window.partitionBy("query").orderBy(F.desc(F.round("bm25", 9)), *ORDER)
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def concept_score(candidates: DataFrame, terms: DataFrame | list[str], query_text: str = "", mentioned: Column | None = None) -> DataFrame:
    """Adds score to query, bm25, symbol, path, kind, flags: matches in symbol and path, kind, and penalties.

    Terms are an array per query (column ``terms`` of the frame ``terms``), or the list of a single query's; a candidate is
    scored in its row.
    """
    if isinstance(terms, list):
        own = candidates.withColumn("terms", F.array(*map(F.lit, terms)))
    else:
        own = candidates.join(broadcast_if_small(terms.select("query", "terms")), "query")
    most = F.max("bm25").over(Window.partitionBy("query"))
    n = F.size("terms")
    in_symbol = F.size(F.filter("terms", lambda t: (F.col("symbol") != "") & F.contains(F.lower("symbol"), t)))
    in_path = F.size(F.filter("terms", lambda t: F.contains(F.lower("path"), t)))
    kind = F.create_map(*[F.lit(x) for kv in C.KIND_FACTOR.items() for x in kv])[F.col("kind")]
    score = F.col("bm25") / most * (1 + 0.5 * in_symbol / n + 0.25 * in_path / n) * F.coalesce(kind, F.lit(1.0))
    score = score * paths.penalty(F.col("flags"), query_text)
    if mentioned is not None:
        score = score * F.when(mentioned, 2.0).otherwise(1.0)
    return own.withColumn("score", score).drop("terms")


def cap_per_file(hits: DataFrame, n: int = C.PER_FILE) -> DataFrame:
    best = Window.partitionBy("query", "repo", "path").orderBy(F.desc(F.round("score", 9)), "start_line")
    return hits.withColumn("in_file", F.row_number().over(best)).where(F.col("in_file") <= n).drop("in_file")


def top(hits: DataFrame, limit: int, score: str = "score") -> DataFrame:
    best = Window.partitionBy("query").orderBy(F.desc(F.round(score, 9)), *ORDER)
    return hits.withColumn("place", F.row_number().over(best)).where(F.col("place") <= limit)


# ---- excerpts ----


def densest_window(lines: Column, terms: Column, head: int = 6, most: int = 30, reach: int = 400) -> Column:
    """Of a chunk's lines (an array), where the window behind the head with most term hits begins (from 1), or null if all fit.

    The first of equals wins; windows that begin more than ``reach`` lines below the start aren't looked at.
    """
    wide = most - head
    hits = F.transform(F.transform(lines, F.lower), lambda x: F.size(F.filter(terms, lambda t: F.contains(x, t))))
    last = F.greatest(F.least(F.size(lines) - wide + 1, F.lit(reach + 2)), F.lit(head + 1))

    def best(hits: Column) -> Column:
        sums = F.transform(
            F.sequence(F.lit(head + 1), last),
            lambda i: F.struct((-F.aggregate(F.slice(hits, i, wide), F.lit(0), lambda a, x: a + x)).alias("s"), i.alias("i")),
        )
        return F.array_min(sums)["i"]

    # hits are bound to a lambda's variable, as an expression within the windows would be evaluated for each of them
    return F.when(F.size(lines) > most, F.transform(F.array(hits), best)[0])


def match_windows(hits: DataFrame, around: int = 2, windows: int = 3) -> DataFrame:
    """From query, repo, path, start_line, end_line and line (a row per match): the first merged windows, a row each."""
    by = ["query", "repo", "path", "start_line", "end_line"]
    own = hits.select(*by, F.greatest("start_line", F.col("line") - around).alias("a"), F.least("end_line", F.col("line") + around).alias("b"), "line")
    before = Window.partitionBy(*by).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    running = Window.partitionBy(*by).orderBy("line")
    own = own.withColumn("new", F.coalesce((F.col("a") > F.max("b").over(before) + 1).cast("int"), F.lit(1)))
    own = own.withColumn("island", F.sum("new").over(running)).where(F.col("island") <= windows)
    return own.groupBy(*by, "island").agg(F.min("a").alias("first_line"), F.max("b").alias("last_line"), F.count(F.lit(1)).alias("matches"))


def render(lines: Column, first: Column, last: Column, marks: Column | None = None) -> Column:
    """Numbered lines of an array: ``>`` before marked ones, right-aligned numbers, cut at 240 characters."""
    first, last = first.cast("int"), last.cast("int")
    width = F.length(last.cast("string"))

    def one(n: Column) -> Column:
        own = F.regexp_replace(F.element_at(lines, n), "[ \t]+$", "")
        own = F.when(F.length(own) > 240, F.concat(F.substring(own, 1, 240), F.lit("..."))).otherwise(own)
        mark = F.lit("") if marks is None else F.when(F.array_contains(marks, n), ">").otherwise(" ")
        return F.concat(mark, F.lpad(n.cast("string"), width, " "), F.lit("| "), own)

    to = F.least(last, F.size(lines))
    numbered = F.when(F.greatest(first, F.lit(1)) <= to, F.transform(F.sequence(F.greatest(first, F.lit(1)), to), one)).otherwise(
        F.array().cast("array<string>")
    )
    return F.array_join(F.transform(numbered, lambda x: F.concat(x, F.lit("\n"))), "")


def pack(hits: DataFrame, budget: int = C.BUDGET) -> DataFrame:
    """Excerpts of a query's hits within a budget of bytes: what would overflow loses its excerpt and uses nothing.

    The hits of a query, some dozens after its limit, are folded in order of place.
    """
    rows = hits.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", F.octet_length("excerpt").alias("size")))).alias("r"))
    start = F.expr("named_struct('used', 0, 'kept', cast(array() as array<boolean>))")

    def step(state: Column, x: Column) -> Column:
        keep = (F.size(state["kept"]) == 0) | (state["used"] + x["size"] <= budget)
        return F.struct(
            F.when(keep, state["used"] + x["size"]).otherwise(state["used"]).alias("used"), F.concat(state["kept"], F.array(keep)).alias("kept")
        )

    kept = rows.select("query", "r", F.aggregate("r", start, step)["kept"].alias("kept"))
    flags = kept.select("query", F.explode(F.arrays_zip("r", "kept")).alias("z")).select("query", F.col("z.r.place").alias("place"), F.col("z.kept").alias("kept"))
    return hits.join(flags, ["query", "place"]).withColumn("excerpt", F.when(F.col("kept"), F.col("excerpt")).otherwise(""))


# ---- reranking ----


class Scorer(Protocol):
    """Judges hits: from query, id, header, text to query, id, p in [0, 1] and, if it has one, cost; hits without a row are dropped."""

    def __call__(self, hits: DataFrame) -> DataFrame: ...


def overlap_scorer(hits: DataFrame) -> DataFrame:
    """A local scorer: the share of the query's terms that header or text hold."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("query_text"), F.lit(r"([\p{L}\p{N}]+)"), 1))
    held = F.filter(words, lambda t: F.contains(F.lower(F.concat_ws(" ", "header", "text")), t))
    return hits.select("query", "id", F.when(F.size(words) > 0, F.size(held) / F.size(words)).otherwise(0.0).alias("p"))


def blend(hits: DataFrame, judged: DataFrame, weight: float = C.BLEND) -> DataFrame:
    """Blends judged p with the keyword score.  Hits below the threshold are weak; without any other, the best three weak ones stay."""
    own = hits.join(judged.select("query", "id", "p"), ["query", "id"])
    by_query = Window.partitionBy("query")
    mentioned = F.when(F.col("mentioned"), C.MENTIONED).otherwise(0.0) if "mentioned" in hits.columns else F.lit(0.0)
    own = own.withColumn("blended", F.round("p", 2) + weight * F.col("score") / F.max("score").over(by_query) + mentioned)
    own = own.withColumn("weak", F.col("p") < C.RELEVANT).withColumn("strong", F.max((~F.col("weak")).cast("int")).over(by_query))
    order = by_query.orderBy(F.desc(F.round("blended", 9)), *ORDER)
    own = own.where("strong = 0 or not weak").withColumn("place", F.row_number().over(order))
    return own.where((F.col("strong") == 1) | (F.col("place") <= C.WEAK_SHOWN)).drop("strong")


# ---- evaluation ----


def metrics(cases: DataFrame, hits: DataFrame, expected: DataFrame) -> DataFrame:
    """hit@1, hit@5 and MRR of hits (query, place, repo, path, start_line, end_line) for cases (query) with expected places.

    ``expected`` has query and place ``repo:path[:line]``; a path counts when equal, ended or begun by it.
    """
    want = expected.select(
        "query",
        F.split_part("place", F.lit(":"), F.lit(1)).alias("want_repo"),
        F.split_part("place", F.lit(":"), F.lit(2)).alias("want_path"),
        F.split_part("place", F.lit(":"), F.lit(3)).try_cast("int").alias("want_line"),
    )
    own = hits.join(want.withColumnRenamed("query", "q"), (F.col("query") == F.col("q")) & (F.col("repo") == F.col("want_repo")))
    path_fits = (F.col("path") == F.col("want_path")) | F.col("path").endswith(F.concat(F.lit("/"), "want_path")) | (
        (F.col("want_path") != "") & F.col("path").startswith(F.col("want_path"))
    )
    line_fits = F.col("want_line").isNull() | F.col("want_line").between(F.col("start_line"), F.col("end_line"))
    ranks = own.where(path_fits & line_fits).groupBy("query").agg(F.min("place").alias("rank"))
    rank = cases.select("query").distinct().join(ranks, "query", "left")
    return rank.agg(
        F.count(F.lit(1)).alias("cases"),
        F.avg(F.coalesce((F.col("rank") == 1).cast("double"), F.lit(0.0))).alias("hit1"),
        F.avg(F.coalesce((F.col("rank") <= 5).cast("double"), F.lit(0.0))).alias("hit5"),
        F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"),
    )


def idf(n_docs: int, n: int) -> float:
    return max(math.log((n_docs - n + 0.5) / (n + 0.5)), C.LEAST_IDF)
